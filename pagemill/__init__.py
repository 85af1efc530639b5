"""Web pages to a clean, language-model-ready markdown corpus, on Spark."""
