"""Options of a run, their validation, and the equivalent command line."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, replace
from enum import Enum

#: Requests in flight at most, and the default.
MOST_CONCURRENT, CONCURRENT = 256, 16


class DeepStrategy(Enum):
    BFS = "bfs"
    DFS = "dfs"


@dataclass(frozen=True)
class Options:
    url: str = ""
    raw: bool = False
    prune: bool = False
    citations: bool = False
    refs: bool = False
    query: str | None = None
    css: str | None = None
    full: bool = False
    wait_for: str | None = None
    no_links: bool = False
    no_images: bool = False
    timeout_ms: int = 30_000
    site: bool = False
    match_pattern: str | None = None
    deep: DeepStrategy | None = None
    max_pages: int = 0
    max_depth: int = 2
    concurrency: int = CONCURRENT
    browser: bool = False
    ignore_robots: bool = False
    no_delay: bool = False
    no_metadata: bool = False
    verbose: bool = False
    tui: bool = False
    copy: bool = False
    jsonl: bool = False
    output: str | None = None
    output_dir: str | None = None

    def normalised(self) -> Options:
        """refs imply citations, scrolling or waiting imply the browser, concurrency stays within its bounds."""
        deep = DeepStrategy(self.deep) if isinstance(self.deep, str) else self.deep
        return replace(
            self,
            deep=deep,
            citations=self.citations or self.refs,
            browser=self.browser or self.full or self.wait_for is not None,
            concurrency=min(max(self.concurrency, 1), MOST_CONCURRENT),
        )

    def page_limit(self) -> int | None:
        """0 means every page."""
        return self.max_pages or None

    def command(self, program: str = "pagemill") -> str:
        """The command line that gives these options."""
        parts = [program, self.url] if self.url else [program]
        for name, flag in FLAGS.items():
            if getattr(self, name):
                parts.append(flag)
        for name, flag in VALUES.items():
            value = getattr(self, name)
            if value is not None and value != getattr(Options, name, None):
                parts += [flag, str(value.value if isinstance(value, Enum) else value)]
        return " ".join(shlex.quote(p) for p in parts)


#: Switches, and options with a value, by field.
FLAGS = {
    "raw": "--raw", "prune": "--prune", "citations": "--citations", "refs": "--refs", "full": "--full", "no_links": "--no-links",
    "no_images": "--no-images", "site": "--site", "browser": "--browser", "ignore_robots": "--ignore-robots", "no_delay": "--no-delay",
    "no_metadata": "--no-metadata", "verbose": "--verbose", "copy": "--copy", "jsonl": "--jsonl",
}
VALUES = {
    "query": "--query", "css": "--css", "wait_for": "--wait-for", "timeout_ms": "--timeout", "match_pattern": "--match", "deep": "--deep",
    "max_pages": "--pages", "max_depth": "--max-depth", "concurrency": "--concurrency", "output": "--output", "output_dir": "--output-dir",
}
