"""The queries of the corpus engine and their SQL."""

from __future__ import annotations

from pagemill.plans import goldens, more, relations, texts  # noqa: F401  they register their queries
from pagemill.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
