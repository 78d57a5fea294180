"""All registered queries of the library, by topic."""

from __future__ import annotations

from . import learning_queries, lexicon_queries, order_queries, planted_queries, source_queries, state_queries, structure_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]

flagship = QUERIES["key_convert_full"]
