"""The registered queries of the library and their SQL twins."""

from __future__ import annotations

from quietday.plans import events, features, models, parsers, samples, slots, streams, summaries, verification  # noqa: F401  each registers its queries
from quietday.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
