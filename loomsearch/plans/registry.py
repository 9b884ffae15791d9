"""All queries of the retrieval engine by name, with reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomsearch.plans import changes, fielded, judged, lexical, patterns, ranked

_MODULES = (lexical, ranked, fielded, patterns, judged, changes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
