"""The queries of this subpackage and their SQL, for the entry point."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("toxicity", "token_shards", "lm_score", "mixture", "quality", "secrets", "url_filter", "jaccard_join", "decontaminate", "warc")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator's query by name."""
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").ORACLE_SQL.items()}
