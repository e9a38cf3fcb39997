"""The library's queries by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engine_queries, file_queries, lexical_queries, text_queries, vector_queries

_PAIRS = lexical_queries.QUERIES | file_queries.QUERIES | vector_queries.QUERIES | text_queries.QUERIES | engine_queries.QUERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v[0] for k, v in _PAIRS.items()}
ORACLES: dict[str, str] = {k: v[1] for k, v in _PAIRS.items() if v[1]}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_queries.text_search(spark, sf_dir)
