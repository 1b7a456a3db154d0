"""Registry of named queries: Spark callable + DuckDB oracle text.

``__spark_entry__`` exposes ``QUERIES`` / ``ORACLES`` to the driver.  Each
callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
input tables.  Queries without an oracle are compared on row counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans.oracle import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, views: tuple[str, ...] = (),
             extra: dict[str, str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views, extra=extra)
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (each registers itself)."""
    from lakeloom.plans import (q_tracking, q_filequery, q_writes, q_portfolio,  # noqa: F401
                                q_topics, q_text, q_quality, q_conformance, q_streaming, q_mechanisms)
    # the streamed status machine must reproduce the batch fold exactly
    if "stream_status_machine" in QUERIES and "status_fold" in ORACLES:
        ORACLES["stream_status_machine"] = ORACLES["status_fold"]
    if "stream_consumer_lag" in QUERIES and "consumer_lag" in ORACLES:
        ORACLES["stream_consumer_lag"] = ORACLES["consumer_lag"]
