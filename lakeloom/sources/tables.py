"""Driver tables: one parquet file (or folder) per table under a scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lakeloom.session import session_key

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_PLANS: dict[tuple, DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    The DataFrame (a plan, no data) is reused within a session, so the file
    listing and footer read happen once per table, not once per query."""
    key = (session_key(spark), table_path(sf_dir, name))
    df = _PLANS.get(key)
    if df is None:
        df = _PLANS[key] = spark.read.parquet(table_path(sf_dir, name))
    return df


def register_all(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)
