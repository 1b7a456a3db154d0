"""Every registered query against its DuckDB oracle on the smallest scale factor
(the driver runs the same comparison at sf0.01)."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from lakeloom.plans import registry
from tests.conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(recs, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "success_rate" in df.columns


def test_every_query_has_oracle_or_is_known_rows_only():
    # of this library's own queries; optional ones have their own tests
    rows_only = {"page_text_rows", "page_raw_text", "approx_users"}
    assert set(registry.QUERIES) - set(registry.ORACLES) == rows_only


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    srecs = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _rows(srecs, sdf.columns) == _rows(rel.fetchall(), rel.columns)


def test_approx_users_close_to_exact(spark):
    from pyspark.sql import functions as F
    from lakeloom.sources.tables import load
    approx = {r["event_type"]: r["approx_users"] for r in QUERIES["approx_users"](spark, SF).collect()}
    exact = {r["event_type"]: r["n"] for r in load(spark, SF, "events").groupBy("event_type")
             .agg(F.count_distinct("user_id").alias("n")).collect()}
    assert approx.keys() == exact.keys()
    assert all(abs(approx[k] - exact[k]) <= max(2, 0.03 * exact[k]) for k in exact)


def test_page_text_is_visible_text_only(spark):
    rows = QUERIES["page_text_rows"](spark, SF).collect()
    assert rows and all("<" not in r["text"] and "track(" not in r["text"] for r in rows)
    assert all(r["n_lines"] == len(r["text"].split("\n")) for r in rows)


# Queries whose plan changes with input size: run them with the large-input
# (chunked / distributed / pruned) plans forced and compare with the oracle.
ADAPTIVE = ["topic_metrics", "consumer_lag", "rank_parts", "running_sum", "analytic_orders", "join_asof",
            "rolling_hour_value", "join_range", "e2e_latency", "percentiles_value", "returns", "backtest",
            "submission_file_full_join", "submission_file_full_join_status", "topic_read", "topic_offsets",
            "session_activity"]


@pytest.mark.parametrize("name", ADAPTIVE)
def test_large_input_plans_match_oracle(spark, duck, monkeypatch, name):
    from lakeloom.operators import scan
    monkeypatch.setattr(scan, "SMALL_INPUT_BYTES", 0)
    sdf = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert _rows([tuple(r) for r in sdf.collect()], sdf.columns) == _rows(rel.fetchall(), rel.columns)
