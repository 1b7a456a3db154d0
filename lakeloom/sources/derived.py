"""Tracking tables and landed-stream tables derived from the driver tables.

The reference keeps its state in five tracking tables and a few remote
systems; the test data ships TPC-H-like tables instead.  These builders map
one onto the other with plain projections (no shuffle) except where the
definition itself needs one (``prices`` aggregates, ``topic_messages``
numbers messages within a partition).  The same definitions, as SQL, are the
oracle's views (``lakeloom.plans.oracle.VIEWS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.scan import grouped_rank
from lakeloom.session import session_key
from lakeloom.sources.tables import load


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_processing_stats, one row per event."""
    e = load(spark, sf_dir, "events")
    eid = F.col("event_id")
    is_err = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("fps-"), _s("event_id")).alias("id"),
        F.concat(F.lit("file_"), _s("event_id"), F.lit(".csv")).alias("file_name"),
        F.when(eid % 3 == 0, "pdf").when(eid % 3 == 1, "csv").otherwise("json").alias("file_type"),
        F.floor(F.col("value") * 1000).cast("long").alias("file_size_bytes"),
        F.when(is_err, "failed").when(eid % 11 == 0, "processing").otherwise("completed")
        .alias("processing_status"),
        (eid % 250).cast("int").alias("records_extracted"),
        F.concat(F.lit("wf_"), (F.col("user_id") % 5).cast("string")).alias("workflow_id"),
        F.when(F.col("user_id") % 5 == 4, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Workflow "), (F.col("user_id") % 5).cast("string"))).alias("workflow_name"),
        F.when(is_err, "extract failed").alias("error_message"),
        F.col("value").alias("processing_duration_ms"),
        F.col("ts").alias("uploaded_at"),
        F.when(~is_err & (eid % 11 != 0), F.expr("ts + interval '5' second")).alias("completed_at"),
    )


def ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_submissions, one row per order (orders with key divisible by 7 never submitted)."""
    o = load(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 7 != 0)
    key = _s("o_orderkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    done = (F.col("o_orderstatus") == "F") & ~urgent
    return o.select(
        F.concat(F.lit("ws-"), key).alias("id"),
        F.concat(F.lit("trace-"), key).alias("trace_id"),
        F.concat(F.lit("https://files.example.com/in/file_"), key, F.lit(".csv")).alias("uploaded_file_url"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("file_"), key, F.lit(".csv"))).alias("file_name"),
        F.when(urgent, "failed").when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "in-progress").otherwise("submitted").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("wf_"), (F.col("o_custkey") % 5).cast("string"))).alias("workflow_id"),
        F.concat(F.lit("Workflow "), (F.col("o_custkey") % 5).cast("string")).alias("workflow_name"),
        F.when(urgent, "submission failed").alias("error_message"),
        F.concat(F.lit('{"priority": "'), F.col("o_orderpriority"), F.lit('", "token": "t'), key, F.lit('"}'))
        .alias("metadata"),
        F.col("o_orderdate").alias("submitted_at"),
        F.when(done, F.expr("o_orderdate + interval '60' second")).alias("completed_at"),
        done.alias("crew_kickoff_completed"),
    )


def wes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workflow_execution_stats, one row per event."""
    e = load(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        F.concat(F.lit("wes-"), _s("event_id")).alias("id"),
        F.concat(F.lit("wf_"), (F.col("user_id") % 5).cast("string")).alias("workflow_id"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running")
        .otherwise("success").alias("status"),
        (eid % 40).cast("int").alias("input_files_count"),
        (eid % 500).cast("int").alias("records_processed"),
        (eid % 7).cast("int").alias("records_failed"),
        F.col("value").alias("duration_ms"),
        F.col("ts").alias("started_at"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily price table ``(dt, symbol, price)``; partial aggregation before the shuffle."""
    e = load(spark, sf_dir, "events")
    return (e.groupBy(F.col("ts").cast("date").alias("dt"), F.col("event_type").alias("symbol"))
            .agg(F.floor(F.max("value")).cast("long").alias("price")))


def topic_messages(spark: SparkSession, sf_dir: str, with_offsets: bool = True) -> DataFrame:
    """Landed topic: ``msg_offset`` numbers messages within (topic, partition) by ``msg_id``.

    The numbering uses the chunked scan, so a hot topic is not one task.
    Callers that do not need offsets skip the numbering altogether.
    """
    e = load(spark, sf_dir, "events")
    base = e.select(
        F.col("event_id").alias("msg_id"), F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("part_no"), "ts",
        F.length("props").cast("long").alias("size_bytes"),
        F.concat(F.lit("producer-"), (F.col("user_id") % 6).cast("string")).alias("producer_id"))
    if not with_offsets:
        return base
    ranked = grouped_rank(base, ["topic", "part_no"], [F.col("msg_id")], "msg_offset")
    return ranked.select("msg_id", "topic", "part_no", (F.col("msg_offset") - 1).alias("msg_offset"),
                         "ts", "size_bytes", "producer_id")


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter(F.col("event_id") % 10 < 8)
    return e.select(
        F.col("event_id").alias("msg_id"), F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("part_no"),
        F.when(F.col("event_id") % 2 == 0, "group-a").otherwise("group-b").alias("group_id"),
        F.expr("ts + (event_id % 50) * interval '1' second").alias("consumed_at"))


def replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter(F.col("event_id") % 13 != 0)
    return e.select(F.col("event_id").alias("msg_id"), F.col("event_type").alias("topic"),
                    F.expr("ts + (event_id % 9) * interval '1' second").alias("replicated_at"))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-trace status event log: each order fans out to its events with a generator."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    kinds = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"))
                      for i, k in enumerate(["submitted", "events", "crew_kickoff_completed", "api_error"])])
    x = o.select("o_orderkey", "o_orderdate", F.inline(kinds))
    k = F.col("o_orderkey")
    keep = (F.col("seq") < 2) | ((F.col("seq") == 2) & (k % 4 != 3)) | ((F.col("seq") == 3) & (k % 6 == 0))
    secs = F.col("seq") * 30 + F.when((F.col("seq") == 2) & (k % 5 == 0), 600).otherwise(0)
    return x.filter(keep).select(
        F.concat(F.lit("trace-"), _s("o_orderkey")).alias("trace_id"), "seq", "kind",
        (F.col("o_orderdate") + F.make_dt_interval(secs=secs)).alias("at"))


def upsert_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed table to upsert into: customers in credit, keyed by customer."""
    c = load(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    return c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("status"),
                    F.col("c_acctbal").alias("amount"))


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is an update of its customer: many in-batch duplicates per key
    (the last by order key wins), and customers not in the target are inserts."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"),
                    F.col("o_orderpriority").alias("status"), F.col("o_totalprice").alias("amount"))


def flow_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    conn = k % 3 == 2
    return s.select(
        k.alias("component_id"),
        F.when(k % 3 == 0, "processor").when(k % 3 == 1, "service").otherwise("connection").alias("kind"),
        F.when(conn, F.lit(None).cast("string")).when(k % 17 == 0, "Invalid").when(k % 5 == 0, "Stopped")
        .otherwise("Running").alias("state"),
        F.when(conn, k * 7 % 50).otherwise(0).alias("queued_items"),
        F.when(conn, k * 11 % 101).otherwise(0).alias("percent_use"))


BUILDERS = {
    "fps": fps, "ws": ws, "wes": wes, "prices": prices, "topic_messages": topic_messages,
    "consumed": consumed, "replica": replica, "status_events": status_events,
    "upsert_target": upsert_target, "upsert_batch": upsert_batch, "flow_components": flow_components,
}


_VIEWS: dict[tuple, DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy plan, built once per session and scale folder."""
    key = (session_key(spark), sf_dir, name)
    df = _VIEWS.get(key)
    if df is None:
        df = _VIEWS[key] = BUILDERS[name](spark, sf_dir)
    return df
