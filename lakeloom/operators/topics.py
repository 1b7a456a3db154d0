"""Landed-topic analytics: output sampling (T5), windowed metrics (T10), consumer
lag (T11), end-to-end latency (T12), replication (T13), lineage (T14), alert
policies (T15) and sessions (T18), all as batch DataFrame plans.  The
streaming forms live in ``lakeloom.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.scan import needs_chunks

# Default output sampling of the streaming-SQL client
# (interval ms, record count, window) and its "all messages" variant.
SAMPLE_DEFAULT = (1000, 100, 100)
SAMPLE_ALL = (0, 10000, 10000)


def epoch_ms(c: str | Column) -> Column:
    """Milliseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp")) / 1000


def sample_output(df: DataFrame, ts: str, tie: str, interval_ms: int = 1000, count: int = 100,
                  window: int = 100) -> DataFrame:
    """T5: earliest record per ``interval_ms`` bucket (0 keeps all), the first
    ``count`` of those in ``(ts, tie)`` order, then the last ``window`` of them.

    The bucket pick is an aggregate (``min_by``), the two cuts are top-N
    (TakeOrderedAndProject), so no step gathers the stream in one task.
    """
    cols = df.columns
    if interval_ms and interval_ms > 0:
        bucket = F.floor(epoch_ms(ts) / interval_ms)
        df = (df.groupBy(bucket.alias("__b"))
              .agg(F.min_by(F.struct(*cols), F.struct(F.col(ts), F.col(tie))).alias("__r"))
              .select("__r.*"))
    first = df.orderBy(F.col(ts).asc(), F.col(tie).asc()).limit(count)
    last = first.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(window)
    return last.orderBy(F.col(ts).asc(), F.col(tie).asc())


def windowed_metrics(msgs: DataFrame, duration: str = "1 hour", keys=("topic",),
                     from_ts=None, to_ts=None) -> DataFrame:
    """Per tumbling window and key: messages, bytes, min/max offset; ``[from, to)``
    is a plain filter that Catalyst pushes to the scan."""
    m = msgs
    if from_ts is not None:
        m = m.filter(F.col("ts") >= F.lit(from_ts))
    if to_ts is not None:
        m = m.filter(F.col("ts") < F.lit(to_ts))
    aggs = [F.count(F.lit(1)).alias("messages"), F.sum("size_bytes").alias("bytes")]
    if "msg_offset" in m.columns:
        aggs += [F.min("msg_offset").alias("min_offset"), F.max("msg_offset").alias("max_offset")]
    g = m.groupBy(F.window("ts", duration).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                    *[c for c in g.columns if c not in ("w", *keys)])


def consumer_lag(msgs: DataFrame, consumed: DataFrame) -> DataFrame:
    """Per group, topic, partition: ``end offset - committed offset``.

    A group is subscribed to the topics it consumed from; partitions of those
    topics it never read count in full.  Offsets of consumed messages come from
    a join on the message id (unique, so no hot key).
    """
    ends = msgs.groupBy("topic", "part_no").agg((F.max("msg_offset") + 1).alias("end_offset"))
    read = (consumed.select("msg_id", "group_id")
            .join(msgs.select("msg_id", "topic", "part_no", "msg_offset"), "msg_id")
            .groupBy("group_id", "topic", "part_no").agg((F.max("msg_offset") + 1).alias("committed_offset")))
    subs = consumed.select("group_id", "topic").distinct()
    j = subs.join(ends, "topic").join(read, ["group_id", "topic", "part_no"], "left")
    return j.select("group_id", "topic", "part_no", "end_offset",
                    F.coalesce("committed_offset", F.lit(0)).alias("committed_offset"),
                    (F.col("end_offset") - F.coalesce("committed_offset", F.lit(0))).alias("lag"))


def latency(msgs: DataFrame, consumed: DataFrame, keys=("topic",)) -> DataFrame:
    """``consumed_at - ts`` in ms per key: count, avg, max, exact p50/p95/p99.

    The percentiles come from a distributed histogram with chunked cumulative
    counts (``operators.stats``), so a hot topic is not one task.
    """
    from lakeloom.operators.stats import exact_percentiles
    j = (msgs.select("msg_id", "ts").join(consumed.select("msg_id", "topic", "group_id", "consumed_at"), "msg_id")
         .withColumn("latency_ms", epoch_ms("consumed_at") - epoch_ms("ts")))
    basic = [F.count(F.lit(1)).alias("messages"), F.avg("latency_ms").alias("avg_ms"),
             F.max("latency_ms").alias("max_ms")]
    ps = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    if not needs_chunks(j):
        # small input: one aggregate gives the same exact percentiles
        return j.groupBy(*keys).agg(*basic, *[F.percentile("latency_ms", p).alias(n) for n, p in ps.items()])
    pct = exact_percentiles(j, list(keys), "latency_ms", ps, distributed=True)
    return j.groupBy(*keys).agg(*basic).join(pct, list(keys), "left")


def replication(msgs: DataFrame, replica: DataFrame) -> DataFrame:
    """Per topic: source and replica counts, missing copies, max delay (ms)."""
    src = msgs.select("msg_id", F.col("topic").alias("s_topic"), "ts")
    rep = replica.select(F.col("msg_id").alias("r_id"), F.col("topic").alias("r_topic"), "replicated_at")
    j = src.join(rep, src["msg_id"] == rep["r_id"], "full_outer")
    return j.groupBy(F.coalesce("s_topic", "r_topic").alias("topic")).agg(
        F.count("msg_id").alias("source_count"), F.count("r_id").alias("replica_count"),
        F.count_if(F.col("r_id").isNull()).alias("missing"),
        F.max(epoch_ms("replicated_at") - epoch_ms("ts")).alias("max_delay_ms"))


def lineage_edges(msgs: DataFrame, consumed: DataFrame) -> DataFrame:
    """Distinct producer->topic and topic->group edges with message counts."""
    produces = (msgs.groupBy(F.col("producer_id").alias("src"), F.col("topic").alias("dst"))
                .agg(F.count(F.lit(1)).alias("messages")).withColumn("kind", F.lit("produces")))
    consumes = (consumed.groupBy(F.col("topic").alias("src"), F.col("group_id").alias("dst"))
                .agg(F.count(F.lit(1)).alias("messages")).withColumn("kind", F.lit("consumes")))
    return produces.unionByName(consumes).select("kind", "src", "dst", "messages")


def lineage_of(edges: DataFrame, node: str, hops: int = 2) -> DataFrame:
    """Edges within ``hops`` of ``node``; each hop is a semi join against the
    frontier.  The edge table (producers x topics x groups, metadata-sized) and
    each frontier are checkpointed to the shared folder, so every hop reads them
    instead of re-deriving them and the plan stays linear in ``hops``."""
    from lakeloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.checkpoint(eager=True)
    frontier = edges.sparkSession.createDataFrame([(node,)], "n string")
    seen = None
    for _ in range(hops):
        # two equi semi joins instead of one OR condition (which would be a nested loop)
        hit = (edges.join(frontier, edges["src"] == frontier["n"], "left_semi")
               .unionByName(edges.join(frontier, edges["dst"] == frontier["n"], "left_semi")))
        seen = hit if seen is None else seen.unionByName(hit)
        frontier = (hit.select(F.col("src").alias("n")).unionByName(hit.select(F.col("dst").alias("n")))
                    .distinct().checkpoint(eager=True))
    return seen.distinct()


def alerts(metrics: DataFrame, policies: DataFrame, entity_col: str = "topic") -> DataFrame:
    """Policies ``(policy_id, entity_type, metric, op, threshold, enabled)`` against
    windowed metrics; each breach is one unread notification
    ``policy|entity|window_start``."""
    long = metrics.select(
        F.col(entity_col).alias("entity"), "window_start",
        F.inline(F.array(F.struct(F.lit("messages").alias("metric"), F.col("messages").cast("double").alias("value")),
                         F.struct(F.lit("bytes").alias("metric"), F.col("bytes").cast("double").alias("value")))))
    p = policies.filter(F.col("enabled"))
    j = long.join(F.broadcast(p), "metric")
    op, v, t = F.col("op"), F.col("value"), F.col("threshold")
    breach = (F.when(op == ">", v > t).when(op == ">=", v >= t).when(op == "<", v < t).when(op == "<=", v <= t)
              .when(op == "=", v == t).otherwise(F.lit(False)))
    hits = j.filter(breach)
    return hits.select(
        F.concat_ws("|", "policy_id", "entity", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
        .alias("notification_id"),
        "policy_id", "entity_type", "entity", "window_start", "metric", "value", "threshold",
        F.lit(False).alias("is_read"))


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap_seconds: int = 1800,
             tie: str = "event_id", value: str = "value") -> DataFrame:
    """Session windows per key; a session closes after ``gap_seconds`` without
    events (end = last event + gap), as ``session_window`` defines them.

    ``session_window`` merges sessions after hashing by key, so one key's events
    meet in one task.  Large inputs instead find session starts by gaps and
    islands on the chunked operators: row numbers per key, the previous event
    by an equi-join on ``(key, rn - 1)`` (unique pairs), a start where the gap
    reaches the threshold, session ids as the chunked running count of starts,
    then one aggregation per (key, session) combined map-side.
    """
    gap = F.make_dt_interval(secs=F.lit(gap_seconds))
    if not needs_chunks(events):
        g = events.groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("s")).agg(
            F.count(F.lit(1)).alias("events"), F.sum(value).alias("total_value"))
        return g.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                        "events", "total_value")
    from lakeloom.operators.scan import grouped_rank, grouped_running
    base = events.select(key, ts, tie, value)
    ranked = grouped_rank(base, [key], [F.col(ts), F.col(tie)], "__rn").withColumn("__g", F.struct(key))
    prev = ranked.select(F.col("__g").alias("__pg"), (F.col("__rn") + 1).alias("__prn"), F.col(ts).alias("__prev"))
    j = ranked.join(prev, (ranked["__g"] == prev["__pg"]) & (ranked["__rn"] == prev["__prn"]), "left")
    starts = j.withColumn("__start", F.when(F.col("__prev").isNull() | (F.col(ts) >= F.col("__prev") + gap), 1)
                          .otherwise(0).cast("long")).select(key, ts, tie, value, "__start")
    numbered = grouped_running(starts, [key], [F.col(ts), F.col(tie)], {"__sid": F.col("__start")})
    g = numbered.groupBy(key, "__sid").agg(F.min(ts).alias("session_start"), F.max(ts).alias("__last"),
                                          F.count(F.lit(1)).alias("events"), F.sum(value).alias("total_value"))
    return g.select(key, "session_start", (F.col("__last") + gap).alias("session_end"), "events", "total_value")


def watermark_drops(records: DataFrame, event_ts: str, arrival_ts: str, trigger_seconds: int = 60,
                    delay_seconds: int = 30, keys=("topic",)) -> DataFrame:
    """T18 late data, batch rendering of micro-batch watermarks: records arrive in
    ``arrival_ts`` order in triggers of ``trigger_seconds``; the watermark of a
    trigger is the greatest event time of all earlier triggers minus the delay,
    and a record whose event time is older is dropped.  The per-trigger table
    (one row per trigger) carries the running maximum; records join back to it
    by trigger id, so no step orders the records themselves."""
    trig = F.floor(epoch_ms(arrival_ts) / (trigger_seconds * 1000)).cast("long")
    r = records.withColumn("__trigger", trig).withColumn("__ev", epoch_ms(event_ts))
    per_trigger = r.groupBy("__trigger").agg(F.max("__ev").alias("__max_ev"))
    from pyspark.sql import Window
    w = Window.orderBy("__trigger").rowsBetween(Window.unboundedPreceding, -1)
    marks = per_trigger.select("__trigger", (F.max("__max_ev").over(w) - delay_seconds * 1000).alias("__wm"))
    j = r.join(marks, "__trigger")
    late = F.coalesce(F.col("__ev") < F.col("__wm"), F.lit(False))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("arrived"), F.count_if(late).alias("dropped"),
                                F.max(F.when(late, (F.col("__wm") - F.col("__ev")) / 1000)).alias("max_late_seconds"))
