"""Registered streaming queries: each runs a Structured Streaming job over a file
stream of a driver table (trigger ``availableNow``) into the shared checkpoint
folder, then reads its sink back as a batch DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.plans.registry import register
from lakeloom.sources.tables import load
from lakeloom.streaming.state import read_materialized_view, start_materialized_view
from lakeloom.streaming.topics import event_time, start_stream_job


def events_stream(s, d, max_files_per_trigger: int | None = None):
    schema = load(s, d, "events").schema
    # the file source watches a folder; the glob keeps it to the one table
    r = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(d)


@register("stream_filter", oracle="""
select event_id, user_id, event_type, value, ts from events where value > 50""")
def q_stream_filter(s, d):
    view = f"events_stream_{uuid.uuid4().hex[:8]}"
    events_stream(s, d).createOrReplaceTempView(view)
    job = start_stream_job(s, f"stream_filter_{uuid.uuid4().hex[:8]}",
                           f"SELECT event_id, user_id, event_type, value, ts FROM {view} WHERE value > 50")
    job.query.awaitTermination()
    return s.read.schema("event_id long, user_id long, event_type string, value double, ts timestamp_ntz"
                         ).parquet(job.sink_path)


@register("stream_latest_state", oracle="""
select user_id, event_id, event_type, value, ts from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) x
where rn = 1""")
def q_stream_latest_state(s, d):
    stream = event_time(events_stream(s, d), "ts").select("user_id", "event_id", "event_type", "value", "ts")
    q, path = start_materialized_view(stream, ["user_id"], ["ts", "event_id"], name=f"mv_{uuid.uuid4().hex[:8]}")
    q.awaitTermination()
    mv = read_materialized_view(s, path, ["user_id"], ["ts", "event_id"])
    return mv.select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("stream_topic_metrics", oracle="""
select time_bucket(interval '1 hour', ts) as window_start, event_type as topic, count(*) as messages,
  cast(sum(length(props)) as bigint) as bytes
from events group by 1, 2""")
def q_stream_topic_metrics(s, d):
    """T10 as a stateful stream: hourly windows per topic with a watermark, update
    mode into the changelog view; the view's final state is the batch answer."""
    stream = event_time(events_stream(s, d), "ts").withWatermark("ts", "1 hour")
    agg = (stream.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("topic"))
           .agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("props")).cast("long").alias("bytes"))
           .select(F.col("w.start").alias("window_start"), "topic", "messages", "bytes"))
    q, path = start_materialized_view(agg, ["window_start", "topic"], [], name=f"mvw_{uuid.uuid4().hex[:8]}",
                                      output_mode="update")
    q.awaitTermination()
    mv = read_materialized_view(s, path, ["window_start", "topic"], [])
    return mv.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "topic", "messages", "bytes")


# oracle: the batch fold's SQL (attached in registry.load_all)
@register("stream_status_machine")
def q_stream_status_machine(s, d):
    """T9 as a stateful stream: the derived status log is landed in the shared
    folder and streamed in several micro-batches; the per-trace aggregate runs in
    the JVM state store (update mode) into the changelog view, and the status
    rule is applied to the view's final state.  (``streaming.state.status_machine``
    adds the event-time timeout of the poller, in Python, for live streams.)"""
    from lakeloom.operators.upsert import decide_status, status_aggregates
    from lakeloom.session import scratch_path
    from lakeloom.sources.derived import view
    from lakeloom.streaming.topics import file_stream
    ev = view(s, d, "status_events")
    landed = scratch_path(s, "status_log")
    ev.repartitionByRange(2, "at").write.parquet(landed)
    stream = event_time(file_stream(s, landed, "parquet", ev.schema, max_files_per_trigger=1), "at")
    agg = status_aggregates(stream.withWatermark("at", "36500 days"))
    q, path = start_materialized_view(agg, ["trace_id"], [], name=f"status_{uuid.uuid4().hex[:8]}",
                                      output_mode="update")
    q.awaitTermination()
    state = read_materialized_view(s, path, ["trace_id"], []).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("start", "t_kick", "t_err", "t_last")})
    return decide_status(state)


# oracle: the batch consumer_lag SQL (attached in registry.load_all)
@register("stream_consumer_lag")
def q_stream_consumer_lag(s, d):
    """T11 on streams: produced messages (with offsets) and consumed reads are
    landed in the shared folder and streamed; each side is a stateful max-offset
    aggregate (update mode) in a changelog view, and lag is read from the views."""
    from lakeloom.session import scratch_path
    from lakeloom.sources.derived import consumed, topic_messages
    from lakeloom.streaming.topics import file_stream
    msgs = topic_messages(s, d).select("msg_id", "topic", "part_no", "msg_offset")
    reads = consumed(s, d).select("msg_id", "group_id").join(msgs, "msg_id")
    land_m, land_r = scratch_path(s, "lag_msgs"), scratch_path(s, "lag_reads")
    msgs.repartition(2).write.parquet(land_m)
    reads.repartition(2).write.parquet(land_r)
    ends = (file_stream(s, land_m, "parquet", msgs.schema, max_files_per_trigger=1)
            .groupBy("topic", "part_no").agg((F.max("msg_offset") + 1).alias("end_offset")))
    done = (file_stream(s, land_r, "parquet", reads.schema, max_files_per_trigger=1)
            .groupBy("group_id", "topic", "part_no").agg((F.max("msg_offset") + 1).alias("committed_offset")))
    tag = uuid.uuid4().hex[:8]
    q1, p1 = start_materialized_view(ends, ["topic", "part_no"], [], name=f"lag_e_{tag}", output_mode="update")
    q2, p2 = start_materialized_view(done, ["group_id", "topic", "part_no"], [], name=f"lag_c_{tag}",
                                     output_mode="update")
    q1.awaitTermination()
    q2.awaitTermination()
    e = read_materialized_view(s, p1, ["topic", "part_no"], [])
    c = read_materialized_view(s, p2, ["group_id", "topic", "part_no"], [])
    subs = c.select("group_id", "topic").distinct()
    j = subs.join(e, "topic").join(c, ["group_id", "topic", "part_no"], "left")
    return j.select("group_id", "topic", "part_no", "end_offset",
                    F.coalesce("committed_offset", F.lit(0)).alias("committed_offset"),
                    (F.col("end_offset") - F.coalesce("committed_offset", F.lit(0))).alias("lag"))
