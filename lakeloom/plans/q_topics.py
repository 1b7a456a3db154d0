"""Registered landed-topic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalar import round6
from lakeloom.operators import topics as TP
from lakeloom.plans.registry import register
from lakeloom.sources.derived import consumed, replica, topic_messages
from lakeloom.sources.tables import load

# Alert policies of the registered query: (id, entity type, metric, op, threshold, enabled).
POLICIES = [("p-msgs-high", "topic", "messages", ">", 20.0, True),
            ("p-bytes-high", "topic", "bytes", ">=", 200.0, True),
            ("p-msgs-low", "topic", "messages", "<", 2.0, True),
            ("p-disabled", "topic", "messages", ">", 0.0, False)]
POLICY_SCHEMA = "policy_id string, entity_type string, metric string, op string, threshold double, enabled boolean"
_POLICY_SQL = ("select * from (values " + ", ".join(
    f"('{a}', '{b}', '{c}', '{d}', cast({e} as double), {str(f).lower()})" for a, b, c, d, e, f in POLICIES)
    + ") t(policy_id, entity_type, metric, op, threshold, enabled)")


@register("event_sample", oracle="""
with b as (
  select event_id, ts, user_id, event_type, value,
    row_number() over (partition by floor(epoch_ms(ts) / 1000) order by ts, event_id) as rn
  from events),
f as (select * from b where rn = 1 order by ts, event_id limit 100)
select event_id, ts, user_id, event_type, value from (select * from f order by ts desc, event_id desc limit 100) x""")
def q_event_sample(s, d):
    e = load(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return TP.sample_output(e, "ts", "event_id", *TP.SAMPLE_DEFAULT)


@register("event_sample_all", oracle="""
with f as (select event_id, ts, user_id, event_type, value from events order by ts, event_id limit 10000)
select * from (select * from f order by ts desc, event_id desc limit 10000) x""")
def q_event_sample_all(s, d):
    e = load(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return TP.sample_output(e, "ts", "event_id", *TP.SAMPLE_ALL)


@register("topic_metrics", views=("topic_messages",), oracle="""
select time_bucket(interval '1 hour', ts) as window_start,
  time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, topic,
  count(*) as messages, cast(sum(size_bytes) as bigint) as bytes,
  min(msg_offset) as min_offset, max(msg_offset) as max_offset
from topic_messages group by 1, 2, topic""")
def q_topic_metrics(s, d):
    return TP.windowed_metrics(topic_messages(s, d))


@register("partition_metrics_range", views=("topic_messages",), oracle="""
select time_bucket(interval '1 day', ts) as window_start,
  time_bucket(interval '1 day', ts) + interval '1 day' as window_end, topic, part_no,
  count(*) as messages, cast(sum(size_bytes) as bigint) as bytes,
  min(msg_offset) as min_offset, max(msg_offset) as max_offset
from topic_messages where ts >= timestamp '2024-01-03 00:00:00' and ts < timestamp '2024-01-10 00:00:00'
group by 1, 2, topic, part_no""")
def q_partition_metrics_range(s, d):
    import datetime as dt
    return TP.windowed_metrics(topic_messages(s, d), "1 day", ("topic", "part_no"),
                               from_ts=dt.datetime(2024, 1, 3), to_ts=dt.datetime(2024, 1, 10))


@register("consumer_lag", views=("topic_messages", "consumed"), oracle="""
with ends as (select topic, part_no, max(msg_offset) + 1 as end_offset from topic_messages group by 1, 2),
rd as (select c.group_id, m.topic, m.part_no, max(m.msg_offset) + 1 as committed_offset
       from consumed c join topic_messages m on c.msg_id = m.msg_id group by 1, 2, 3),
subs as (select distinct group_id, topic from consumed)
select s.group_id, s.topic, e.part_no, e.end_offset, coalesce(r.committed_offset, 0) as committed_offset,
  e.end_offset - coalesce(r.committed_offset, 0) as lag
from subs s join ends e on s.topic = e.topic
left join rd r on r.group_id = s.group_id and r.topic = s.topic and r.part_no = e.part_no""")
def q_consumer_lag(s, d):
    return TP.consumer_lag(topic_messages(s, d), consumed(s, d))


_LAT = """
select {keys}, count(*) as messages, round(avg(ms), 6) as avg_ms, max(ms) as max_ms,
  round(quantile_cont(ms, 0.5), 6) as p50_ms, round(quantile_cont(ms, 0.95), 6) as p95_ms,
  round(quantile_cont(ms, 0.99), 6) as p99_ms
from (select c.topic, c.group_id, cast(epoch_ms(c.consumed_at) - epoch_ms(m.ts) as double) as ms
      from topic_messages m join consumed c on m.msg_id = c.msg_id) x
group by {keys}"""


def _lat(s, d, keys):
    r = TP.latency(topic_messages(s, d, with_offsets=False), consumed(s, d), keys)
    return r.select(*keys, "messages", round6("avg_ms").alias("avg_ms"), F.col("max_ms").cast("double"),
                    *[round6(c).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")])


@register("e2e_latency", views=("topic_messages", "consumed"), oracle=_LAT.format(keys="topic"))
def q_e2e_latency(s, d):
    return _lat(s, d, ("topic",))


@register("e2e_latency_group", views=("topic_messages", "consumed"), oracle=_LAT.format(keys="topic, group_id"))
def q_e2e_latency_group(s, d):
    return _lat(s, d, ("topic", "group_id"))


@register("replication_gap", views=("topic_messages", "replica"), oracle="""
select coalesce(m.topic, r.topic) as topic, count(m.msg_id) as source_count, count(r.msg_id) as replica_count,
  count(*) filter (where r.msg_id is null) as missing,
  max(cast(epoch_ms(r.replicated_at) - epoch_ms(m.ts) as double)) as max_delay_ms
from topic_messages m full outer join replica r on m.msg_id = r.msg_id
group by 1""")
def q_replication_gap(s, d):
    r = TP.replication(topic_messages(s, d, with_offsets=False), replica(s, d))
    return r.withColumn("max_delay_ms", F.col("max_delay_ms").cast("double"))


_EDGES = """
select 'produces' as kind, producer_id as src, topic as dst, count(*) as messages
from topic_messages group by producer_id, topic
union all
select 'consumes' as kind, topic as src, group_id as dst, count(*) as messages
from consumed group by topic, group_id"""


@register("lineage_edges", views=("topic_messages", "consumed"), oracle=_EDGES)
def q_lineage_edges(s, d):
    return TP.lineage_edges(topic_messages(s, d, with_offsets=False), consumed(s, d))


@register("lineage_two_hops", views=("topic_messages", "consumed"), extra={"edges": _EDGES}, oracle="""
with h1 as (select * from edges where src = 'producer-1' or dst = 'producer-1'),
n1 as (select src as n from h1 union select dst from h1),
h2 as (select * from edges e where exists (select 1 from n1 where n1.n = e.src or n1.n = e.dst))
select distinct * from (select * from h1 union all select * from h2) x""")
def q_lineage_two_hops(s, d):
    edges = TP.lineage_edges(topic_messages(s, d, with_offsets=False), consumed(s, d))
    return TP.lineage_of(edges, "producer-1", hops=2)


@register("alerts", views=("topic_messages",), extra={"policies": _POLICY_SQL}, oracle="""
with m as (
  select time_bucket(interval '1 hour', ts) as window_start, topic,
    cast(count(*) as double) as messages, cast(sum(size_bytes) as double) as bytes
  from topic_messages group by 1, 2),
l as (select topic as entity, window_start, 'messages' as metric, messages as value from m
      union all select topic, window_start, 'bytes', bytes from m)
select concat_ws('|', p.policy_id, l.entity, strftime(l.window_start, '%Y-%m-%d %H:%M:%S')) as notification_id,
  p.policy_id, p.entity_type, l.entity, l.window_start, l.metric, l.value, p.threshold, false as is_read
from l join policies p on p.metric = l.metric
where p.enabled and case p.op when '>' then l.value > p.threshold when '>=' then l.value >= p.threshold
  when '<' then l.value < p.threshold when '<=' then l.value <= p.threshold
  when '=' then l.value = p.threshold else false end""")
def q_alerts(s, d):
    m = TP.windowed_metrics(topic_messages(s, d, with_offsets=False))
    policies = s.createDataFrame(POLICIES, POLICY_SCHEMA)
    return TP.alerts(m, policies)


@register("session_activity", oracle="""
with g as (
  select user_id, ts, value,
    case when lag(ts) over (partition by user_id order by ts, event_id) is null
           or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '30 minutes'
         then 1 else 0 end as brk,
    event_id
  from events),
s as (select *, sum(brk) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end,
  count(*) as events, round(sum(value), 6) as total_value
from s group by user_id, sid""")
def q_session_activity(s, d):
    r = TP.sessions(load(s, d, "events"))
    return r.withColumn("total_value", round6("total_value"))


@register("late_dropped", views=("consumed",), oracle="""
with r as (
  select topic, cast(floor(epoch_ms(consumed_at) / 60000) as bigint) as trig, epoch_ms(ts) as ev
  from consumed c join (select event_id, ts from events) e on c.msg_id = e.event_id),
pt as (select trig, max(ev) as max_ev from r group by trig),
m as (select trig, max(max_ev) over (order by trig rows between unbounded preceding and 1 preceding) - 30000 as wm
      from pt)
select topic, count(*) as arrived, count(*) filter (where ev < wm) as dropped,
  max(case when ev < wm then (wm - ev) / 1000.0 end) as max_late_seconds
from r join m using (trig) group by topic""")
def q_late_dropped(s, d):
    c = consumed(s, d)
    e = load(s, d, "events").select(F.col("event_id").alias("msg_id"), "ts")
    r = TP.watermark_drops(c.join(e, "msg_id"), "ts", "consumed_at", 60, 30)
    return r.withColumn("max_late_seconds", F.col("max_late_seconds").cast("double"))


@register("topic_read", views=("topic_messages",), oracle="""
select * from topic_messages where topic = 'click' and part_no = 1 and msg_offset >= 5
order by msg_offset limit 10""")
def q_topic_read(s, d):
    from lakeloom.sources.files import bounded_topic_read
    return bounded_topic_read(topic_messages(s, d), "click", 1, offset=5, limit=10)


@register("topic_offsets", views=("topic_messages",), oracle="""
select topic, part_no, min(msg_offset) as begin_offset, max(msg_offset) + 1 as end_offset
from topic_messages group by topic, part_no""")
def q_topic_offsets(s, d):
    from lakeloom.sources.files import partition_offsets
    return partition_offsets(topic_messages(s, d))


@register("producer_metrics", views=("topic_messages",), oracle="""
select time_bucket(interval '1 day', ts) as window_start,
  time_bucket(interval '1 day', ts) + interval '1 day' as window_end, producer_id,
  count(*) as messages, cast(sum(size_bytes) as bigint) as bytes
from topic_messages group by 1, 2, producer_id""")
def q_producer_metrics(s, d):
    return TP.windowed_metrics(topic_messages(s, d, with_offsets=False), "1 day", ("producer_id",))
