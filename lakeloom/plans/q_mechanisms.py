"""Registered queries of the bucketed keyed tables, exactly-once sinks, schema-less redaction, weight
search, interval joins, lineage closure, stored sketches, indexed substring search and latency on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import intervals as IV
from lakeloom.operators import lineage as LN
from lakeloom.operators import sketches as SK
from lakeloom.operators import weights as W
from lakeloom.operators.redaction import redact_any_json
from lakeloom.operators.quality import REDACTED
from lakeloom.plans.q_writes import CDC_FEED_SQL, cdc_feed
from lakeloom.plans.registry import register
from lakeloom.session import scratch_path
from lakeloom.operators.text_index import TextIndex
from lakeloom.sources.derived import consumed, topic_messages, view
from lakeloom.sources.tables import load

BUCKETS = 16


def _keyed(s, d):
    from lakeloom.sinks.keyed import KeyedTable
    table = KeyedTable(s, scratch_path(s, "keyed"))
    table.create(view(s, d, "upsert_target"), ["k"], BUCKETS)
    return table


@register("keyed_upsert", views=("upsert_target", "upsert_batch"), oracle="""
with b as (select k, status, amount from (
    select *, row_number() over (partition by k order by seq desc) as rn from upsert_batch) x where rn = 1)
select k, status, amount from b
union all
select t.k, t.status, t.amount from upsert_target t where not exists (select 1 from b where b.k = t.k)""")
def q_keyed_upsert(s, d):
    """M4 into a bucketed keyed table: only touched buckets are rewritten, then read back."""
    table = _keyed(s, d)
    table.upsert(view(s, d, "upsert_batch"), order="seq")
    return table.read()


@register("keyed_partial_update", views=("upsert_target", "upsert_batch"), oracle="""
with b as (select k, status from (
    select *, row_number() over (partition by k order by seq desc) as rn from upsert_batch) x where rn = 1)
select coalesce(b.k, t.k) as k, case when b.k is not null then b.status else t.status end as status, t.amount
from upsert_target t full outer join b on t.k = b.k""")
def q_keyed_partial_update(s, d):
    """M7 into a bucketed keyed table."""
    table = _keyed(s, d)
    table.upsert(view(s, d, "upsert_batch").select("k", "seq", "status"), order="seq")
    return table.read()


@register("keyed_changes", views=("upsert_target",), extra={"cdc_feed": CDC_FEED_SQL}, oracle="""
with c as (select * from (
    select *, row_number() over (partition by k order by seq desc) as rn from cdc_feed) x where rn = 1)
select k, status, amount from c where op <> 'delete'
union all
select t.k, t.status, t.amount from upsert_target t where not exists (select 1 from c where c.k = t.k)""")
def q_keyed_changes(s, d):
    """M8 into a bucketed keyed table."""
    table = _keyed(s, d)
    table.apply_changes(cdc_feed(s, d), order="seq")
    return table.read()


@register("exactly_once_sink", oracle="""
select case when value > 1 and user_id is not null then 'rows' else 'dead' end as kind, event_type, count(*) as n,
  cast(sum(event_id) as bigint) as ids
from events group by 1, 2""")
def q_exactly_once_sink(s, d):
    """The events as a stream, every micro-batch written twice by the sink, counted from what readers see."""
    from lakeloom.sinks.once import FileSink, by_validity, replayed
    from lakeloom.streaming.topics import file_stream
    events = load(s, d, "events")
    path = scratch_path(s, "once")
    sink = FileSink(s, f"{path}/sink", by_validity((F.col("value") > 1) & F.col("user_id").isNotNull()))
    q = (file_stream(s, d, "parquet", events.schema, file_pattern="events.parquet").writeStream.foreachBatch(replayed(sink.write))
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    both = sink.read("rows").select(F.lit("rows").alias("kind"), "event_type", "event_id").union(sink.read("dead").select(F.lit("dead").alias("kind"), "event_type", "event_id"))
    return both.groupBy("kind", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_NESTED = """concat('{{"id": ', cast(o_orderkey as varchar), ', "auth": {{"Token": {token}, "user": "c', cast(o_custkey as varchar),
  '"}}, "items": [{{"secret": {secret}, "note": "password: \\"', o_orderpriority, '\\""}}, [{{"pass\\u0077ord": {word}}}]], "status": "', o_orderstatus, '"}}')"""
_CUT = f'"{REDACTED}"'


@register("redact_json_nested", oracle=f"""
select o_orderkey, {_NESTED.format(token=_CUT, secret=_CUT, word=_CUT)} as doc from orders""")
def q_redact_json_nested(s, d):
    """G1 on nested text without a schema: objects, lists, numbers and escaped key names."""
    o = load(s, d, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    doc = F.concat(F.lit('{"id": '), key, F.lit(', "auth": {"Token": {"v": ['), cust, F.lit(', {"w": "}"}]}, "user": "c'), cust,
                   F.lit('"}, "items": [{"secret": '), key, F.lit(', "note": "password: \\"'), F.col("o_orderpriority"),
                   F.lit('\\""}, [{"pass\\u0077ord": [null, "x]"]}]], "status": "'), F.col("o_orderstatus"), F.lit('"}'))
    return o.select("o_orderkey", redact_any_json(doc).alias("doc"))


_PORTFOLIOS = """
p as (select concat('p', cast(user_id % 8 as varchar)) as portfolio, cast(ts as date) as dt, event_type as symbol, floor(max(value)) + 1 as price from events group by 1, 2, 3),
full_days as (select portfolio, dt from p group by portfolio, dt
  having count(*) = (select count(distinct x.symbol) from p x where x.portfolio = p.portfolio)),
used as (select portfolio, count(*) as days from full_days group by portfolio having count(*) >= 3)"""


def portfolio_prices(s, d):
    """Daily prices of the symbols in eight portfolios, users dealt to them by number."""
    e = load(s, d, "events")
    return e.groupBy(F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("portfolio"), F.col("ts").cast("date").alias("dt"),
                     F.col("event_type").alias("symbol")).agg((F.floor(F.max("value")) + 1).cast("long").alias("price"))


@register("optimal_weights", oracle=f"""
with {_PORTFOLIOS}
select portfolio, (select count(distinct symbol) from p where p.portfolio = used.portfolio) as symbols, true as sums_to_one, true as stationary, true as beats_equal
from used""")
def q_optimal_weights(s, d):
    """V6: continuous weights of every portfolio; the conditions of the maximum are checked from the statistics."""
    by = ["portfolio"]
    rets = W.portfolio_returns(portfolio_prices(s, d), by)
    pairs = W.moments(rets, by).where(F.col("cov").isNotNull() & ~F.isnan("cov"))
    found = W.optimal_weights(rets, by).where("ret is not null")
    checked = W.optimality(pairs, found, by)
    equal = pairs.groupBy(*by).agg((F.avg("cov") * 252).alias("var"), (F.avg("mean_a") * 252).alias("gain"))
    ratio = found.groupBy(*by).agg(F.max("sharpe").alias("sharpe"))
    rows = checked.join(equal, by).join(ratio, by)
    beats = F.col("sharpe").isNull() | (F.col("sharpe") >= F.col("gain") / F.sqrt("var") - 1e-9)
    return rows.select("portfolio", "symbols", (F.abs(F.col("weights_sum") - 1) < 1e-9).alias("sums_to_one"), "stationary", beats.alias("beats_equal"))


def event_spans(s, d):
    """Every event as a run that lasts ``value`` minutes, in whole seconds."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    return load(s, d, "events").select("event_id", "user_id", "event_type", at.alias("lo"), (at + F.floor(F.col("value") * 60).cast("long")).alias("hi"))


@register("overlapping_runs", oracle="""
with s as (select event_id, user_id, cast(floor(epoch_us(ts) / 1000000) as bigint) as lo,
             cast(floor(epoch_us(ts) / 1000000) as bigint) + cast(floor(value * 60) as bigint) as hi from events)
select a.event_id as a, b.event_id as b, greatest(a.lo, b.lo) as from_second, least(a.hi, b.hi) as to_second
from s a join s b on a.user_id = b.user_id and a.event_id < b.event_id
where a.lo < a.hi and b.lo < b.hi and a.lo < b.hi and b.lo < a.hi""")
def q_overlapping_runs(s, d):
    """Pairs of one user's runs that overlap, by dyadic blocks."""
    e = event_spans(s, d)
    pairs = IV.overlap_join(e, e, "lo", "hi", ["user_id"]).where("l.event_id < r.event_id")
    return pairs.select(F.col("l.event_id").alias("a"), F.col("r.event_id").alias("b"), F.greatest("l.lo", "r.lo").alias("from_second"), F.least("l.hi", "r.hi").alias("to_second"))


@register("open_runs_peak", oracle="""
with s as (select event_type, cast(floor(epoch_us(ts) / 1000000) as bigint) as lo,
             cast(floor(epoch_us(ts) / 1000000) as bigint) + cast(floor(value * 60) as bigint) as hi from events),
c as (select event_type, t, sum(d) as d from (select event_type, lo as t, 1 as d from s where lo < hi
        union all select event_type, hi, -1 from s where lo < hi) x group by event_type, t),
o as (select event_type, t, sum(d) over (partition by event_type order by t) as open from c),
days as (select distinct event_type, t // 86400 as period_no from o)
select d.event_type, d.period_no, cast(max(o.open) as bigint) as peak
from days d join (select event_type, t, open, coalesce(lead(t) over (partition by event_type order by t), t + 1) as until from o) o
  on o.event_type = d.event_type and o.t < (d.period_no + 1) * 86400 and o.until > d.period_no * 86400
group by 1, 2""")
def q_open_runs_peak(s, d):
    """The most runs open at once, by event type and day."""
    return IV.peaks(event_spans(s, d), "lo", "hi", 86400, ["event_type"])


def lineage_graph(s, d):
    """Users feed producers, producers write partitions, groups read them, and a group's reads come back to the producers it reads."""
    msgs, reads = topic_messages(s, d, with_offsets=False), consumed(s, d)
    parts = LN.partition_edges(msgs, reads)
    one = F.count(F.lit(1)).alias("messages")
    users = load(s, d, "events").groupBy(F.lit("feeds").alias("kind"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("src"),
                                         F.concat(F.lit("producer-"), (F.col("user_id") % 6).cast("string")).alias("dst")).agg(one)
    back = reads.select("msg_id", "group_id").join(msgs.select("msg_id", "producer_id"), "msg_id").groupBy(
        F.lit("answers").alias("kind"), F.col("group_id").alias("src"), F.col("producer_id").alias("dst")).agg(one)
    return parts.union(users).union(back)


_GRAPH = """
select 'produces' as kind, producer_id as src, concat_ws('/', topic, cast(part_no as varchar)) as dst, count(*) as messages from topic_messages group by 2, 3
union all select 'part_of', concat_ws('/', topic, cast(part_no as varchar)), topic, count(*) from topic_messages group by 2, 3
union all select 'consumes', concat_ws('/', topic, cast(part_no as varchar)), group_id, count(*) from consumed group by 2, 3
union all select 'feeds', concat('user-', cast(user_id as varchar)), concat('producer-', cast(user_id % 6 as varchar)), count(*) from events group by 2, 3
union all select 'answers', c.group_id, m.producer_id, count(*) from consumed c join topic_messages m on c.msg_id = m.msg_id group by 2, 3"""


@register("lineage_edges_all", views=("topic_messages", "consumed"), extra={"graph": _GRAPH}, oracle="select kind, src, dst, messages from graph")
def q_lineage_edges_all(s, d):
    """Edges of users, producers, topic partitions, topics and consumer groups."""
    return lineage_graph(s, d)


@register("lineage_closure", views=("topic_messages", "consumed"), extra={"graph": _GRAPH}, oracle="""
with recursive r as (
  select distinct src as root, src as node, 0 as hops from graph where kind = 'feeds'
  union
  select r.root, g.dst, r.hops + 1 from r join graph g on g.src = r.node where r.hops < 9)
select root, node, cast(min(hops) as int) as hops from r group by root, node""")
def q_lineage_closure(s, d):
    """All that each user's messages reach, with the fewest hops; the graph has cycles."""
    graph = lineage_graph(s, d)
    return LN.reachable(graph, graph.where("kind = 'feeds'").select("src"), "down")


@register("rolled_up_users", oracle="""
with days as (select event_type, cast(ts as date) as day, user_id from events where user_id is not null)
select event_type, count(distinct day) as days, true as theta_holds, true as hll_holds, true as shared_holds, true as own_holds from days group by event_type""")
def q_rolled_up_users(s, d):
    """Distinct users per event type from stored daily sketches, and users shared with (or not among) all users of clicks; each
    estimate within four standard deviations of the exact count."""
    e = load(s, d, "events").where("user_id is not null")
    daily = SK.daily_sketches(e, "ts", ["event_type"], "user_id")
    path = scratch_path(s, "sketches")
    daily.write.parquet(path)
    daily = s.read.parquet(path)
    rolled = SK.roll_up(daily, ["event_type"])
    clicks = SK.roll_up(daily.where("event_type = 'click'"), []).select(F.col("theta").alias("clicks"))
    users = e.select("event_type", "user_id").distinct()
    clicked = users.where("event_type = 'click'").select("user_id", F.lit(1).alias("clicked"))
    exact = users.join(clicked, "user_id", "left").groupBy("event_type").agg(F.count("*").alias("n"), F.count("clicked").alias("shared"))
    n_clicks = clicked.agg(F.count("*").alias("n_clicks"))
    rows = rolled.join(exact, "event_type").join(daily.groupBy("event_type").agg(F.count_distinct("day").alias("days")), "event_type")
    rows = rows.join(F.broadcast(clicks.join(F.broadcast(n_clicks), F.lit(True))), F.lit(True), "left")          # one row
    union = F.col("n") + F.coalesce("n_clicks", F.lit(0))
    none = F.theta_sketch_estimate(F.theta_difference("theta", "theta"))
    shared = F.coalesce(SK.both(F.col("theta"), F.col("clicks")), none)
    own = F.coalesce(SK.only_first(F.col("theta"), F.col("clicks")), F.theta_sketch_estimate("theta"))
    def near(x, exactly, of=None):
        return F.abs(x - exactly) <= SK.bound(exactly, of=of)
    return rows.select("event_type", "days", near(F.theta_sketch_estimate("theta"), F.col("n")).alias("theta_holds"), near(F.hll_sketch_estimate("hll"), F.col("n")).alias("hll_holds"),
                       near(shared, F.col("shared"), union).alias("shared_holds"), near(own, F.col("n") - F.col("shared"), union).alias("own_holds"))


_PATTERNS = """
select concat(form, '-', cast(n_nationkey as varchar)) as pattern_id,
  case form when 'inner' then concat('_', cast(n_nationkey as varchar), '1', cast(n_nationkey as varchar))
            when 'wild' then concat('E\\_', cast(n_nationkey as varchar), '%', cast(n_nationkey as varchar), '.C')
            when 'one' then concat('\\_', cast(n_nationkey as varchar), '_.csv')
            when 'whole' then concat('file\\_', cast(n_nationkey * 37 as varchar), '.CSV')
            else concat(n_name, '%') end as pattern
from nation cross join (values ('inner'), ('wild'), ('one'), ('whole'), ('none')) f(form)"""


def search_patterns(s, d):
    """Five patterns of each nation: literals, wildcards, escapes, mixed case, and names that no file has."""
    k = F.col("n_nationkey").cast("string")
    forms = {"inner": F.concat(F.lit("_"), k, F.lit("1"), k), "wild": F.concat(F.lit("E\\_"), k, F.lit("%"), k, F.lit(".C")),
             "one": F.concat(F.lit("\\_"), k, F.lit("_.csv")), "whole": F.concat(F.lit("file\\_"), (F.col("n_nationkey") * 37).cast("string"), F.lit(".CSV")),
             "none": F.concat("n_name", F.lit("%"))}
    rows = F.array(*[F.struct(F.concat(F.lit(f"{name}-"), k).alias("pattern_id"), p.alias("pattern")) for name, p in forms.items()])
    return load(s, d, "nation").select(F.inline(rows))


@register("search_files_indexed", views=("fps",), extra={"patterns": _PATTERNS}, oracle="""
select p.pattern_id, f.id, f.file_name, f.file_type from fps f join patterns p on f.file_name ilike concat('%', p.pattern, '%') escape '\\'""")
def q_search_files_indexed(s, d):
    """Many patterns at once by an index of pieces, every match of each."""
    files = view(s, d, "fps").select("id", "file_name", "file_type")
    return TextIndex.build(files, "file_name", scratch_path(s, "text_index")).search(search_patterns(s, d))


@register("stream_latency", views=("topic_messages", "consumed"), oracle="""
select c.topic, c.group_id, count(*) as messages, max(epoch_ms(c.consumed_at) - epoch_ms(m.ts)) as max_ms,
  cast(sum(epoch_ms(c.consumed_at) - epoch_ms(m.ts)) as bigint) as total_ms, true as p50_holds, true as p95_holds, true as p99_holds
from topic_messages m join consumed c on m.msg_id = c.msg_id group by 1, 2""")
def q_stream_latency(s, d):
    """T12 on streams: a stream-stream join into sketches, merged over all windows; each percentile's rank is checked against the exact latencies."""
    from lakeloom.operators.topics import epoch_ms
    from lakeloom.plans.q_streaming import events_stream
    from lakeloom.streaming.latency import RANK_ERROR, read_latency, start_latency
    from lakeloom.streaming.topics import event_time
    made = event_time(events_stream(s, d), "ts").select(F.col("event_id").alias("msg_id"), "ts")
    reads = event_time(events_stream(s, d), "ts").where("event_id % 10 < 8").select(
        F.col("event_id").alias("msg_id"), F.col("event_type").alias("topic"), F.when(F.col("event_id") % 2 == 0, "group-a").otherwise("group-b").alias("group_id"),
        F.expr("ts + (event_id % 50) * interval '1' second").alias("consumed_at"))
    path, keys = scratch_path(s, "latency"), ["topic", "group_id"]
    start_latency(made, reads, path, keys=keys).awaitTermination()
    told = read_latency(s, path, keys).drop("sketch")
    exact = consumed(s, d).join(topic_messages(s, d, with_offsets=False).select("msg_id", "ts"), "msg_id").withColumn("ms", F.round(epoch_ms("consumed_at") - epoch_ms("ts")).cast("long"))
    counts = exact.groupBy(*keys, "ms").agg(F.count("*").alias("n")).join(told, keys)
    holds = []
    for p in (50, 95, 99):
        below, upto = (F.sum(F.when(test, F.col("n")).otherwise(0)) for test in (F.col("ms") < F.col(f"p{p}_ms"), F.col("ms") <= F.col(f"p{p}_ms")))
        total = F.sum("n")
        holds.append(((below <= (p / 100 + RANK_ERROR) * total) & (upto >= (p / 100 - RANK_ERROR) * total)).alias(f"p{p}_holds"))
    return counts.groupBy(*keys, "messages", "max_ms", F.round(F.col("avg_ms") * F.col("messages")).cast("long").alias("total_ms")).agg(*holds)
