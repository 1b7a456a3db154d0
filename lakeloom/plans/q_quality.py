"""Registered validation, routing, redaction, enrichment and flow-health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import quality as G
from lakeloom.plans.registry import register
from lakeloom.sources.derived import flow_components, ws
from lakeloom.sources.tables import load

# Validation rule parameters of the registered query.
KNOWN_EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


@register("redact_json", views=("ws",), oracle=f"""
select trace_id, regexp_replace(metadata, '{G.redact_json_pattern()}', '\\1"{G.REDACTED}"', 'g') as metadata
from ws""")
def q_redact_json(s, d):
    w = ws(s, d)
    return w.select("trace_id", G.redact_json_scalars("metadata").alias("metadata"))


_TYPES_SQL = ", ".join(f"'{t}'" for t in KNOWN_EVENT_TYPES)


@register("validate_route", oracle=f"""
with v as (
  select event_id, event_type, value, list_filter([
      case when not coalesce(value >= 0, false) then 'value_non_negative' end,
      case when not coalesce(event_type in ({_TYPES_SQL}), false) then 'known_type' end,
      case when not coalesce(case when json_valid(props) then json_extract_string(props, '$.k') is not null
                                  else false end, false) then 'props_has_k' end,
      case when not coalesce(user_id is not null, false) then 'user_present' end], lambda x: x is not null) as errs
  from events)
select event_id, len(errs) = 0 as valid, array_to_string(errs, ';') as errors,
  case when len(errs) > 0 then 'dead_letter' when event_type = 'error' then 'alerts'
       when value > 50 then 'priority' else 'main' end as route
from v""")
def q_validate_route(s, d):
    e = load(s, d, "events")
    rules = [("value_non_negative", F.col("value") >= 0),
             ("known_type", F.col("event_type").isin(KNOWN_EVENT_TYPES)),
             ("props_has_k", F.get_json_object("props", "$.k").isNotNull()),
             ("user_present", F.col("user_id").isNotNull())]
    v = G.validate(e, rules)
    r = G.route(v, [("dead_letter", ~F.col("valid")), ("alerts", F.col("event_type") == "error"),
                    ("priority", F.col("value") > 50)], default="main")
    return r.select("event_id", "valid", F.concat_ws(";", "errors").alias("errors"), "route")


@register("flow_summary", views=("flow_components",), oracle="""
select count(*) filter (where kind = 'processor') as processor_count,
  count(*) filter (where kind = 'processor' and state = 'Running') as processors_running,
  count(*) filter (where kind = 'processor' and state = 'Stopped') as processors_stopped,
  count(*) filter (where kind = 'processor' and state = 'Invalid') as processors_invalid,
  count(*) filter (where kind = 'connection') as connection_count,
  cast(coalesce(sum(case when kind = 'connection' then queued_items end), 0) as bigint) as total_queued
from flow_components""")
def q_flow_summary(s, d):
    return G.flow_summary(flow_components(s, d))


@register("flow_health", views=("flow_components",), oracle="""
with g as (
  select count(*) filter (where kind = 'processor') as processors_total,
    count(*) filter (where kind = 'processor' and state = 'Running') as processors_running,
    count(*) filter (where kind = 'processor' and state = 'Stopped') as processors_stopped,
    count(*) filter (where kind = 'processor' and state = 'Invalid') as processors_invalid,
    count(*) filter (where kind = 'processor' and state = 'Disabled') as processors_disabled,
    count(*) filter (where kind = 'service') as services_total,
    count(*) filter (where kind = 'service' and state = 'Running') as services_enabled,
    count(*) filter (where kind = 'service' and state = 'Stopped') as services_disabled,
    count(*) filter (where kind = 'service' and state = 'Invalid') as services_invalid,
    count(*) filter (where kind = 'connection') as connections_total,
    count(*) filter (where kind = 'connection' and queued_items > 0) as connections_queued,
    count(*) filter (where kind = 'connection' and percent_use > 80) as connections_backpressure
  from flow_components)
select *, processors_invalid + services_invalid + connections_backpressure as errors,
  case when processors_invalid > 0 or services_invalid > 0 then 'UNHEALTHY'
       when connections_backpressure > 0 or processors_invalid + services_invalid + connections_backpressure > 0
       then 'DEGRADED' else 'HEALTHY' end as overall_health
from g""")
def q_flow_health(s, d):
    return G.flow_health(flow_components(s, d))


@register("enrich_lineitem", oracle="""
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, p.p_brand, p.p_type,
  'lakeloom' as app, 'test' as env
from lineitem l left join part p on l.l_partkey = p.p_partkey""")
def q_enrich_lineitem(s, d):
    li = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    part = load(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return G.add_metadata(G.enrich(li, part, "l_partkey"), app="lakeloom", env="test")


@register("flow_bulletins", oracle="""
select event_id as id, ts, 'ERROR' as level, concat('event ', cast(event_id as varchar), ' failed for user ',
  cast(user_id as varchar)) as message
from events where event_type = 'error' order by ts desc, event_id desc limit 10""")
def q_flow_bulletins(s, d):
    e = load(s, d, "events").filter(F.col("event_type") == "error")
    b = e.select(F.col("event_id").alias("id"), "ts", F.lit("ERROR").alias("level"),
                 F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" failed for user "),
                          F.col("user_id").cast("string")).alias("message"))
    return G.latest_bulletins(b)


@register("json_rendering", oracle="""
select cast(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, c_nationkey := c_nationkey,
  c_mktsegment := c_mktsegment)) as varchar) as value
from customer""")
def q_json_rendering(s, d):
    from lakeloom.sinks.tables import json_records
    c = load(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return json_records(c)


@register("pipe_rendering", oracle="""
select 0 as o, 'c_custkey | c_name | c_mktsegment' as value
union all
select 1 as o, concat_ws(' | ', coalesce(cast(c_custkey as varchar), ''), coalesce(c_name, ''),
  coalesce(c_mktsegment, '')) as value
from customer""")
def q_pipe_rendering(s, d):
    from lakeloom.sinks.tables import pipe_text
    return pipe_text(load(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@register("rows_as_json_arrays", oracle="""
select cast(to_json([cast(n_nationkey as varchar), n_name, cast(n_regionkey as varchar)]) as varchar) as "row"
from nation""")
def q_rows_as_json_arrays(s, d):
    from lakeloom.plans.catalog import rows_as_json
    return rows_as_json(load(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
