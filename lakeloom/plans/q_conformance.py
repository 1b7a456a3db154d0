"""Registered SQL-surface queries: semi/anti/as-of/band joins, grouping sets,
ranks and analytics, set operations, approximate distinct (J8, A20, W6, U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalar import round6
from lakeloom.operators.joins import asof_join, ordered_analytics, range_frame_sums
from lakeloom.operators.scan import grouped_rank, grouped_running
from lakeloom.plans.registry import register
from lakeloom.sources.tables import load


@register("join_semi", oracle="""
select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey)""")
def q_join_semi(s, d):
    c, o = load(s, d, "customer"), load(s, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@register("join_anti", oracle="""
select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)""")
def q_join_anti(s, d):
    c, o = load(s, d, "customer"), load(s, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@register("join_asof", oracle="""
with l as (
  select li.l_orderkey, li.l_linenumber, li.l_shipdate, o.o_custkey as cust
  from lineitem li join orders o on li.l_orderkey = o.o_orderkey),
u as (
  select cust, l_shipdate as t, 1 as side, cast(null as bigint) as tie, l_orderkey, l_linenumber, l_shipdate,
    cast(null as bigint) as r_key, cast(null as timestamp) as r_date, cast(null as double) as r_price
  from l
  union all
  select o_custkey, o_orderdate, 0, o_orderkey, null, null, null, o_orderkey, o_orderdate, o_totalprice from orders),
f as (
  select *,
    last_value(r_key ignore nulls) over w as k, last_value(r_date ignore nulls) over w as dte,
    last_value(r_price ignore nulls) over w as p
  from u window w as (partition by cust order by t, side, tie rows between unbounded preceding and current row))
select l_orderkey, l_linenumber, l_shipdate, cust, k as asof_o_orderkey, dte as asof_o_orderdate,
  p as asof_o_totalprice
from f where side = 1""")
def q_join_asof(s, d):
    li, o = load(s, d, "lineitem"), load(s, d, "orders")
    left = li.join(o.select("o_orderkey", F.col("o_custkey").alias("cust")), li["l_orderkey"] == o["o_orderkey"]
                   ).select("l_orderkey", "l_linenumber", "l_shipdate", "cust")
    right = o.select(F.col("o_custkey").alias("cust"), "o_orderkey", "o_orderdate", "o_totalprice")
    return asof_join(left, right, ["cust"], "l_shipdate", "o_orderdate",
                     ["o_orderkey", "o_orderdate", "o_totalprice"], tie="o_orderkey")


@register("join_range", oracle="""
select p.user_id, p.event_id, count(v.event_id) as matches, sum(v.value) as view_value
from events p left join events v
  on v.user_id = p.user_id and v.event_type = 'view' and v.ts >= p.ts - interval '1 hour' and v.ts < p.ts
where p.event_type = 'purchase'
group by p.user_id, p.event_id""")
def q_join_range(s, d):
    e = load(s, d, "events")
    purchases = e.filter(F.col("event_type") == "purchase").select("user_id", "event_id", "ts")
    views = e.filter(F.col("event_type") == "view").select("user_id", "ts", "value", "event_id")
    r = range_frame_sums(purchases, ["user_id"], "ts", "event_id",
                         {"matches": F.lit(1).cast("long"), "view_value": F.col("value")}, 3600,
                         include_current=False, data=views, data_id="event_id")
    # a purchase with no view in the band has a NULL sum, like SUM over no rows
    return r.select("user_id", "event_id", "matches",
                    F.when(F.col("matches") > 0, F.col("view_value")).alias("view_value"))


_GROUPING = """
select l_returnflag, l_linestatus, cast(grouping(l_returnflag, l_linestatus) as bigint) as gid,
  sum(l_quantity) as sum_qty, count(*) as n,
  cast(sum(round(l_discount * 100)) as bigint) as sum_disc_pct
from lineitem group by {spec}"""


def _grouped(s, d, how):
    li = load(s, d, "lineitem")
    if how == "rollup":
        g = li.rollup("l_returnflag", "l_linestatus")
    elif how == "cube":
        g = li.cube("l_returnflag", "l_linestatus")
    else:
        g = li.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus")
    return g.agg(F.grouping_id("l_returnflag", "l_linestatus").cast("long").alias("gid"),
                 F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"),
                 F.sum(F.round(F.col("l_discount") * 100)).cast("long").alias("sum_disc_pct"))


@register("rollup_sales", oracle=_GROUPING.format(spec="rollup (l_returnflag, l_linestatus)"))
def q_rollup_sales(s, d):
    return _grouped(s, d, "rollup")


@register("cube_sales", oracle=_GROUPING.format(spec="cube (l_returnflag, l_linestatus)"))
def q_cube_sales(s, d):
    return _grouped(s, d, "cube")


@register("grouping_sets_sales",
          oracle=_GROUPING.format(spec="grouping sets ((l_returnflag), (l_linestatus), ())"))
def q_grouping_sets_sales(s, d):
    return _grouped(s, d, "sets")


@register("rank_parts", oracle="""
select p_partkey, p_brand, p_retailprice,
  rank() over (partition by p_brand order by p_retailprice desc) as rnk,
  dense_rank() over (partition by p_brand order by p_retailprice desc) as drnk,
  row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn
from part""")
def q_rank_parts(s, d):
    p = load(s, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    desc = [(-F.col("p_retailprice")).alias("neg_price")]
    r = grouped_rank(p, ["p_brand"], desc, "rnk", "rank")
    r = grouped_rank(r, ["p_brand"], desc, "drnk", "dense_rank")
    return grouped_rank(r, ["p_brand"], desc + [F.col("p_partkey")], "rn", "row_number")


@register("running_sum", oracle="""
select o_custkey, o_orderkey, o_orderdate,
  round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey
                                rows between unbounded preceding and current row), 6) as running_total,
  count(*) over (partition by o_custkey order by o_orderdate, o_orderkey
                 rows between unbounded preceding and current row) as running_orders
from orders""")
def q_running_sum(s, d):
    o = load(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    r = grouped_running(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")],
                        {"running_total": F.col("o_totalprice"), "running_orders": F.lit(1).cast("long")})
    return r.select("o_custkey", "o_orderkey", "o_orderdate", round6("running_total").alias("running_total"),
                    "running_orders")


@register("analytic_orders", oracle="""
select o_orderkey, o_custkey, rn, o_totalprice, lag_value, lead_value, first_value, ntile, cnt from (
  select o_orderkey, o_custkey, o_totalprice,
    row_number() over w as rn, lag(o_totalprice) over w as lag_value, lead(o_totalprice) over w as lead_value,
    first_value(o_totalprice) over w as first_value, ntile(4) over w as ntile,
    count(*) over (partition by o_custkey) as cnt
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) x""")
def q_analytic_orders(s, d):
    o = load(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return ordered_analytics(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice",
                             tiles=4, id_cols=["o_orderkey"])


_SET_A = "select o_custkey from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'"
_SET_B = "select o_custkey from orders where o_totalprice > 250000"


def _sets(s, d):
    o = load(s, d, "orders")
    a = o.filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
                 & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_custkey")
    b = o.filter(F.col("o_totalprice") > 250000).select("o_custkey")
    return a, b


@register("set_union", oracle=f"{_SET_A} union {_SET_B}")
def q_set_union(s, d):
    a, b = _sets(s, d)
    return a.union(b).distinct()


@register("set_intersect", oracle=f"{_SET_A} intersect {_SET_B}")
def q_set_intersect(s, d):
    a, b = _sets(s, d)
    return a.intersect(b)


@register("set_except", oracle=f"{_SET_A} except {_SET_B}")
def q_set_except(s, d):
    a, b = _sets(s, d)
    return a.subtract(b)


@register("set_except_all", oracle=f"{_SET_A} except all {_SET_B}")
def q_set_except_all(s, d):
    a, b = _sets(s, d)
    return a.exceptAll(b)


@register("set_intersect_all", oracle=f"{_SET_A} intersect all {_SET_B}")
def q_set_intersect_all(s, d):
    a, b = _sets(s, d)
    return a.intersectAll(b)


# HyperLogLog++ estimate: compared on row count only (tests check it against the exact count)
@register("approx_users")
def q_approx_users(s, d):
    e = load(s, d, "events")
    return e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("approx_users"))


@register("percentiles_value", oracle="""
select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90,
  having_n from (select *, count(*) over (partition by event_type) as having_n from events) x
group by event_type, having_n having count(*) > 100""")
def q_percentiles_value(s, d):
    e = load(s, d, "events")
    from lakeloom.operators.stats import exact_percentiles
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("having_n")).filter(F.col("having_n") > 100)
    p = exact_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9})
    return n.join(p, "event_type").select("event_type", round6("p50").alias("p50"), round6("p90").alias("p90"),
                                          "having_n")


@register("rolling_hour_value", oracle="""
select user_id, event_id,
  count(*) over w as matches,
  round(sum(value) over w, 6) as value_sum
from events
window w as (partition by user_id order by ts range between interval '1 hour' preceding and current row)""")
def q_rolling_hour_value(s, d):
    e = load(s, d, "events").select("user_id", "event_id", "ts", "value")
    r = range_frame_sums(e, ["user_id"], "ts", "event_id",
                         {"matches": F.lit(1).cast("long"), "value_sum": F.col("value")}, 3600)
    return r.select("user_id", "event_id", "matches", round6("value_sum").alias("value_sum"))
