"""Registered file-query, chart, pivot and URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalar import round6, url_file_name, url_last_segment
from lakeloom.operators.query_builder import FileQuery, Filter, chart_aggregate, pivot_counts, run_file_query
from lakeloom.plans.registry import register
from lakeloom.sources.tables import load


@register("file_query_filter", oracle="""
select p_partkey, p_name, p_retailprice from part
where p_brand = 'Brand#12' and p_size > 20 and p_type like '%ALL%'""")
def q_file_query_filter(s, d):
    q = FileQuery(column_names="p_partkey, p_name, p_retailprice",
                  filters=[Filter("p_brand", "equal_to", "Brand#12"), Filter("p_size", "greater_than", "20"),
                           Filter("p_type", "contains", "ALL")])
    return run_file_query(load(s, d, "part"), q)


@register("file_query_group", oracle="""
select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as sum_qty,
  round(avg(l_discount), 6) as avg_disc
from lineitem where l_discount < 0.05 and l_shipdate >= '1996-01-01'
group by l_returnflag, l_linestatus order by l_returnflag asc nulls last""")
def q_file_query_group(s, d):
    q = FileQuery(column_names="l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, "
                               "ROUND(AVG(l_discount), 6) AS avg_disc",
                  filters=[Filter("l_discount", "less_than", 0.05),
                           Filter("l_shipdate", "greater_than_or_equal", "1996-01-01")],
                  group_by="l_returnflag, l_linestatus", order_by="l_returnflag", order_direction="ASC")
    return run_file_query(load(s, d, "lineitem"), q)


@register("file_query_page", oracle="""
select o_orderkey, o_totalprice, o_orderdate from orders
where o_orderstatus = 'F' and o_totalprice >= 1000
order by o_orderkey desc limit 20 offset 40""")
def q_file_query_page(s, d):
    q = FileQuery(column_names="o_orderkey, o_totalprice, o_orderdate",
                  filters=[Filter("o_orderstatus", "equal_to", "F"),
                           Filter("o_totalprice", "greater_than_or_equal", 1000)],
                  order_by="o_orderkey", order_direction="DESC", limit=20, offset=40)
    return run_file_query(load(s, d, "orders"), q)


@register("file_query_count", oracle="""
select count(*) as n from customer where c_mktsegment != 'BUILDING' and c_acctbal <= 5000""")
def q_file_query_count(s, d):
    q = FileQuery(column_names="COUNT(*) AS n",
                  filters=[Filter("c_mktsegment", "not_equal_to", "BUILDING"),
                           Filter("c_acctbal", "less_than_or_equal", "5000")])
    return run_file_query(load(s, d, "customer"), q)


@register("chart_aggregate", oracle="""
select o_orderstatus, round(sum(o_totalprice), 6) as sum_o_totalprice,
  round(avg(o_totalprice), 6) as avg_o_totalprice, count(o_orderkey) as count_o_orderkey,
  max(o_orderdate) as max_o_orderdate
from orders group by o_orderstatus""")
def q_chart_aggregate(s, d):
    out = chart_aggregate(load(s, d, "orders"), [
        {"column_name": "o_orderstatus"},
        {"column_name": "o_totalprice", "aggregate_function": "sum"},
        {"column_name": "o_totalprice", "aggregate_function": "avg"},
        {"column_name": "o_orderkey", "aggregate_function": "count"},
        {"column_name": "o_orderdate", "aggregate_function": "max"}])
    return out.select("o_orderstatus", round6("sum_o_totalprice").alias("sum_o_totalprice"),
                      round6("avg_o_totalprice").alias("avg_o_totalprice"), "count_o_orderkey", "max_o_orderdate")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("pivot_event_types", oracle="""
select cast(ts as date) as dt,
  count(*) filter (where event_type = 'click') as click,
  count(*) filter (where event_type = 'error') as error,
  count(*) filter (where event_type = 'purchase') as purchase,
  count(*) filter (where event_type = 'signup') as signup,
  count(*) filter (where event_type = 'view') as "view"
from events group by cast(ts as date)
having count(*) filter (where event_type in ('click', 'error', 'purchase', 'signup', 'view')) > 0""")
def q_pivot_event_types(s, d):
    return pivot_counts(load(s, d, "events"), F.col("ts").cast("date").alias("dt"), "event_type", EVENT_TYPES)


@register("url_file_name_raw", oracle="""
select page_id, url, regexp_replace(url, '.*/', '') as file_name from pages""")
def q_url_file_name_raw(s, d):
    p = load(s, d, "pages")
    return p.select("page_id", "url", url_last_segment("url").alias("file_name"))


@register("url_file_name_clean", oracle="""
select page_id, url, regexp_replace(regexp_replace(url, '.*/', ''), '\\?.*', '') as file_name from pages""")
def q_url_file_name_clean(s, d):
    p = load(s, d, "pages")
    return p.select("page_id", "url", url_file_name("url").alias("file_name"))
