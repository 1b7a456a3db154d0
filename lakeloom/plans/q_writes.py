"""Registered keyed-write queries: upsert, partial update, change apply, status fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators.upsert import apply_changes, fold_status, partial_update, upsert
from lakeloom.plans.registry import register
from lakeloom.sources.derived import view
from lakeloom.sources.tables import load

# The change feed: every order is a change of its customer's row; low-priority
# orders are deletes (the latest change per customer decides).
CDC_FEED_SQL = """
select o_custkey as k, o_orderkey as seq,
  case when o_orderpriority = '5-LOW' then 'delete' else 'upsert' end as op,
  o_orderpriority as status, o_totalprice as amount
from orders"""


def cdc_feed(s, d):
    o = load(s, d, "orders")
    return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"),
                    F.when(F.col("o_orderpriority") == "5-LOW", "delete").otherwise("upsert").alias("op"),
                    F.col("o_orderpriority").alias("status"), F.col("o_totalprice").alias("amount"))


@register("upsert_last_wins", views=("upsert_target", "upsert_batch"), oracle="""
with b as (select k, status, amount from (
    select *, row_number() over (partition by k order by seq desc) as rn from upsert_batch) x where rn = 1)
select k, status, amount from b
union all
select t.k, t.status, t.amount from upsert_target t where not exists (select 1 from b where b.k = t.k)""")
def q_upsert_last_wins(s, d):
    return upsert(view(s, d, "upsert_target"), view(s, d, "upsert_batch"), ["k"], order="seq")


@register("partial_update", views=("upsert_target", "upsert_batch"), oracle="""
with b as (select k, status from (
    select *, row_number() over (partition by k order by seq desc) as rn from upsert_batch) x where rn = 1)
select coalesce(b.k, t.k) as k, case when b.k is not null then b.status else t.status end as status, t.amount
from upsert_target t full outer join b on t.k = b.k""")
def q_partial_update(s, d):
    batch = view(s, d, "upsert_batch").select("k", "seq", "status")
    return partial_update(view(s, d, "upsert_target"), batch, ["k"], order="seq")


@register("cdc_apply", views=("upsert_target",), extra={"cdc_feed": CDC_FEED_SQL}, oracle="""
with c as (select * from (
    select *, row_number() over (partition by k order by seq desc) as rn from cdc_feed) x where rn = 1)
select k, status, amount from c where op <> 'delete'
union all
select t.k, t.status, t.amount from upsert_target t where not exists (select 1 from c where c.k = t.k)""")
def q_cdc_apply(s, d):
    return apply_changes(view(s, d, "upsert_target"), cdc_feed(s, d), ["k"], order="seq")


@register("status_fold", views=("status_events",), oracle="""
with g as (
  select trace_id,
    min(case when kind = 'submitted' then "at" end) as start,
    min(case when kind = 'crew_kickoff_completed' then "at" end) as t_kick,
    min(case when kind = 'api_error' then "at" end) as t_err,
    max("at") as t_last,
    count(*) filter (where kind = 'events') as n_events
  from status_events group by trace_id),
c as (
  select trace_id, n_events, t_kick, t_err,
    case when t_last > start + interval '600' second then start + interval '600' second end as t_to
  from g),
p as (
  select trace_id, n_events,
    case
      when t_kick is not null and (t_err is null or t_kick <= t_err) and (t_to is null or t_kick <= t_to) then 'kick'
      when t_err is not null and (t_to is null or t_err <= t_to) then 'api_error'
      when t_to is not null then 'timeout' end as term,
    t_kick, t_err, t_to
  from c)
select trace_id,
  case when term in ('kick', 'api_error') then 'completed' when term = 'timeout' then 'failed'
       when n_events > 0 then 'in-progress' else 'submitted' end as status,
  coalesce(term in ('kick', 'api_error'), false) as crew_kickoff_completed,
  case term when 'kick' then t_kick when 'api_error' then t_err when 'timeout' then t_to end as completed_at,
  case when term = 'timeout' then 'Polling timeout exceeded' end as error_message
from p""")
def q_status_fold(s, d):
    return fold_status(view(s, d, "status_events"))
