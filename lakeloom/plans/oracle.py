"""DuckDB oracle text: the derived views as CTEs plus helpers to compose them.

The driver registers the base tables as views; every oracle query inlines
the derived views it needs with ``with_views``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "fps": """
select concat('fps-', cast(event_id as varchar(20))) as id,
  concat('file_', cast(event_id as varchar(20)), '.csv') as file_name,
  case event_id % 3 when 0 then 'pdf' when 1 then 'csv' else 'json' end as file_type,
  cast(floor(value * 1000) as bigint) as file_size_bytes,
  case when event_type = 'error' then 'failed' when event_id % 11 = 0 then 'processing' else 'completed' end as processing_status,
  cast(event_id % 250 as int) as records_extracted,
  concat('wf_', cast(user_id % 5 as varchar(20))) as workflow_id,
  case when user_id % 5 = 4 then null else concat('Workflow ', cast(user_id % 5 as varchar(20))) end as workflow_name,
  case when event_type = 'error' then 'extract failed' end as error_message,
  value as processing_duration_ms,
  ts as uploaded_at,
  case when event_type <> 'error' and event_id % 11 <> 0 then ts + interval '5' second end as completed_at
from events""",
    "ws": """
select concat('ws-', cast(o_orderkey as varchar(20))) as id,
  concat('trace-', cast(o_orderkey as varchar(20))) as trace_id,
  concat('https://files.example.com/in/file_', cast(o_orderkey as varchar(20)), '.csv') as uploaded_file_url,
  case when o_orderkey % 3 = 0 then null else concat('file_', cast(o_orderkey as varchar(20)), '.csv') end as file_name,
  case when o_orderpriority = '1-URGENT' then 'failed' when o_orderstatus = 'F' then 'completed'
       when o_orderstatus = 'O' then 'in-progress' else 'submitted' end as status,
  case when o_orderpriority = '5-LOW' then null else concat('wf_', cast(o_custkey % 5 as varchar(20))) end as workflow_id,
  concat('Workflow ', cast(o_custkey % 5 as varchar(20))) as workflow_name,
  case when o_orderpriority = '1-URGENT' then 'submission failed' end as error_message,
  concat('{"priority": "', o_orderpriority, '", "token": "t', cast(o_orderkey as varchar(20)), '"}') as metadata,
  o_orderdate as submitted_at,
  case when o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' then o_orderdate + interval '60' second end as completed_at,
  o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' as crew_kickoff_completed
from orders where o_orderkey % 7 <> 0""",
    "wes": """
select concat('wes-', cast(event_id as varchar(20))) as id,
  concat('wf_', cast(user_id % 5 as varchar(20))) as workflow_id,
  case event_type when 'error' then 'failed' when 'signup' then 'running' else 'success' end as status,
  cast(event_id % 40 as int) as input_files_count,
  cast(event_id % 500 as int) as records_processed,
  cast(event_id % 7 as int) as records_failed,
  value as duration_ms, ts as started_at
from events""",
    "prices": """
select cast(ts as date) as dt, event_type as symbol, cast(floor(max(value)) as bigint) as price
from events group by cast(ts as date), event_type""",
    "topic_messages": """
select event_id as msg_id, event_type as topic, cast(user_id % 4 as int) as part_no,
  cast(row_number() over (partition by event_type, user_id % 4 order by event_id) - 1 as bigint) as msg_offset,
  ts, cast(length(props) as bigint) as size_bytes, concat('producer-', cast(user_id % 6 as varchar(20))) as producer_id
from events""",
    "consumed": """
select event_id as msg_id, event_type as topic, cast(user_id % 4 as int) as part_no,
  case when event_id % 2 = 0 then 'group-a' else 'group-b' end as group_id,
  ts + (event_id % 50) * interval '1' second as consumed_at
from events where event_id % 10 < 8""",
    "replica": """
select event_id as msg_id, event_type as topic, ts + (event_id % 9) * interval '1' second as replicated_at
from events where event_id % 13 <> 0""",
    "status_events": """
select concat('trace-', cast(o_orderkey as varchar(20))) as trace_id, s.seq, s.kind,
  o_orderdate + (s.seq * 30 + case when s.seq = 2 and o_orderkey % 5 = 0 then 600 else 0 end) * interval '1' second as at
from orders cross join (select 0 as seq, 'submitted' as kind union all select 1, 'events'
  union all select 2, 'crew_kickoff_completed' union all select 3, 'api_error') s
where (s.seq < 2) or (s.seq = 2 and o_orderkey % 4 <> 3) or (s.seq = 3 and o_orderkey % 6 = 0)""",
    "upsert_target": """
select c_custkey as k, c_mktsegment as status, c_acctbal as amount from customer where c_acctbal > 0""",
    "upsert_batch": """
select o_custkey as k, o_orderkey as seq, o_orderpriority as status, o_totalprice as amount from orders""",
    "flow_components": """
select s_suppkey as component_id, case s_suppkey % 3 when 0 then 'processor' when 1 then 'service' else 'connection' end as kind,
  case when s_suppkey % 3 = 2 then null when s_suppkey % 17 = 0 then 'Invalid' when s_suppkey % 5 = 0 then 'Stopped' else 'Running' end as state,
  case when s_suppkey % 3 = 2 then s_suppkey * 7 % 50 else 0 end as queued_items,
  case when s_suppkey % 3 = 2 then s_suppkey * 11 % 101 else 0 end as percent_use
from supplier""",
}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for the named derived views."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    parts += [f"{n} AS ({body.strip()})" for n, body in (extra or {}).items()]
    body = sql.strip()
    if not parts:
        return body
    if body[:15].lower() == "with recursive ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].lower() == "with ":
        # merge with the query's own CTE list
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
