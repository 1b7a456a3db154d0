"""Fixed schemas of the five tracking tables and the stats-insert allow-lists."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


FILE_PROCESSING_STATS = _st(
    ("id", S, False), ("file_name", S, True), ("file_type", S, False), ("file_size_bytes", L, True),
    ("processing_status", S, True), ("records_extracted", I, True), ("workflow_id", S, True),
    ("workflow_name", S, True), ("error_message", S, True), ("processing_duration_ms", D, True),
    ("uploaded_at", TS, True), ("completed_at", TS, True))

WORKFLOW_SUBMISSIONS = _st(
    ("id", S, False), ("trace_id", S, False), ("workflow_url", S, True), ("uploaded_file_url", S, True),
    ("file_name", S, False), ("query", S, True), ("status", S, True), ("workflow_id", S, True),
    ("workflow_name", S, True), ("execution_id", S, True), ("file_id", S, True), ("error_message", S, True),
    ("metadata", S, True), ("submitted_at", TS, True), ("last_polled_at", TS, True), ("completed_at", TS, True),
    ("wf_output", S, True), ("crew_kickoff_completed", B, True))

WORKFLOW_EXECUTION_STATS = _st(
    ("id", S, False), ("workflow_id", S, True), ("workflow_name", S, True), ("execution_type", S, True),
    ("status", S, True), ("input_files_count", I, True), ("output_records_count", I, True),
    ("records_processed", I, True), ("records_failed", I, True), ("agents_used", S, True), ("tools_used", S, True),
    ("duration_ms", D, True), ("error_message", S, True), ("metadata", S, True), ("started_at", TS, True),
    ("completed_at", TS, True))

AGENT_STATS = _st(
    ("id", S, False), ("agent_name", S, True), ("agent_type", S, True), ("status", S, True),
    ("deployment_url", S, True), ("total_executions", L, True), ("successful_executions", L, True),
    ("failed_executions", L, True), ("last_execution_at", TS, True), ("created_at", TS, True),
    ("updated_at", TS, True))

SERVICE_STATS = _st(
    ("id", S, False), ("server_name", S, True), ("server_type", S, True), ("status", S, True),
    ("endpoint_url", S, True), ("total_calls", L, True), ("successful_calls", L, True), ("failed_calls", L, True),
    ("last_call_at", TS, True), ("created_at", TS, True), ("updated_at", TS, True))

TRACKING_TABLES = {
    "file_processing_stats": FILE_PROCESSING_STATS,
    "workflow_submissions": WORKFLOW_SUBMISSIONS,
    "workflow_execution_stats": WORKFLOW_EXECUTION_STATS,
    "agent_stats": AGENT_STATS,
    "mcp_server_stats": SERVICE_STATS,
}

# Natural keys used by update_if_exists; tables keyed by ``id``
# are always inserted.
NATURAL_KEYS = {"workflow_submissions": "trace_id", "agent_stats": "agent_name", "mcp_server_stats": "server_name"}

# Columns filled with defaults when absent, per table.
DEFAULT_TIMESTAMPS = {
    "file_processing_stats": ["uploaded_at"],
    "workflow_submissions": ["submitted_at"],
    "workflow_execution_stats": ["started_at"],
    "agent_stats": ["created_at", "updated_at"],
    "mcp_server_stats": ["created_at", "updated_at"],
}
