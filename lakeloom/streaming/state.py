"""Stateful streaming: keyed latest-state views (T6), output sampling (T5) and the
submission status machine (T9).

Materialized views are log-structured: each micro-batch appends its per-key
winners to a changelog partitioned by batch id (overwriting that partition,
so a retried batch is idempotent), and reading the view is a ``max_by``
aggregation over the log.  No state store grows with the key space, and
executor loss costs at most a re-run of the current batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from lakeloom.operators.topics import sample_output
from lakeloom.operators.upsert import POLL_TIMEOUT_SECONDS, TIMEOUT_MESSAGE, latest_per_key
from lakeloom.session import scratch_path
from lakeloom.streaming.topics import trigger_kwargs

BATCH_COL = "_batch_id"


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn(BATCH_COL, F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BATCH_COL).parquet(path))


def start_materialized_view(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str | None = None,
                            checkpoint: str | None = None, trigger: str | None = "available_now",
                            name: str = "mv", output_mode: str = "append") -> tuple[StreamingQuery, str]:
    """Keep the latest row per key of a stream in a changelog at ``path``.
    Use ``output_mode='update'`` when the stream is a stateful aggregation."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, f"mv/{name}/log")
    checkpoint = checkpoint or scratch_path(spark, f"mv/{name}/checkpoint")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # with no order the batch already has one row per key (an aggregation's update)
        _write_batch(latest_per_key(batch, keys, order) if order else batch, path, batch_id)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(output_mode)
         .queryName(name).trigger(**trigger_kwargs(trigger)).start())
    return q, path


def read_materialized_view(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str],
                           schema=None) -> DataFrame:
    """The view's current rows.  Before the first batch lands there is no log:
    with ``schema`` (the stream's row schema) the view is then empty."""
    try:
        log = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - no batch written yet
        if schema is None:
            raise
        return spark.createDataFrame([], schema)
    cols = [c for c in log.columns if c != BATCH_COL]
    return latest_per_key(log, keys, [*order, BATCH_COL], cols)


def start_sampler(stream: DataFrame, ts: str, tie: str, interval_ms: int = 1000, path: str | None = None,
                  checkpoint: str | None = None, trigger: str | None = "available_now",
                  name: str = "sample") -> tuple[StreamingQuery, str]:
    """T5 on a stream: each micro-batch lands its earliest row per interval bucket;
    ``read_sample`` applies the count/window cuts over everything landed."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, f"sample/{name}/data")
    checkpoint = checkpoint or scratch_path(spark, f"sample/{name}/checkpoint")

    def sink(batch: DataFrame, batch_id: int) -> None:
        picked = sample_output(batch, ts, tie, interval_ms, count=2**31 - 1, window=2**31 - 1)
        _write_batch(picked, path, batch_id)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .queryName(name).trigger(**trigger_kwargs(trigger)).start())
    return q, path


def read_sample(spark: SparkSession, path: str, ts: str, tie: str, interval_ms: int = 1000, count: int = 100,
                window: int = 100) -> DataFrame:
    landed = spark.read.parquet(path).drop(BATCH_COL)
    return sample_output(landed, ts, tie, interval_ms, count, window)


# ---------------------------------------------------------------- T9 stream

STATUS_OUTPUT = ("trace_id string, status string, crew_kickoff_completed boolean, completed_at timestamp, "
                 "error_message string")
STATUS_STATE = "start long, t_kick long, t_err long, t_last long, n_events long, timed_out boolean"


def _decide(st: dict, timeout_us: int, fired: bool):
    """Same rule as the batch fold; ``fired`` means the event-time timer passed."""
    start, t_kick, t_err, t_last = st["start"], st["t_kick"], st["t_err"], st["t_last"]
    deadline = start + timeout_us if start is not None else None
    cands = []
    if t_kick is not None:
        cands.append((t_kick, 0, "kick"))
    if t_err is not None:
        cands.append((t_err, 1, "api_error"))
    if deadline is not None and ((t_last is not None and t_last > deadline) or fired):
        cands.append((deadline, 2, "timeout"))
    if not cands:
        return ("in-progress" if st["n_events"] else "submitted"), False, None, None, False
    t, _, kind = min(cands)
    if kind == "timeout":
        return "failed", False, t, TIMEOUT_MESSAGE, True
    return "completed", True, t, None, True


def _status_fn(timeout_us: int):
    def fn(key, pdfs, state):
        trace_id = key[0]
        if state.exists:
            s = state.get
            st = {"start": s[0], "t_kick": s[1], "t_err": s[2], "t_last": s[3], "n_events": s[4]}
        else:
            st = {"start": None, "t_kick": None, "t_err": None, "t_last": None, "n_events": 0}
        fired = state.hasTimedOut
        if not fired:
            for pdf in pdfs:
                at = (pd.to_datetime(pdf["at"]).astype("int64") // 1000)
                kind = pdf["kind"]
                for k, col in (("submitted", "start"), ("crew_kickoff_completed", "t_kick"), ("api_error", "t_err")):
                    m = at[kind == k]
                    if len(m):
                        v = int(m.min())
                        st[col] = v if st[col] is None else min(st[col], v)
                if len(at):
                    v = int(at.max())
                    st["t_last"] = v if st["t_last"] is None else max(st["t_last"], v)
                st["n_events"] += int((kind == "events").sum())
        # decided by event time from everything accepted so far; an earlier event
        # arriving later (still above the watermark) can change the answer
        status, flag, t, err, _ = _decide(st, timeout_us, fired)
        if fired:
            # the watermark passed the deadline: nothing that could change the
            # outcome can still be accepted, so the state is released
            state.remove()
        else:
            state.update((st["start"], st["t_kick"], st["t_err"], st["t_last"], st["n_events"], False))
            anchor = st["start"] if st["start"] is not None else st["t_last"]
            if anchor is not None:
                due_ms = (anchor + timeout_us) // 1000
                state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"trace_id": [trace_id], "status": [status], "crew_kickoff_completed": [flag],
                            "completed_at": [pd.Timestamp(t * 1000) if t is not None else None],
                            "error_message": [err]})
    return fn


def status_machine(events: DataFrame, timeout_seconds: int = POLL_TIMEOUT_SECONDS) -> DataFrame:
    """T9 on a stream of ``(trace_id, seq, kind, at)``; ``at`` must carry a watermark.

    Emits the current decision of every trace touched in a batch (update mode),
    decided by event time exactly like the batch fold, so out-of-order arrival
    does not change the answer.  When the watermark passes start + timeout the
    trace is final: an open trace becomes ``failed`` (the poller's timeout) and
    its state is dropped, so state lives no longer than the watermark allows."""
    return events.groupBy("trace_id").applyInPandasWithState(
        _status_fn(timeout_seconds * 1_000_000), STATUS_OUTPUT, STATUS_STATE, "update",
        GroupStateTimeout.EventTimeTimeout)
