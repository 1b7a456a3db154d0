"""Keyed writes without MERGE: upsert (M4), partial update (M7), change-feed
apply (M8) and the submission status fold (T9, batch form).

All of them are one aggregation over a tagged union instead of a join:
every row carries a priority ``(source, order)`` and ``max_by`` picks the
winner per key.  ``max_by`` combines map-side, so a key that appears in a
third of the batch still costs one row per task before the shuffle, and the
whole operation is a single shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIO = "__prio"
_SEQ = "__seq"


def _tagged_union(target: DataFrame, batch: DataFrame, keys: Sequence[str], value_cols: Sequence[str],
                  order: str | Column | None) -> DataFrame:
    seq = F.col(order) if isinstance(order, str) else order
    t = target.select(*target.columns, F.lit(0).alias(_PRIO), F.lit(None).cast("long").alias(_SEQ))
    b = batch.select(*keys, *value_cols, F.lit(1).alias(_PRIO),
                     (seq if seq is not None else F.lit(0)).cast("long").alias(_SEQ))
    return t.unionByName(b, allowMissingColumns=True)


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """M4 ``INSERT … ON CONFLICT (keys) DO UPDATE`` of the batch's non-key columns.

    * the last duplicate in the batch (greatest ``order``) wins;
    * a NULL in the batch overwrites (it is the excluded row's value);
    * target columns the batch does not carry keep their old values;
    * a batch of key columns only is a no-op (the reference errors).
    """
    if not keys:
        raise ValueError("upsert requires primary key columns")
    value_cols = [c for c in batch.columns if c not in keys and c != order]
    if not value_cols:
        return target
    kept = [c for c in target.columns if c not in keys and c not in value_cols]
    u = _tagged_union(target, batch, keys, value_cols, order)
    prio = F.struct(F.col(_PRIO), F.col(_SEQ))
    aggs = [F.max_by(F.struct(*value_cols), prio).alias("__new")]
    # old values of columns the batch does not carry: only target rows vote
    aggs += [F.max_by(F.col(c), F.when(F.col(_PRIO) == 0, F.lit(1))).alias(c) for c in kept]
    g = u.groupBy(*keys).agg(*aggs)
    out_cols = list(target.columns) + [c for c in value_cols if c not in target.columns]
    return g.select(*[F.col(f"__new.{c}").alias(c) if c in value_cols else F.col(c) for c in out_cols])


def partial_update(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str | None = None
                   ) -> DataFrame:
    """M7 ``update_if_exists``: only the provided columns change; unmatched keys insert."""
    return upsert(target, batch, keys, order)


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str,
                  op_col: str = "op", delete_value: str = "delete") -> DataFrame:
    """M8: the latest change per key (by ``order``) decides; deletes remove the key."""
    value_cols = [c for c in changes.columns if c not in keys and c not in (order, op_col)]
    u = _tagged_union(target, changes, keys, [op_col, *value_cols], order)
    prio = F.struct(F.col(_PRIO), F.col(_SEQ))
    g = u.groupBy(*keys).agg(F.max_by(F.struct(F.col(op_col), *value_cols), prio).alias("__w"),
                             *[F.max_by(F.col(c), F.when(F.col(_PRIO) == 0, F.lit(1))).alias(f"__old_{c}")
                               for c in target.columns if c not in keys and c not in value_cols])
    live = g.filter(F.col("__w").getField(op_col).isNull() | (F.col("__w").getField(op_col) != delete_value))
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in value_cols:
            cols.append(F.col(f"__w.{c}").alias(c))
        else:
            cols.append(F.col(f"__old_{c}").alias(c))
    return live.select(*cols)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the one with the greatest ``order`` (aggregate, not a window)."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), ordering).alias("__w"))
            .select(*keys, *[F.col(f"__w.{c}").alias(c) for c in cols]))


# ------------------------------------------------------------------ T9 batch

POLL_TIMEOUT_SECONDS = 600
TIMEOUT_MESSAGE = "Polling timeout exceeded"


def status_aggregates(events: DataFrame) -> DataFrame:
    """Per trace: start, first kickoff, first API error, last event time and the
    number of ``events`` rows -- everything the status decision needs.  A plain
    aggregation (map-side combined), so it also runs as a streaming aggregate."""
    kind, at = F.col("kind"), F.col("at")
    return events.groupBy("trace_id").agg(
        F.min(F.when(kind == "submitted", at)).alias("start"),
        F.min(F.when(kind == "crew_kickoff_completed", at)).alias("t_kick"),
        F.min(F.when(kind == "api_error", at)).alias("t_err"),
        F.max(at).alias("t_last"),
        F.count_if(kind == "events").alias("n_events"))


def decide_status(g: DataFrame, timeout_seconds: int = POLL_TIMEOUT_SECONDS) -> DataFrame:
    """The status rule applied to ``status_aggregates`` rows (see ``fold_status``)."""
    deadline = F.col("start") + F.make_dt_interval(secs=F.lit(timeout_seconds))
    t_to = F.when(F.col("t_last") > deadline, deadline)
    cands = F.array(
        F.struct(F.col("t_kick").alias("t"), F.lit(0).alias("rank"), F.lit("kick").alias("kind")),
        F.struct(F.col("t_err").alias("t"), F.lit(1).alias("rank"), F.lit("api_error").alias("kind")),
        F.struct(t_to.alias("t"), F.lit(2).alias("rank"), F.lit("timeout").alias("kind")))
    first = F.array_min(F.filter(cands, lambda c: c["t"].isNotNull()))
    w = g.select("trace_id", "n_events", first.alias("term"))
    term_kind = F.col("term.kind")
    return w.select(
        "trace_id",
        F.when(term_kind.isin("kick", "api_error"), "completed").when(term_kind == "timeout", "failed")
        .when(F.col("n_events") > 0, "in-progress").otherwise("submitted").alias("status"),
        F.coalesce(term_kind.isin("kick", "api_error"), F.lit(False)).alias("crew_kickoff_completed"),
        F.col("term.t").alias("completed_at"),
        F.when(term_kind == "timeout", F.lit(TIMEOUT_MESSAGE)).alias("error_message"))


def fold_status(events: DataFrame, timeout_seconds: int = POLL_TIMEOUT_SECONDS) -> DataFrame:
    """Final submission state per trace from its ordered event log.

    Terminal candidates: first ``crew_kickoff_completed`` (completed, flag set),
    first ``api_error`` (completed, flag set, no output), and the poll timeout
    (failed at start + timeout) when any event lies past it.  The earliest
    candidate wins (ties: kickoff, api error, timeout); events after it are
    ignored.  Without a terminal event the trace is ``in-progress`` when an
    ``events`` row exists, else ``submitted``.  Pure aggregation per trace.
    """
    return decide_status(status_aggregates(events), timeout_seconds)
