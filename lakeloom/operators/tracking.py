"""Tracking-table analytics: dashboard aggregates, outer joins, status summaries,
top-N reports (A1-A9, J1-J3, J7, O2-O4, P6-P8, W5).

Every function takes the tracking tables as DataFrames and returns a lazy
DataFrame; the caller decides what action runs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.scalar import (PENDING_STATUS, UNKNOWN_TYPE, UNNAMED_WORKFLOW, blank_as_null,
                                       pct_rate, round6, url_last_segment, zero_as_null)
from lakeloom.operators.scan import needs_chunks


def _newest_first(df: DataFrame, ts: str, tie: str, limit: int) -> DataFrame:
    """Top-N newest rows; ``tie`` makes the cut deterministic.  Runs as
    TakeOrderedAndProject: a per-partition top-N, then one small merge.  Rows without
    a time come first, as a plain descending order puts them."""
    return df.orderBy(F.col(ts).desc_nulls_first(), F.col(tie).asc()).limit(limit)


# ---------------------------------------------------------------- aggregates

def file_totals(fps: DataFrame) -> DataFrame:
    """A1: one-row file totals."""
    return fps.agg(
        F.count(F.lit(1)).alias("total_files_processed"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("total_file_size_bytes"),
        F.coalesce(F.sum("records_extracted"), F.lit(0)).cast("long").alias("total_records_extracted"),
        F.count_if(F.col("processing_status") == "completed").alias("successful_files"),
        F.count_if(F.col("processing_status") == "failed").alias("failed_files"))


def files_by_type(fps: DataFrame) -> DataFrame:
    """A2: count and bytes per file type, ascending by count."""
    return (fps.groupBy("file_type")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("total_size"))
            .orderBy(F.col("count").asc(), F.col("file_type").asc_nulls_last()))


def execution_totals(wes: DataFrame) -> DataFrame:
    """A3: one-row execution totals."""
    return wes.agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(F.col("status") == "success").alias("successful_executions"),
        F.count_if(F.col("status") == "failed").alias("failed_executions"),
        F.count_if(F.col("status") == "running").alias("running_executions"),
        F.coalesce(F.sum("records_processed"), F.lit(0)).cast("long").alias("total_records_processed"),
        round6(F.coalesce(F.avg("duration_ms"), F.lit(0.0))).alias("avg_execution_duration_ms"))


def files_by_status(fps: DataFrame) -> DataFrame:
    """A4."""
    return fps.groupBy("processing_status").agg(
        F.count(F.lit(1)).alias("count"),
        round6(F.avg("processing_duration_ms")).alias("avg_duration"),
        F.sum("records_extracted").cast("long").alias("total_records"))


def files_by_workflow(fps: DataFrame) -> DataFrame:
    """A5: NULL workflow names dropped before grouping."""
    return fps.filter(F.col("workflow_name").isNotNull()).groupBy("workflow_name").agg(
        F.count(F.lit(1)).alias("count"),
        round6(F.avg("processing_duration_ms")).alias("avg_duration"),
        F.sum("records_extracted").cast("long").alias("total_records"))


def submissions_by_status(ws: DataFrame) -> DataFrame:
    """A6."""
    return ws.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def submissions_by_workflow(ws: DataFrame) -> DataFrame:
    """``SUM(CASE WHEN crew_kickoff_completed THEN 1 ELSE 0 END)``."""
    return ws.filter(F.col("workflow_name").isNotNull()).groupBy("workflow_name").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(F.col("crew_kickoff_completed"), 1).otherwise(0)).cast("long").alias("completed_kickoffs"))


def workflow_performance(fps: DataFrame) -> DataFrame:
    """A8 + F12: per-workflow runs, outcomes, durations, records and success rate."""
    status = F.col("processing_status")
    return (fps.filter(F.col("workflow_name").isNotNull())
            .groupBy("workflow_name")
            .agg(F.count(F.lit(1)).alias("total_runs"),
                 F.count_if(status == "completed").alias("successful_runs"),
                 F.count_if(status == "failed").alias("failed_runs"),
                 round6(F.avg("processing_duration_ms")).alias("avg_duration_ms"),
                 F.min("processing_duration_ms").alias("min_duration_ms"),
                 F.max("processing_duration_ms").alias("max_duration_ms"),
                 F.sum("records_extracted").cast("long").alias("total_records_extracted"),
                 round6(F.avg("records_extracted")).alias("avg_records_per_run"))
            .withColumn("success_rate", round6(pct_rate("successful_runs", "total_runs")))
            .orderBy(F.col("total_runs").desc(), F.col("workflow_name").asc()))


def submission_summary(ws: DataFrame, fps: DataFrame, status: str | None = None) -> DataFrame:
    """A9 + J3: submission counts (status filter applies to this half only) next to
    file counts.  Both halves are one global aggregation over a tagged union:
    one scan of each table, partial aggregation per task, no join."""
    w = ws if status is None else ws.filter(F.col("status") == status)
    tagged = (w.select(F.lit(True).alias("_ws"), "status", "workflow_id")
              .unionByName(fps.select(F.lit(False).alias("_ws"), "processing_status",
                                      "records_extracted", "file_size_bytes"),
                           allowMissingColumns=True))
    is_ws = F.col("_ws")
    fst = F.col("processing_status")
    return tagged.agg(
        F.count_if(is_ws).alias("total_submissions"),
        F.count_if(is_ws & (F.col("status") == "submitted")).alias("submitted_count"),
        F.count_if(is_ws & (F.col("status") == "in-progress")).alias("in_progress_count"),
        F.count_if(is_ws & (F.col("status") == "completed")).alias("completed_count"),
        F.count_if(is_ws & (F.col("status") == "failed")).alias("failed_count"),
        F.count_distinct(F.when(is_ws, F.col("workflow_id"))).alias("unique_workflows"),
        F.count_if(~is_ws).alias("total_files"),
        F.count_if(~is_ws & (fst == "completed")).alias("completed_files"),
        F.count_if(~is_ws & (fst == "failed")).alias("failed_files"),
        F.count_if(~is_ws & (fst == "processing")).alias("processing_files"),
        F.coalesce(F.sum("records_extracted"), F.lit(0)).cast("long").alias("total_records_extracted"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("total_file_size_bytes"))


# ---------------------------------------------------------------- joins

def submission_key(ws: DataFrame) -> Column:
    """Derived file key: the submitted file name, else the last URL segment."""
    return F.coalesce(ws["file_name"], url_last_segment(ws["uploaded_file_url"]))


def _join_sides(ws: DataFrame, fps: DataFrame, status: str | None) -> tuple[DataFrame, DataFrame]:
    w = ws if status is None else ws.filter(F.col("status") == status)
    ef = w.select(
        submission_key(w).alias("extracted_filename"), F.col("id").alias("ws_id"), "trace_id",
        "uploaded_file_url", "status", F.col("workflow_id").alias("ws_workflow_id"),
        F.col("workflow_name").alias("ws_workflow_name"), F.col("error_message").alias("ws_error_message"),
        "metadata", "submitted_at", F.col("completed_at").alias("ws_completed_at"), "crew_kickoff_completed")
    f = fps.select(
        F.col("file_name").alias("fps_file_name"), F.col("id").alias("file_processing_id"), "file_type",
        "file_size_bytes", "processing_status", "records_extracted",
        F.col("workflow_id").alias("fps_workflow_id"), F.col("workflow_name").alias("fps_workflow_name"),
        "processing_duration_ms", F.col("uploaded_at").alias("file_uploaded_at"),
        F.col("completed_at").alias("file_completed_at"), F.col("error_message").alias("file_error_message"))
    return ef, f


def _sort() -> list[Column]:
    return [F.col("sort_date").asc_nulls_last(), F.col("ws_id").asc_nulls_last(),
            F.col("file_processing_id").asc_nulls_last()]


def _shape(j: DataFrame, ef: DataFrame, f: DataFrame, faithful: bool) -> DataFrame:
    name = F.col("extracted_filename") if faithful else F.coalesce("extracted_filename", "fps_file_name")
    return j.select(
        name.alias("file_name"), *[c for c in ef.columns if c != "extracted_filename"],
        *[c for c in f.columns if c != "fps_file_name"],
        F.coalesce("submitted_at", "file_uploaded_at").alias("sort_date"))


def submission_file_join(ws: DataFrame, fps: DataFrame, status: str | None = None,
                         limit: int | None = 50, faithful: bool = False) -> DataFrame:
    """J1 + O3: FULL OUTER join of submissions and files on the derived file key,
    oldest first (``sort_date``), first ``limit`` rows.

    The status filter is applied to submissions *before* the join, so files of
    filtered-out submissions come back as file-only rows.  ``faithful=True``
    keeps the reference's ``file_name`` (NULL on file-only rows); by default
    the file side's name fills it.

    With a limit the full outer join is never built.  The result is the top
    rows of three exact parts: (A) the first ``limit`` submissions by
    ``(submitted_at, id)`` with their files (every submission yields at least
    one row sharing its sort key, so no later submission can place), joined by
    broadcasting those ``limit`` rows; (B) submissions without a submission
    time, joined normally (skipped after a cheap emptiness probe); (C) files no
    submission names, from a key-only anti join, cut to ``limit`` before their
    other columns are fetched.
    """
    ef, f = _join_sides(ws, fps, status)
    if not limit or not (needs_chunks(ef) or needs_chunks(f)):
        # no limit, or small inputs: the plain full outer join is the cheaper plan
        j = ef.join(f, ef["extracted_filename"] == f["fps_file_name"], "full_outer")
        out = _shape(j, ef, f, faithful).orderBy(*_sort())
        return out.limit(limit) if limit else out
    spark = ws.sparkSession
    # (A) earliest submissions and their files; the ``limit`` rows are brought
    # to the driver once (they are bounded by the output size) and broadcast
    top_rows = (ef.filter(F.col("submitted_at").isNotNull())
                .orderBy(F.col("submitted_at").asc(), F.col("ws_id").asc()).limit(limit).collect())
    top_ws = spark.createDataFrame(top_rows, ef.schema)
    hit = f.join(F.broadcast(top_ws), f["fps_file_name"] == top_ws["extracted_filename"], "inner")
    alone = top_ws.join(hit.select(F.col("extracted_filename").alias("_k")).distinct(),
                        top_ws["extracted_filename"].eqNullSafe(F.col("_k")), "left_anti")
    parts = [hit, alone]
    # (B) submissions without a time sort by their files' upload time
    undated = ef.filter(F.col("submitted_at").isNull())
    if not undated.isEmpty():
        parts.append(undated.join(f, undated["extracted_filename"] == f["fps_file_name"], "left"))
    # (C) file-only rows: anti join on keys only, top rows, then their columns
    keys = ef.select(F.col("extracted_filename").alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    lone = (f.select("fps_file_name", "file_processing_id", "file_uploaded_at")
            .join(keys, F.col("fps_file_name") == F.col("_k"), "left_anti")
            .orderBy(F.col("file_uploaded_at").asc_nulls_last(), F.col("file_processing_id").asc_nulls_last())
            .limit(limit).select(F.col("file_processing_id").alias("_id")).collect())
    lone_ids = spark.createDataFrame(lone, "_id string")
    parts.append(f.join(F.broadcast(lone_ids), f["file_processing_id"] == lone_ids["_id"], "left_semi"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return _shape(u, ef, f, faithful).orderBy(*_sort()).limit(limit)


def nest_submission_rows(joined: DataFrame) -> DataFrame:
    """Split each joined row into two optional structs, NULL when that side is missing."""
    ws_fields = ["ws_id", "trace_id", "uploaded_file_url", "status", "ws_workflow_id", "ws_workflow_name",
                 "ws_error_message", "metadata", "submitted_at", "ws_completed_at", "crew_kickoff_completed"]
    fp_fields = ["file_processing_id", "file_type", "file_size_bytes", "processing_status", "records_extracted",
                 "fps_workflow_id", "fps_workflow_name", "processing_duration_ms", "file_uploaded_at",
                 "file_completed_at", "file_error_message"]
    ws_struct = F.struct(*[F.col(c).alias(c.removeprefix("ws_")) for c in ws_fields])
    fp_struct = F.struct(
        *[F.col(c).alias(c.removeprefix("fps_").removeprefix("file_")) for c in fp_fields if c != "processing_duration_ms"],
        zero_as_null(F.col("processing_duration_ms")).alias("processing_duration_ms"))
    return joined.select(
        "file_name",
        F.when(F.col("ws_id").isNotNull(), ws_struct).alias("workflow_submission"),
        F.when(F.col("file_processing_id").isNotNull(), fp_struct).alias("file_processing"))


def workflow_file_details(ws: DataFrame, fps: DataFrame) -> DataFrame:
    """J2 + F3/F4/F7: submissions LEFT JOIN files, only rows with a workflow id."""
    w = ws.filter(F.col("workflow_id").isNotNull())
    w = w.select("workflow_id", "workflow_name", "file_name", "uploaded_file_url", "status", "completed_at",
                 "submitted_at", "error_message", submission_key(w).alias("_key"))
    f = fps.select(F.col("file_name").alias("f_file_name"), F.col("file_type").alias("f_file_type"),
                   F.col("processing_status").alias("f_status"), F.col("records_extracted").alias("f_records"),
                   F.col("completed_at").alias("f_completed_at"), F.col("uploaded_at").alias("f_uploaded_at"),
                   F.col("file_size_bytes").alias("f_size"),
                   F.col("processing_duration_ms").alias("f_duration"), F.col("error_message").alias("f_error"))
    j = w.join(f, w["_key"] == f["f_file_name"], "left")
    out = j.select(
        "workflow_id",
        F.coalesce(blank_as_null(F.col("workflow_name")), F.lit(UNNAMED_WORKFLOW)).alias("workflow_name"),
        F.coalesce("f_file_name", "file_name", url_last_segment(F.col("uploaded_file_url"))).alias("file_name"),
        F.coalesce(F.upper("f_file_type"), F.lit(UNKNOWN_TYPE)).alias("file_type"),
        F.coalesce("f_status", "status", F.lit(PENDING_STATUS)).alias("status"),
        F.coalesce(F.col("f_records"), F.lit(0)).alias("records_extracted"),
        F.coalesce("f_completed_at", "completed_at", "f_uploaded_at", "submitted_at").alias("last_activity"),
        "submitted_at",
        F.col("f_size").alias("file_size_bytes"),
        zero_as_null(F.col("f_duration")).alias("processing_duration_ms"),
        F.when(F.col("f_status") == "completed", F.lit(True))
        .when((F.col("f_status") == "failed") | (F.col("status") == "failed"), F.lit(False))
        .alias("is_successful"),
        F.coalesce("f_error", "error_message").alias("error_message"))
    return out.orderBy(F.col("last_activity").asc_nulls_last())


def latest_submission_per_file(ws: DataFrame) -> DataFrame:
    """Newest submission per derived file key.

    ``max_by`` over a struct ordering is an aggregate, so each task keeps one
    candidate per key before the shuffle: a file submitted millions of times
    costs one row per task, not one task.
    """
    pick = F.max_by(F.struct("trace_id", "status", "submitted_at"),
                    F.struct(F.col("submitted_at"), F.col("id")))
    return (ws.groupBy(submission_key(ws).alias("file_name"))
            .agg(pick.alias("_w"), F.count(F.lit(1)).alias("submissions"))
            .select("file_name", "_w.trace_id", "_w.status", "_w.submitted_at", "submissions"))


# ---------------------------------------------------------------- filtered top-N

def recent_failures(fps: DataFrame, limit: int = 5) -> DataFrame:
    """O2: newest failed files."""
    f = fps.filter(F.col("processing_status") == "failed").select("file_name", "error_message", "uploaded_at", "id")
    return _newest_first(f, "uploaded_at", "id", limit).drop("id")


def pending_submissions(ws: DataFrame, limit: int = 10) -> DataFrame:
    """O2 + P8: submitted and not completed, newest first."""
    w = ws.filter((F.col("status") == "submitted") & F.col("completed_at").isNull())
    return _newest_first(w.select("trace_id", "workflow_name", "file_name", "submitted_at"),
                         "submitted_at", "trace_id", limit)


def failed_submissions(ws: DataFrame, limit: int = 10) -> DataFrame:
    """``error_message IS NOT NULL OR status = 'failed'``, newest first."""
    w = ws.filter(F.col("error_message").isNotNull() | (F.col("status") == "failed"))
    return _newest_first(w.select("trace_id", "workflow_name", "file_name", "status", "error_message",
                                  "submitted_at", "completed_at"), "submitted_at", "trace_id", limit)


def file_processing_stats(fps: DataFrame, status: str | None = None, workflow_id: str | None = None,
                          limit: int = 10) -> DataFrame:
    """P6 + O2: optional equality filters, newest first."""
    f = fps
    if status:
        f = f.filter(F.col("processing_status") == status)
    if workflow_id:
        f = f.filter(F.col("workflow_id") == workflow_id)
    return _newest_first(f, "uploaded_at", "id", limit)


def workflow_submissions(ws: DataFrame, status: str | None = None, workflow_name: str | None = None,
                         trace_id: str | None = None, limit: int = 10) -> DataFrame:
    """A given ``trace_id`` makes ``status`` ignored."""
    w = ws
    if trace_id:
        w = w.filter(F.col("trace_id") == trace_id)
    elif status:
        w = w.filter(F.col("status") == status)
    if workflow_name:
        w = w.filter(F.col("workflow_name") == workflow_name)
    return _newest_first(w, "submitted_at", "trace_id", limit)


def search_files(fps: DataFrame, file_name_pattern: str | None = None, file_type: str | None = None,
                 limit: int = 10) -> DataFrame:
    """Case-insensitive substring match (wildcards inside the pattern stay live)."""
    f = fps
    if file_name_pattern:
        f = f.filter(F.col("file_name").ilike(f"%{file_name_pattern}%"))
    if file_type:
        f = f.filter(F.col("file_type") == file_type)
    return _newest_first(f, "uploaded_at", "id", limit)


def recent_rows(df: DataFrame, ts: str, tie: str, limit: int = 50, ascending: bool = True) -> DataFrame:
    """The reference's "recent" lists sort ascending; the flag exposes it."""
    order = F.col(ts).asc_nulls_last() if ascending else F.col(ts).desc_nulls_last()
    return df.orderBy(order, F.col(tie).asc()).limit(limit)
