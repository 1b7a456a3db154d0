"""Deployed-application inventory, job/sample listings, dashboards and counters
(P10-P12, A15, A17, A19, J6, T15 read flags).

Inputs are landed listings (one row per application or job), so everything
here is a projection, a join against a small side, or one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.upsert import upsert

# The marker of workflow applications, the name patterns used to
# find the extraction application, and the sample-status fallbacks.
WORKFLOW_MARKER = "Workflow:"
EXTRACTOR_APP_NAMES = ("file-to-relational", "pdf to relational")
NO_SAMPLE, SAMPLE_ERROR = "no_sample_id", "error"


class NotFound(LookupError):
    pass


def is_workflow(name: Column) -> Column:
    """P10: the name contains ``Workflow:``."""
    return F.coalesce(name.contains(WORKFLOW_MARKER), F.lit(False))


def project_name_matches(name: Column, base: str) -> Column:
    """P10: ``^base(\\s*-\\s*.*)?$`` ignoring case (the base is matched literally)."""
    quoted = "\\Q" + base.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return name.rlike(f"(?i)^{quoted}(\\s*-\\s*.*)?$")


def is_extractor_app(name: Column, names: Sequence[str] = EXTRACTOR_APP_NAMES) -> Column:
    """P10: the lower-cased name contains any of ``names``."""
    low = F.lower(name)
    out = F.lit(False)
    for n in names:
        out = out | low.contains(n)
    return out


def flatten_inventory(apps: DataFrame, domain: str | None, env_keys: dict[str, str]) -> DataFrame:
    """P12 + F10: fields, ``https://<subdomain>.<domain>`` when both exist, and ids
    read from the JSON ``environment`` text (NULL when it is malformed).
    ``env_keys`` maps output column -> key in the environment object."""
    url = (F.when(F.col("subdomain").isNotNull() & F.lit(domain is not None),
                  F.concat(F.lit("https://"), F.col("subdomain"), F.lit("." + (domain or ""))))
           if domain else F.lit(None).cast("string"))
    ids = [F.get_json_object(F.col("environment"), f"$.{k}").alias(out) for out, k in env_keys.items()]
    return apps.select("id", "name", "subdomain", "status", url.alias("url"),
                       is_workflow(F.col("name")).alias("is_workflow"), *ids)


def inventory_counts(flat: DataFrame) -> DataFrame:
    """Total, workflow apps, apps whose status contains ``RUNNING``."""
    return flat.agg(F.count(F.lit(1)).alias("count"),
                    F.count_if(F.col("is_workflow")).alias("workflow_count"),
                    F.count_if(F.coalesce(F.col("status").contains("RUNNING"), F.lit(False))).alias("running_count"))


def lookup_one(df: DataFrame, key: str, value, what: str = "record") -> dict:
    """The single row with ``key == value``; an error when absent."""
    rows = df.filter(F.col(key) == F.lit(value)).limit(2).collect()
    if not rows:
        raise NotFound(f"{what} {value!r} not found")
    return rows[0].asDict(recursive=True)


def jobs_with_samples(jobs: DataFrame, samples: DataFrame) -> DataFrame:
    """Jobs left-joined to their samples: record count and status, with
    ``no_sample_id`` when the job has none and ``error`` when its sample is missing."""
    s = samples.groupBy("sample_id").agg(F.count("record").alias("_n"), F.first("job_status", True).alias("_st"))
    j = jobs.join(s, "sample_id", "left")
    return j.select(
        *jobs.columns,
        F.when(F.col("sample_id").isNull(), 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long")
        .alias("sample_records_count"),
        F.when(F.col("sample_id").isNull(), F.lit(NO_SAMPLE))
        .when(F.col("_n").isNull(), F.lit(SAMPLE_ERROR)).otherwise(F.coalesce("_st", F.lit("unknown")))
        .alias("sample_status"))


def job_summary(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("total_jobs"),
                    F.count_if(F.col("state") == "RUNNING").alias("running_jobs"))


def dashboard(fps: DataFrame, wes: DataFrame) -> DataFrame:
    """File totals, per-type breakdown (ascending by count) and execution
    totals nested in one row; two partial aggregations and a tagged union, no join."""
    per_type = fps.groupBy("file_type").agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.sum("records_extracted"), F.lit(0)).cast("long").alias("records"),
        F.count_if(F.col("processing_status") == "completed").alias("ok"),
        F.count_if(F.col("processing_status") == "failed").alias("bad"))
    runs = wes.agg(F.count(F.lit(1)).alias("total_executions"),
                   F.count_if(F.col("status") == "success").alias("successful"),
                   F.count_if(F.col("status") == "failed").alias("failed"),
                   F.count_if(F.col("status") == "running").alias("running"),
                   F.coalesce(F.sum("records_processed"), F.lit(0)).cast("long").alias("total_records_processed"),
                   F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"))
    u = per_type.withColumn("_f", F.lit(True)).unionByName(runs.withColumn("_f", F.lit(False)),
                                                          allowMissingColumns=True)
    f = F.col("_f")
    g = u.agg(
        F.sum(F.when(f, F.col("count"))).alias("total_processed"),
        F.sum(F.when(f, F.col("size"))).alias("total_size_bytes"),
        F.sum(F.when(f, F.col("records"))).alias("total_records_extracted"),
        F.sum(F.when(f, F.col("ok"))).alias("successful"),
        F.sum(F.when(f, F.col("bad"))).alias("failed"),
        F.array_sort(F.collect_list(F.when(f, F.struct("count", "file_type", F.col("size").alias("total_size")))))
        .alias("_types"),
        *[F.max(F.when(~f, F.col(c))).alias(f"w_{c}") for c in runs.columns])
    return g.select(
        F.struct(F.coalesce("total_processed", F.lit(0)).alias("total_processed"),
                 F.coalesce("total_size_bytes", F.lit(0)).alias("total_size_bytes"),
                 F.coalesce("total_records_extracted", F.lit(0)).alias("total_records_extracted"),
                 F.coalesce("successful", F.lit(0)).alias("successful"), F.coalesce("failed", F.lit(0)).alias("failed"),
                 F.transform("_types", lambda t: F.struct(t["file_type"].alias("file_type"), t["count"].alias("count"),
                                                          t["total_size"].alias("total_size"))).alias("by_type"))
        .alias("files"),
        F.struct(*[F.col(f"w_{c}").alias(c) for c in runs.columns]).alias("workflows"))


def increment_counters(target: DataFrame, deltas: DataFrame, keys: Sequence[str], counters: Sequence[str],
                       stamp: dict[str, Column] | None = None) -> DataFrame:
    """Counters kept by increment instead of read-modify-write: the deltas of
    a batch are summed per key (map-side) and added to the stored values; new
    keys start from zero."""
    d = deltas.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    old = target.select(*keys, *counters)
    add = (old.unionByName(d).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]))
    new = add.join(d.select(*keys), list(keys), "left_semi")
    if stamp:
        new = new.withColumns(stamp)
    return upsert(target, new, list(keys))


def set_read(notifications: DataFrame, ids: DataFrame, read: bool = True, key: str = "notification_id") -> DataFrame:
    """Mark notifications read or unread (M4 on their id)."""
    batch = ids.select(key).distinct().withColumn("is_read", F.lit(read))
    hits = batch.join(notifications.select(key), key, "left_semi")
    return upsert(notifications, hits, [key])
