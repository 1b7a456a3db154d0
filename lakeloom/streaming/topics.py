"""Topic tables and continuous SQL jobs on Structured Streaming (T1-T4, T7, T8,
T16, T17, T19, S15, S17).

Kafka is the production source (``readStream.format("kafka")``); the options
are built here.  When no Kafka connector is on the classpath, the same
decoding runs over a file-stream twin: JSON lines (or parquet) landed in a
folder, which is also how the tests drive these jobs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakeloom.session import scratch_path

# The default topic schema of the streaming-SQL client (five
# string fields and an event-time column), its watermark delay, table prefix
# and the formats and start modes it accepts.
DEFAULT_TOPIC_FIELDS = ["___open", "___high", "___low", "___close", "___volume"]
EVENT_TIME_FIELD = "eventTimestamp"
WATERMARK_DELAY = "3 seconds"
TABLE_PREFIX = "ssb_"
FORMATS = ("json", "csv", "avro")
START_MODES = {"earliest-offset": "earliest", "latest-offset": "latest"}


def default_topic_schema() -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in DEFAULT_TOPIC_FIELDS]
                        + [T.StructField(EVENT_TIME_FIELD, T.TimestampType())])


def table_name(name: str, use_prefix: bool = True) -> str:
    """``ssb_`` prefix unless already present or disabled."""
    return name if (not use_prefix or name.startswith(TABLE_PREFIX)) else TABLE_PREFIX + name


def resolve_catalog(spark: SparkSession, catalog: str | None) -> str:
    """Fall back to the session's current catalog when the requested one is absent."""
    names = {c.name for c in spark.catalog.listCatalogs()}
    return catalog if catalog in names else spark.catalog.currentCatalog()


def kafka_options(topic: str, bootstrap_servers: str, scan_startup_mode: str = "latest-offset",
                  additional: dict | None = None) -> dict:
    """Source options for ``readStream.format('kafka')``; records lost at the broker stop the stream
    (``additional={"failOnDataLoss": "false"}`` goes on without them)."""
    if scan_startup_mode not in START_MODES:
        raise ValueError(f"scan_startup_mode must be one of {sorted(START_MODES)}")
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic,
            "startingOffsets": START_MODES[scan_startup_mode], "failOnDataLoss": "true"}
    opts.update(additional or {})
    return opts


def reset_offsets_option(topic: str, partition_offsets: dict[int, int]) -> dict:
    """Explicit start position; must be used with a fresh checkpoint folder."""
    return {"startingOffsets": json.dumps({topic: {str(p): o for p, o in partition_offsets.items()}})}


#: Holds the text of a record that cannot be read, while decoding.
_BAD = "__bad_record"


def decode(raw: DataFrame, schema: T.StructType, format_type: str = "json", value_col: str = "value",
           bad_records: str = "dead_letter") -> DataFrame:
    """Decode a text payload into ``schema``; T8 policies:
    ``skip`` drops bad rows, ``dead_letter`` keeps them with ``_corrupt`` set
    (route them with ``split_bad_records``), ``fail`` raises on the first one."""
    if format_type not in ("json", "csv"):
        raise ValueError(f"format {format_type!r} needs its connector (e.g. from_avro); use json or csv here")
    mode = "FAILFAST" if bad_records == "fail" else "PERMISSIVE"
    payload = F.col(value_col).cast("string")
    # a record is bad when a field cannot be read as its type, or when it has none of the
    # schema's fields; null fields do not make it bad
    told = schema if mode == "FAILFAST" else T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": mode, "columnNameOfCorruptRecord": _BAD}
    if format_type == "json":
        parsed = F.from_json(payload, told, options)
    else:
        parsed = F.from_csv(payload, told.simpleString(), options)
    ok = parsed.isNotNull()
    if mode != "FAILFAST":
        ok = ok & parsed.getField(_BAD).isNull()
        if format_type == "json":
            names = F.array(*[F.lit(f.name) for f in schema.fields])
            ok = ok & F.coalesce(F.arrays_overlap(F.json_object_keys(payload), names), F.lit(False))
        parsed = F.struct(*[parsed.getField(f.name).alias(f.name) for f in schema.fields])
    out = raw.select(parsed.alias("_r"), F.when(~F.coalesce(ok, F.lit(False)), payload).alias("_corrupt"),
                     *[c for c in raw.columns if c != value_col])
    out = out.select("_r.*", *[c for c in out.columns if c != "_r"])
    if bad_records == "skip":
        out = out.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    return out


def split_bad_records(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead-letter rows) from a ``decode(..., 'dead_letter')`` frame."""
    good = decoded.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    bad = decoded.filter(F.col("_corrupt").isNotNull()).select("_corrupt")
    return good, bad


def file_stream(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | None = None,
                max_files_per_trigger: int | None = None, file_pattern: str | None = None,
                archive_dir: str | None = None) -> DataFrame:
    """A watched folder as a stream; ``archive_dir`` moves processed files away
    (``cleanSource=archive``).  ``fmt='text'`` yields one ``value`` row per line."""
    r = spark.readStream.format(fmt)
    if schema is not None and fmt != "text":
        r = r.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if file_pattern:
        r = r.option("pathGlobFilter", file_pattern)
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    return r.load(path)


def register_topic_table(spark: SparkSession, name: str, raw: DataFrame, schema: T.StructType | None = None,
                         use_prefix: bool = True, format_type: str = "json",
                         watermark: str = WATERMARK_DELAY) -> str:
    """Decode a topic stream with the given or default schema, add a watermark
    on ``eventTimestamp`` when the schema has it, expose it as a temp view."""
    schema = schema or default_topic_schema()
    df = decode(raw, schema, format_type, bad_records="skip")
    if EVENT_TIME_FIELD in schema.fieldNames():
        df = df.withColumn(EVENT_TIME_FIELD, F.col(EVENT_TIME_FIELD).cast("timestamp")).withWatermark(
            EVENT_TIME_FIELD, watermark)
    view = table_name(name, use_prefix)
    df.createOrReplaceTempView(view)
    return view


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; the landed tables carry TIMESTAMP_NTZ (read as UTC)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


@dataclass
class StreamJob:
    name: str
    sql: str
    sink_path: str
    checkpoint: str
    query: StreamingQuery | None = None


def trigger_kwargs(trigger: str | None) -> dict:
    """``'available_now'`` | ``'once'`` | an interval such as ``'5 minutes'``."""
    if trigger in (None, "available_now"):
        return {"availableNow": True}
    if trigger == "once":
        return {"once": True}
    return {"processingTime": trigger}


def start_stream_job(spark: SparkSession, name: str, sql: str, sink_path: str | None = None,
                     checkpoint: str | None = None, trigger: str | None = "available_now",
                     partition_by: Sequence[str] = (), fmt: str = "parquet") -> StreamJob:
    """A continuous SELECT over registered stream views, written to files with a
    checkpoint (exactly-once file sink).  T4: start again with the same
    checkpoint to resume; stateless SQL may change between runs."""
    sink_path = sink_path or scratch_path(spark, f"streams/{name}/data")
    checkpoint = checkpoint or scratch_path(spark, f"streams/{name}/checkpoint")
    df = spark.sql(sql)
    w = (df.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
         .queryName(name).outputMode("append").trigger(**trigger_kwargs(trigger)))
    if partition_by:
        w = w.partitionBy(*partition_by)
    job = StreamJob(name, sql, sink_path, checkpoint)
    job.query = w.start()
    return job


def stop_job(job: StreamJob) -> StreamJob:
    """T4: stop; state and offsets stay in the checkpoint folder (the savepoint)."""
    if job.query is not None and job.query.isActive:
        job.query.stop()
    return job


def restart_job(spark: SparkSession, job: StreamJob, new_sql: str | None = None,
                trigger: str | None = "available_now") -> StreamJob:
    stop_job(job)
    return start_stream_job(spark, job.name + "_r", new_sql or job.sql, job.sink_path, job.checkpoint, trigger)


def job_metrics(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per retained progress report of a query."""
    rows = [(p.get("batchId"), p.get("numInputRows"), p.get("inputRowsPerSecond"),
             p.get("processedRowsPerSecond"), (p.get("durationMs") or {}).get("triggerExecution"),
             p.get("timestamp")) for p in query.recentProgress]
    schema = ("batch_id long, input_rows long, input_rows_per_second double, processed_rows_per_second double, "
              "trigger_ms long, at string")
    return spark.createDataFrame(rows, schema)


def job_states(spark: SparkSession) -> DataFrame:
    """Active queries by state, e.g. ``{'RUNNING': 2}``."""
    rows = [(q.name, q.id and str(q.id), "RUNNING" if q.isActive else "STOPPED",
             q.status.get("message")) for q in spark.streams.active]
    df = spark.createDataFrame(rows, "name string, id string, state string, message string")
    return df.groupBy("state").agg(F.count(F.lit(1)).alias("jobs"))


# ---------------------------------------------------------------- T17

def schema_compatible(old: T.StructType, new: T.StructType) -> bool:
    """Backward compatible: every old field keeps its type, added fields are nullable."""
    old_f = {f.name: f for f in old.fields}
    for f in new.fields:
        if f.name in old_f:
            if f.dataType != old_f[f.name].dataType:
                return False
        elif not f.nullable:
            return False
    return all(n in {f.name for f in new.fields} for n in old_f)


def decode_versioned(df: DataFrame, value_col: str, version_col: str, schemas: dict[int, T.StructType]
                     ) -> DataFrame:
    """Decode each payload with the schema of its version; the output has the
    union of all versions' fields (NULL where a version lacks one)."""
    fields: dict[str, T.DataType] = {}
    for v in sorted(schemas):
        for f in schemas[v].fields:
            fields.setdefault(f.name, f.dataType)
    cols: list[Column] = []
    for name, dt in fields.items():
        expr = F.lit(None).cast(dt)
        for v in sorted(schemas, reverse=True):
            if name in schemas[v].fieldNames():
                expr = F.when(F.col(version_col) == v,
                              F.from_json(F.col(value_col), schemas[v]).getField(name)).otherwise(expr)
        cols.append(expr.alias(name))
    return df.select(*[c for c in df.columns if c != value_col], *cols)
