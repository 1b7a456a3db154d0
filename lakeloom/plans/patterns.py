"""Pipeline patterns as short Spark jobs built from the operators (C9, X9, M9,
M10 and the twelve ingest/transform patterns).

Each pattern declares its required inputs; ``validate_requirements`` lists
what is missing before anything runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.inference import first_record_columns, infer_schema, typed_records
from lakeloom.operators import quality as G
from lakeloom.operators.query_builder import pivot_counts
from lakeloom.sinks import tables as K
from lakeloom.sinks.once import database_sink
from lakeloom.sources import documents as DOC
from lakeloom.sources import files as SRC
from lakeloom.sources import jdbc as JDBC
from lakeloom.streaming import topics as ST

# Pattern name -> inputs that must be given.
PATTERNS: dict[str, tuple[str, ...]] = {
    "database_to_lakehouse": ("jdbc_url", "source", "target_table"),
    "topic_to_storage": ("stream", "target_path"),
    "rest_to_database": ("landing_path", "jdbc_url", "target_table"),
    "watched_directory": ("source_directory", "file_pattern", "target_path"),
    "database_to_files": ("jdbc_url", "source", "output_format", "output_directory"),
    "files_to_database": ("source_directory", "file_pattern", "input_format", "jdbc_url", "target_table"),
    "object_storage_to_database": ("uri", "file_pattern", "input_format", "jdbc_url", "target_table"),
    "database_to_database": ("source_url", "target_url", "tables"),
    "stream_to_database": ("stream", "schema", "jdbc_url", "target_table"),
    "landed_drop_processing": ("landing_path", "output_format", "output_directory"),
    "transformation": ("source_directory", "input_format", "output_format", "output_directory"),
    "log_aggregation": ("log_locations", "log_format", "output_directory"),
    "document_to_table": ("file_path", "table_name"),
}


def validate_requirements(pattern: str, values: dict) -> list[str]:
    """The required inputs of ``pattern`` that are missing or empty."""
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {pattern!r}; known: {sorted(PATTERNS)}")
    return [k for k in PATTERNS[pattern] if values.get(k) in (None, "", [], {})]


def _require(pattern: str, values: dict) -> None:
    missing = validate_requirements(pattern, values)
    if missing:
        raise ValueError(f"{pattern}: missing required inputs {missing}")


# ---------------------------------------------------------------- lifecycle folds

def fold_lifecycle(events: DataFrame, key: str = "id", ts: str = "at") -> DataFrame:
    """A record's insert and later updates as event rows; the current
    record takes, per column, the latest non-null value (aggregate per key)."""
    cols = [c for c in events.columns if c not in (key, ts)]
    return events.groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols])


def lists_as_json(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """List columns stored as JSON text."""
    return df.withColumns({c: F.to_json(F.col(c)) for c in columns})


# ---------------------------------------------------------------- document -> table

def document_to_table(spark: SparkSession, file_path: str, table_name: str, delimiter: str = ",",
                      primary_key: str | None = None, upsert: bool = False, stats_table: str | None = None,
                      workflow_id: str | None = None) -> dict:
    """Extract a delimited file, infer types in row order, create or append
    (or upsert) the table, and record one ``file_processing_stats`` row."""
    _require("document_to_table", {"file_path": file_path, "table_name": table_name})
    rows, meta = SRC.extract_delimited(spark, file_path, delimiter)
    # row order of the extracted file: the id follows the scan's split order,
    # which for one file is its byte order, and is the same on every evaluation
    records = rows.select(F.monotonically_increasing_id().alias("row_idx"),
                          F.to_json(F.struct(*rows.columns)).alias("record"))
    # extracted cells are strings, so every column infers as TEXT (as in the reference flow)
    schema_rows = infer_schema(records).collect()          # one row per column
    cols = first_record_columns(records)
    typed = typed_records(records, schema_rows, cols)
    if upsert:
        K.upsert_rows(typed, table_name, primary_key, order="row_idx")
    else:
        K.insert_rows(typed.drop("row_idx"), table_name, primary_key=primary_key)
    m = meta.first()
    if stats_table:
        stat = spark.createDataFrame(
            [(file_path.rsplit("/", 1)[-1], "csv", int(m["total_rows"]), "completed", workflow_id)],
            "file_name string, file_type string, records_extracted int, processing_status string, "
            "workflow_id string")
        K.stats_insert(stat, "file_processing_stats", name=stats_table)
    return {"table": table_name, "rows": int(m["total_rows"]), "columns": int(m["total_columns"])}


# ---------------------------------------------------------------- the twelve patterns

def database_to_lakehouse(spark: SparkSession, jdbc_url: str, source: str, target_table: str,
                          partition_column: str | None = None, num_partitions: int | None = None,
                          properties: dict | None = None) -> None:
    """S11 -> K7: a table or query copied into a catalog table."""
    is_query = source.strip().lower().startswith("select")
    df = JDBC.read_table(spark, jdbc_url, table=None if is_query else source, query=source if is_query else None,
                         partition_column=partition_column, num_partitions=num_partitions, properties=properties)
    if K.table_exists(spark, target_table):
        K.append_rows(df, target_table)
    else:
        K.create_table(df, target_table)


def topic_to_storage(stream: DataFrame, target_path: str, checkpoint: str, ts_col: str = "ts",
                     fmt: str = "parquet", trigger: str | None = "available_now"):
    """S17 -> K8: a topic to date-partitioned columnar files with a checkpoint."""
    out = stream.withColumn("dt", F.to_date(ts_col))
    return (out.writeStream.format(fmt).option("path", target_path).option("checkpointLocation", checkpoint)
            .partitionBy("dt").trigger(**ST.trigger_kwargs(trigger)).start())


def rest_to_database(spark: SparkSession, landing_path: str, jdbc_url: str, target_table: str,
                     root_key: str | None = None, filters: dict | None = None, properties: dict | None = None) -> int:
    """S19 -> K5: landed API pages, exploded and filtered, appended to a table."""
    df = SRC.landed_records(spark, landing_path, root_key, filters)
    JDBC.write_table(df, jdbc_url, target_table, properties=properties)
    return df.count()


def watched_directory(spark: SparkSession, source_directory: str, file_pattern: str, target_path: str,
                      checkpoint: str, schema, fmt: str = "csv", archive_dir: str | None = None,
                      trigger: str | None = "available_now"):
    """S15 -> K6: new files in a folder are appended to a target as they arrive."""
    s = ST.file_stream(spark, source_directory, fmt, schema, file_pattern=file_pattern, archive_dir=archive_dir)
    return (s.writeStream.format("parquet").option("path", target_path).option("checkpointLocation", checkpoint)
            .trigger(**ST.trigger_kwargs(trigger)).start())


def database_to_files(spark: SparkSession, jdbc_url: str, source: str, output_format: str, output_directory: str,
                      properties: dict | None = None) -> None:
    """S11 -> K6."""
    is_query = source.strip().lower().startswith("select")
    df = JDBC.read_table(spark, jdbc_url, table=None if is_query else source, query=source if is_query else None,
                         properties=properties)
    K.write_files(df, output_directory, output_format, mode="overwrite")


def files_to_database(spark: SparkSession, source_directory: str, file_pattern: str, input_format: str,
                      jdbc_url: str, target_table: str, mode: str = "insert", keys: Sequence[str] = (),
                      properties: dict | None = None, row_tag: str | None = None) -> None:
    """S14 -> K5 (insert or upsert)."""
    opts = {"rowTag": row_tag} if row_tag else None
    df = SRC.read_prefix(spark, source_directory, input_format, file_pattern, opts)
    if mode == "upsert":
        JDBC.upsert_table(spark, df, jdbc_url, target_table, list(keys), properties=properties)
    else:
        JDBC.write_table(df, jdbc_url, target_table, properties=properties)


def object_storage_to_database(spark: SparkSession, uri: str, file_pattern: str, input_format: str, jdbc_url: str,
                               target_table: str, properties: dict | None = None) -> None:
    """S13 -> K5."""
    df = SRC.read_prefix(spark, uri, input_format, file_pattern)
    JDBC.write_table(df, jdbc_url, target_table, properties=properties)


def database_to_database(spark: SparkSession, source_url: str, target_url: str, tables: dict[str, str | None],
                         sync_mode: str = "incremental", run: int = 0, control: str | None = None,
                         properties: dict | None = None) -> dict[str, int]:
    """M12."""
    return JDBC.sync_tables(spark, source_url, target_url, tables, sync_mode, run, control, properties)


def stream_to_database(stream: DataFrame, schema, jdbc_url: str, target_table: str, checkpoint: str,
                       dead_letter_path: str, value_col: str = "value", batch_size: int = 1000,
                       properties: dict | None = None, trigger: str | None = "available_now"):
    """S17 -> T8 -> K9: decode, send bad records to a dead-letter folder, move good
    ones to the database through a staging table; a micro-batch that runs again adds nothing."""
    decoded = ST.decode(stream, schema, "json", value_col, bad_records="dead_letter")
    sink = database_sink(jdbc_url, target_table, checkpoint[-200:], dead_letter_path, ST.split_bad_records, batch_size=batch_size, properties=properties)
    return (decoded.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**ST.trigger_kwargs(trigger)).start())


def landed_drop_processing(spark: SparkSession, landing_path: str, output_format: str, output_directory: str,
                           file_pattern: str = "*.zip") -> None:
    """S16 -> G7 -> K6: archives dropped in a landing folder, unpacked to members."""
    members = DOC.zip_members(DOC.binary_files(spark, landing_path, file_pattern))
    K.write_files(members, output_directory, output_format, mode="overwrite")


def transformation(spark: SparkSession, source_directory: str, input_format: str, output_format: str,
                   output_directory: str, rules: Sequence[tuple[str, Column]] = (),
                   updates: dict[str, Column] | None = None, pivot: tuple[Column, str, list] | None = None,
                   dead_letter_directory: str | None = None, file_pattern: str = "*") -> None:
    """S14 -> G3/G5 -> A18 -> T8 -> K6: validate, update fields, optionally pivot;
    invalid rows go to a dead-letter folder."""
    df = SRC.read_prefix(spark, source_directory, input_format, file_pattern)
    if rules:
        df = G.validate(df, list(rules))
        if dead_letter_directory:
            K.write_files(df.filter(~F.col("valid")), dead_letter_directory, "json", mode="overwrite")
        df = df.filter(F.col("valid")).drop("valid", "errors")
    if updates:
        df = G.update_fields(df, updates)
    if pivot:
        df = pivot_counts(df, *pivot)
    K.write_files(df, output_directory, output_format, mode="overwrite")


def log_aggregation(spark: SparkSession, log_locations: Sequence[str], log_format: str, output_directory: str,
                    tags: dict | None = None, retention_days: int = 30, target_file_bytes: int = 128 << 20,
                    ts_col: str | None = None, now=None, **parse_kw) -> DataFrame:
    """S21 -> F15 -> G6 -> K10 -> K11: parse, tag, keep ``retention_days`` and
    write a compacted output (file count from input size)."""
    logs = SRC.read_logs(spark, log_locations, log_format, parse=True, add_metadata=True, tags=tags, **parse_kw)
    if ts_col:
        logs = K.retention_filter(logs, ts_col, retention_days, now)
    size = sum(K.folder_bytes(spark, p) for p in log_locations)
    n = max(1, -(-size // target_file_bytes))
    K.write_files(logs.repartition(n), output_directory, "parquet", mode="overwrite")
    return spark.read.parquet(output_directory)
