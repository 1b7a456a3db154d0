"""File sources: delimited text, JSON documents, file-backed tables, folder
listings, object-store prefixes, dataset splits and log files (S1-S5, S10,
S13, S14, S18-S21).  All are ``spark.read`` plans; nothing is read on the
driver.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "avro", "parquet", "xml", "orc", "text")


def extract_delimited(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True,
                      max_rows: int = 0, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 + A16: every cell a string; header from row 1, else ``Column_1..n`` sized by
    the first row; ``max_rows`` 0 means all.  Returns ``(rows, metadata)`` where
    metadata is one row ``(total_rows, total_columns, returned_rows)`` counted
    before the limit.  Doubled quotes are one quote, empty cells stay empty strings, and a
    quoted cell may hold line ends; ``multiline=False`` gives that up for files that are
    to be read in splits."""
    raw = (spark.read.option("sep", delimiter).option("header", str(has_header).lower())
           .option("quote", '"').option("escape", '"').option("multiLine", str(multiline).lower())
           .option("nullValue", "\u0000").option("emptyValue", "")
           .option("inferSchema", "false").option("mode", "PERMISSIVE").csv(path))
    if not has_header:
        raw = raw.toDF(*[f"Column_{i + 1}" for i in range(len(raw.columns))])
    rows = raw.limit(max_rows) if max_rows and max_rows > 0 else raw
    ncols = len(raw.columns)
    meta = raw.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(ncols).cast("long").alias("total_columns"),
        (F.least(F.col("total_rows"), F.lit(max_rows)) if max_rows and max_rows > 0 else F.col("total_rows"))
        .alias("returned_rows"))
    return rows, meta


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   sampling_ratio: float = 1.0) -> DataFrame:
    """Header + inferred types (an extra pass; give ``schema`` in production)."""
    r = spark.read.option("header", "true")
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", "true").option("samplingRatio", sampling_ratio).csv(path)


def read_json_records(spark: SparkSession, path: str, root_key: str | None = None) -> DataFrame:
    """S3: a JSON document holding an array of records under one root key."""
    doc = spark.read.option("multiLine", "true").json(path)
    if root_key is None:
        arrays = [f.name for f in doc.schema.fields if isinstance(f.dataType, T.ArrayType)]
        if len(arrays) != 1:
            return doc
        root_key = arrays[0]
    return doc.select(F.explode(root_key).alias("r")).select("r.*")


def file_table(spark: SparkSession, path: str, view: str | None = None, fmt: str | None = None) -> DataFrame:
    """A CSV or Parquet file as a table (temp view when ``view`` is given)."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", "true").option(
        "inferSchema", "true").csv(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def external_parquet_table(spark: SparkSession, table_name: str, location: str, schema_file: str | None = None,
                           sample_rows: int = 10) -> DataFrame:
    """External table over a Parquet folder, schema taken from one file
    (``<location>/0.parquet`` by default); returns a few sample rows."""
    schema_src = schema_file or os.path.join(location, "0.parquet")
    schema = spark.read.parquet(schema_src).schema
    spark.catalog.createTable(table_name, path=location, source="parquet", schema=schema)
    return spark.table(table_name).limit(sample_rows)


def list_directory(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """Files of a folder (path, size, modification time); file contents are
    never read because ``content`` is not selected."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return df.select("path", "length", "modificationTime")


def read_prefix(spark: SparkSession, uri: str, fmt: str = "parquet", file_pattern: str = "*",
                options: dict | None = None) -> DataFrame:
    """Every file under a prefix (bucket or folder) matching a glob."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {FORMATS}")
    r = spark.read.format(fmt).option("pathGlobFilter", file_pattern)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    if fmt == "csv":
        r = r.option("header", (options or {}).get("header", "true"))
    if fmt == "json":
        r = r.option("multiLine", (options or {}).get("multiLine", "false"))
    return r.load(uri)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """S14 (xml): one row per ``row_tag`` element."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_splits(spark: SparkSession, base: str) -> DataFrame:
    """A dataset landed as ``<base>/<split>/*.parquet``; the split comes from
    each row's file path (``_metadata``), so no per-split listing runs on the driver."""
    df = spark.read.parquet(os.path.join(base, "*"))
    return df.withColumn("split", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))


# ---------------------------------------------------------------- logs

# Fixed patterns: syslog (RFC 3164 style) and Apache common log lines.
SYSLOG_PATTERN = r"^(?:<(\d+)>)?(\w{3}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: (.*)$"
SYSLOG_FIELDS = ["priority", "timestamp", "host", "app", "pid", "message"]
APACHE_PATTERN = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)'
APACHE_FIELDS = ["client", "ident", "user", "timestamp", "request", "status", "size"]


def parse_log_lines(lines: DataFrame, log_format: str = "json", json_schema: T.StructType | str | None = None,
                    pattern: str | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """S21 + F15: parse ``value`` lines as json, syslog, apache or a custom regex
    (``pattern`` with one group per name in ``fields``)."""
    v = F.col("value")
    if log_format == "json":
        if json_schema is None:
            raise ValueError("json logs need a schema")
        return lines.select(F.from_json(v, json_schema).alias("_j"), *[c for c in lines.columns if c != "value"]
                            ).select("_j.*", *[c for c in lines.columns if c != "value"])
    if log_format == "syslog":
        pattern, fields = SYSLOG_PATTERN, SYSLOG_FIELDS
    elif log_format == "apache":
        pattern, fields = APACHE_PATTERN, APACHE_FIELDS
    elif pattern is None or not fields:
        raise ValueError("custom logs need a pattern and field names")
    parsed = [F.nullif(F.regexp_extract(v, pattern, i + 1), F.lit("")).alias(f) for i, f in enumerate(fields)]
    matched = v.rlike(pattern).alias("parsed")
    return lines.select(*[c for c in lines.columns if c != "value"], *parsed, matched, v.alias("raw"))


def read_logs(spark: SparkSession, locations: Sequence[str] | str, log_format: str = "json", parse: bool = True,
              add_metadata: bool = True, tags: dict | None = None, **kw) -> DataFrame:
    """Raw or parsed log lines with source file and host/app/env tags."""
    lines = spark.read.text(list(locations) if not isinstance(locations, str) else locations)
    if add_metadata:
        lines = lines.withColumn("source_file", F.col("_metadata.file_path"))
    out = parse_log_lines(lines, log_format, **kw) if parse else lines
    if add_metadata:
        out = out.withColumns({k: F.lit(v) for k, v in (tags or {}).items()})
    return out


# ---------------------------------------------------------------- landed topic reads

def bounded_topic_read(msgs: DataFrame, topic: str, partition: int, offset: int = 0, limit: int = 10) -> DataFrame:
    """``limit`` messages of one partition from ``offset`` on (top-N, not a sort)."""
    m = msgs.filter((F.col("topic") == topic) & (F.col("part_no") == partition) & (F.col("msg_offset") >= offset))
    return m.orderBy("msg_offset").limit(limit)


def partition_offsets(msgs: DataFrame) -> DataFrame:
    """Begin and end offsets per topic partition."""
    return msgs.groupBy("topic", "part_no").agg(F.min("msg_offset").alias("begin_offset"),
                                                 (F.max("msg_offset") + 1).alias("end_offset"))


def landed_records(spark: SparkSession, path: str, root_key: str | None = None,
                   filters: dict | None = None, limit: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """S19 + P9: landed REST pages (JSON) exploded to records, then parameter
    filters (equality; a list value means IN) and an optional page size."""
    df = read_json_records(spark, path, root_key)
    for k, v in (filters or {}).items():
        df = df.filter(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else (F.col(k) == v))
    if order:
        df = df.orderBy(*order)
    return df.limit(limit) if limit else df
