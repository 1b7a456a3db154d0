"""Table and file sinks (K1-K4, K6, K7, K10, K11) and the tracking-table writers
(M2, M5-M7).

Catalog tables are written with ``writeTo``/``saveAsTable``; an upsert never
overwrites the table it reads: the merged result goes to a staging table in
the shared folder first, then replaces the target.
"""

from __future__ import annotations

import math
import os
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.upsert import upsert
from lakeloom.schemas import DEFAULT_TIMESTAMPS, NATURAL_KEYS, TRACKING_TABLES

FILE_FORMATS = ("json", "csv", "parquet", "orc", "xml", "text", "avro")


class WriteError(ValueError):
    """A rejected write; the message lists what was wrong."""


# ---------------------------------------------------------------- shapes (K1, K2)

def json_records(df: DataFrame) -> DataFrame:
    """K1: one JSON object per row (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def pipe_text(df: DataFrame, sep: str = " | ") -> DataFrame:
    """K2: rows as pipe-joined text, NULL shown as blank; the header is its own line."""
    header = df.sparkSession.createDataFrame([(0, sep.join(df.columns))], "o int, value string")
    body = df.select(F.lit(1).alias("o"), F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                                             for c in df.columns]).alias("value"))
    return header.unionByName(body)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: Sequence[str] = (), options: dict | None = None,
                max_records_per_file: int | None = None) -> None:
    """K6: any DataFrame to any supported file format."""
    if fmt not in FILE_FORMATS:
        raise WriteError(f"unknown format {fmt!r}; expected one of {FILE_FORMATS}")
    w = df.write.format(fmt).mode(mode).options(**(options or {}))
    if fmt == "csv":
        w = w.option("header", (options or {}).get("header", "true"))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# ---------------------------------------------------------------- catalog tables (K3, K4, K7, M2)

def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def key_columns(primary_key: str | Sequence[str] | None) -> list[str]:
    """A key given as one name, a comma-separated list or a sequence, as a list of names."""
    if not primary_key:
        return []
    return [k.strip() for k in primary_key.split(",")] if isinstance(primary_key, str) else list(primary_key)


def create_table(df: DataFrame, name: str, primary_key: str | Sequence[str] | None = None, fmt: str = "parquet") -> None:
    """M2/K7: create from the frame's schema; the primary key (one column or several) is kept
    as a table property and enforced by the writers (collision check / upsert)."""
    w = df.writeTo(name).using(fmt)
    if primary_key:
        w = w.tableProperty("primary_key", ",".join(key_columns(primary_key)))
    w.create()


def append_rows(df: DataFrame, name: str) -> None:
    """Append by column name to an existing catalog table: columns the frame lacks are NULL,
    columns the table lacks are an error (they would be lost)."""
    target = df.sparkSession.table(name).schema
    unknown = sorted(set(df.columns) - set(target.fieldNames()))
    if unknown:
        raise WriteError(f"{name} has no column {', '.join(unknown)}; nothing was written")
    out = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in target.fields])
    out.write.insertInto(name)


def primary_key_of(spark: SparkSession, name: str) -> str | None:
    """The table's key as stored: column names joined by commas."""
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return props.get("primary_key")


def insert_rows(df: DataFrame, name: str, create_if_not_exists: bool = True,
                primary_key: str | Sequence[str] | None = None, collision_suffix: str | None = None) -> dict:
    """K3 + K4: append, or create when allowed.  On a table with a primary key a batch that
    collides with existing rows (semi join on the key) is written whole to ``<name>_<suffix>``
    instead; the suffix is the time in seconds unless given."""
    spark = df.sparkSession
    if df.isEmpty():
        raise WriteError("an insert needs at least one row")
    if not table_exists(spark, name):
        if not create_if_not_exists:
            raise WriteError(f"no table {name}, and creating it was not allowed")
        create_table(df, name, primary_key)
        return {"table": name, "created": True}
    keys = key_columns(primary_key or primary_key_of(spark, name))
    if keys:
        if not df.join(spark.table(name).select(*keys), keys, "left_semi").isEmpty():
            target = f"{name}_{collision_suffix or int(time.time())}"
            create_table(df, target, keys)
            return {"table": target, "created": True, "collision": True}
    append_rows(df, name)
    return {"table": name, "created": False}


def _replace_from_staging(spark: SparkSession, merged: DataFrame, name: str) -> None:
    stage = f"{name}__staging"
    merged.write.mode("overwrite").saveAsTable(stage)
    spark.table(stage).write.mode("overwrite").insertInto(name, overwrite=True)
    spark.sql(f"DROP TABLE IF EXISTS {stage}")


def upsert_rows(df: DataFrame, name: str, primary_key: str | Sequence[str], order: str | None = None) -> None:
    """M4 into a catalog table: last duplicate in the batch wins; columns the batch
    lacks keep their values."""
    spark = df.sparkSession
    if not primary_key:
        raise WriteError("an upsert needs the key columns")
    keys = key_columns(primary_key)
    if not table_exists(spark, name):
        empty = (df.drop(order) if order else df).limit(0)
        create_table(upsert(empty, df, keys, order).select(*empty.columns), name, keys)
        return
    target = spark.table(name)
    merged = upsert(target, df, keys, order).select(*target.columns)
    _replace_from_staging(spark, merged, name)


# ---------------------------------------------------------------- tracking writes (M5-M7)

def check_stats_columns(table: str, columns: Sequence[str]) -> None:
    """M5: table and column allow-lists; the error lists invalid, expected and provided columns."""
    if table not in TRACKING_TABLES:
        raise WriteError(f"{table} is no tracking table; these are: {', '.join(sorted(TRACKING_TABLES))}")
    expected = TRACKING_TABLES[table].fieldNames()
    invalid = [c for c in columns if c not in expected]
    if invalid:
        raise WriteError(f"{table} does not take {invalid} (given: {list(columns)}); it takes {expected}")


def fill_defaults(df: DataFrame, table: str) -> DataFrame:
    """M6: generated id and default timestamps when absent or NULL."""
    out = df if "id" in df.columns else df.withColumn("id", F.expr("uuid()"))
    out = out.withColumn("id", F.coalesce(F.col("id"), F.expr("uuid()")))
    for c in DEFAULT_TIMESTAMPS.get(table, []):
        out = out.withColumn(c, F.coalesce(F.col(c), F.current_timestamp()) if c in out.columns
                             else F.current_timestamp())
    return out


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the table schema; absent columns are NULL."""
    schema = TRACKING_TABLES[table]
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def stats_insert(df: DataFrame, table: str, name: str | None = None, update_if_exists: bool = False,
                 reset_timestamps_on_update: bool = False, order: str | None = None) -> DataFrame:
    """M5-M7: validate, fill defaults, then insert, or update by natural key.

    Only the provided columns change on update.  The reference also resets the
    default timestamps on every update; ``reset_timestamps_on_update`` keeps
    that behaviour.  Returns the resulting table contents.
    """
    check_stats_columns(table, [c for c in df.columns if c != order])
    spark = df.sparkSession
    name = name or table
    key = NATURAL_KEYS.get(table)
    if update_if_exists and key and table_exists(spark, name):
        batch = df
        if reset_timestamps_on_update:
            batch = batch.withColumns({c: F.current_timestamp() for c in DEFAULT_TIMESTAMPS.get(table, [])})
        target = spark.table(name)
        updated = upsert(target, batch, [key], order)
        # rows inserted by the upsert (new keys) still need an id and defaults
        merged = conform(fill_defaults(updated, table), table)
        _replace_from_staging(spark, merged, name)
    else:
        rows = conform(fill_defaults(df.drop(order) if order else df, table), table)
        if table_exists(spark, name):
            append_rows(rows, name)
        else:
            create_table(rows, name, key or "id")
    return spark.table(name)


# ---------------------------------------------------------------- maintenance

def folder_bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])


def compact(spark: SparkSession, src: str, dst: str, fmt: str = "parquet",
            target_file_bytes: int = 128 * 1024 * 1024, partition_by: Sequence[str] = ()) -> int:
    """Rewrite a folder of small files into about ``size / target`` files;
    returns the file count chosen.  Readers switch to ``dst`` afterwards."""
    n = max(1, math.ceil(folder_bytes(spark, src) / target_file_bytes))
    df = spark.read.format(fmt).load(src)
    out = df.repartition(n, *partition_by) if partition_by else df.repartition(n)
    write_files(out, dst, fmt, mode="overwrite", partition_by=partition_by)
    return n


def retention_filter(df: DataFrame, ts_col: str, keep_days: int = 30, now=None) -> DataFrame:
    """Rows whose date is within ``keep_days`` of ``now`` (default: today)."""
    ref = F.lit(now).cast("date") if now is not None else F.current_date()
    return df.filter(F.col(ts_col).cast("date") > F.date_sub(ref, keep_days))


def drop_old_partitions(spark: SparkSession, path: str, column: str, keep_after: str) -> list[str]:
    """K11 on a date-partitioned folder: delete ``column=<value>`` folders whose
    value is not after ``keep_after`` (metadata operations, no data rewrite)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    dropped = []
    if not fs.exists(p):
        return dropped
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(column + "="):
            value = name.split("=", 1)[1]
            if value <= keep_after:
                fs.delete(st.getPath(), True)
                dropped.append(os.path.join(path, name))
    return sorted(dropped)


def convert_format(spark: SparkSession, src: str, in_fmt: str, dst: str, out_fmt: str,
                   read_options: dict | None = None, write_options: dict | None = None) -> None:
    """Record-to-record format conversion (any readable format to any writable one)."""
    r = spark.read.format(in_fmt).options(**(read_options or {}))
    if in_fmt == "csv":
        r = r.option("header", (read_options or {}).get("header", "true"))
    write_files(r.load(src), dst, out_fmt, mode="overwrite", options=write_options)


def save_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int, sort_by: Sequence[str] = (),
                  mode: str = "overwrite") -> None:
    """Write a catalog table bucketed (and optionally sorted) on ``by``: later
    joins or aggregations of two tables bucketed the same way on the same keys
    read co-located buckets and skip the shuffle (e.g. submissions and file
    stats bucketed on the file name for J1/J2)."""
    w = df.write.mode(mode).format("parquet").bucketBy(buckets, *by)
    if sort_by:
        w = w.sortBy(*sort_by)
    w.saveAsTable(name)
