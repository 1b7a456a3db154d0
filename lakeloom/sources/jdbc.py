"""Database reads and writes over JDBC.

Reads are split into ``num_partitions`` range fetches on a numeric column, so
each task pulls one slice; predicates (the incremental high-water mark) are
pushed into the database.  High-water marks live in a small control table in
the shared checkpoint folder.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.upsert import latest_per_key
from lakeloom.session import ensure_checkpoint_dir

DEFAULT_FETCH_SIZE = 10000      # the reference pattern's extract batch size
DEFAULT_WRITE_BATCH = 1000      # the reference pattern's stream-load batch size


def read_table(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
               partition_column: str | None = None, lower_bound=None, upper_bound=None,
               num_partitions: int | None = None, fetch_size: int = DEFAULT_FETCH_SIZE,
               properties: dict | None = None, predicates: Sequence[str] | None = None) -> DataFrame:
    """A table or a query; with a partition column the read becomes
    ``num_partitions`` parallel range queries.  Bounds default to the column's
    min/max (one small query)."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    opts = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    src = table if table is not None else f"({query}) q"
    if partition_column and num_partitions and num_partitions > 1:
        if lower_bound is None or upper_bound is None:
            b = (spark.read.format("jdbc").options(**opts)
                 .option("query", f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {src}")
                 .load().first())
            lower_bound, upper_bound = b[0], b[1]
        if lower_bound is None:
            return spark.read.format("jdbc").options(**opts).option("dbtable", src).load()
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                     "upperBound": str(upper_bound), "numPartitions": str(num_partitions)})
    r = spark.read.format("jdbc").options(**opts).option("dbtable", src)
    if predicates:
        return spark.read.jdbc(url, src, predicates=list(predicates), properties={**opts})
    return r.load()


def _marks_path(spark: SparkSession, control: str | None) -> str:
    return control or os.path.join(ensure_checkpoint_dir(spark), "sync_marks")


def read_marks(spark: SparkSession, control: str | None = None) -> dict[str, object]:
    """The marks of the last run of each table; none only if the folder isn't there or empty (a failed read is an error)."""
    path = _marks_path(spark, control)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not len(fs.listStatus(folder)):
        return {}
    df = spark.read.parquet(path)
    # of one run's several marks the longest, then greatest text: the greatest number or timestamp
    latest = df.groupBy("table_name").agg(F.max_by("mark", F.struct("run", F.length("mark"), "mark")).alias("mark"))
    return {r["table_name"]: r["mark"] for r in latest.collect()}   # one row per synced table


def write_mark(spark: SparkSession, table: str, mark, run: int, control: str | None = None) -> None:
    df = spark.createDataFrame([(table, str(mark), run)], "table_name string, mark string, run long")
    df.write.mode("append").parquet(_marks_path(spark, control))


def read_incremental(spark: SparkSession, url: str, table: str, mark_column: str, last_mark=None,
                     properties: dict | None = None, **kw) -> DataFrame:
    """Only rows past the last seen value; the filter is pushed to the database."""
    df = read_table(spark, url, table=table, properties=properties, **kw)
    if last_mark is not None:
        df = df.filter(F.col(mark_column) > F.lit(last_mark).cast(df.schema[mark_column].dataType))
    return df


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = DEFAULT_WRITE_BATCH,
                properties: dict | None = None, num_partitions: int | None = None) -> None:
    """K5 insert: distributed append in JDBC batches; ``num_partitions`` caps
    concurrent connections."""
    out = df.coalesce(num_partitions) if num_partitions else df
    (out.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size), **(properties or {}))
     .mode(mode).save())


class Database:
    """Statements on one connection of the driver, all in one transaction until ``commit``."""

    def __init__(self, spark: SparkSession, url: str, properties: dict | None = None):
        jvm = spark.sparkContext._jvm
        given = jvm.java.util.Properties()
        for k, v in (properties or {}).items():
            given.setProperty(k, str(v))
        if "driver" in (properties or {}):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
        self._connection = jvm.java.sql.DriverManager.getConnection(url, given)
        self._connection.setAutoCommit(False)
        self._dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)

    def name(self, identifier: str) -> str:
        """A column name as the database quotes it.  Tables go as they are given, as in Spark's own statements."""
        return self._dialect.quoteIdentifier(identifier)

    def has_table(self, table: str) -> bool:
        """Whether the table is there; an unquoted name is stored in upper, lower or its own case."""
        schema, _, name = table.rpartition(".")
        for case in (str, str.upper, str.lower):
            found = self._connection.getMetaData().getTables(None, case(schema) or None, case(name), None)
            try:
                if found.next():
                    return True
            finally:
                found.close()
        return False

    def _prepared(self, sql: str, values: tuple):
        statement = self._connection.prepareStatement(sql)
        for i, v in enumerate(values, 1):
            statement.setLong(i, v) if isinstance(v, int) else statement.setString(i, v)
        return statement

    def run(self, sql: str, *values) -> int:
        statement = self._prepared(sql, values)
        try:
            return statement.executeUpdate()
        finally:
            statement.close()

    def first(self, sql: str, *values):
        """The first column of the first row."""
        statement = self._prepared(sql, values)
        try:
            rows = statement.executeQuery()
            return rows.getObject(1) if rows.next() else None
        finally:
            statement.close()

    def commit(self) -> None:
        self._connection.commit()

    def close(self) -> None:
        self._connection.rollback()
        self._connection.close()


@contextmanager
def connection(spark: SparkSession, url: str, properties: dict | None = None):
    """A ``Database`` that forgets what was not committed."""
    db = Database(spark, url, properties)
    try:
        yield db
    finally:
        db.close()


def upsert_table(spark: SparkSession, batch: DataFrame, url: str, table: str, keys: Sequence[str],
                 order: str | None = None, properties: dict | None = None, staging_suffix: str = "_staging") -> None:
    """K5 upsert inside the database: the batch, one row per key, is written to a staging table by all tasks,
    and one ``MERGE`` in one transaction updates and inserts.  The target is neither read nor rewritten;
    columns that the batch lacks keep their values."""
    if not keys:
        raise ValueError("upsert requires primary key columns")
    placed = batch if order else batch.withColumn("__at", F.monotonically_increasing_id())
    rows = latest_per_key(placed, keys, [order or "__at"]).select(*[c for c in batch.columns if c != order])
    with connection(spark, url, properties) as db:
        there = db.has_table(table)
    if not there:
        write_table(rows, url, table, properties=properties)
        return
    stage = table + staging_suffix
    write_table(rows, url, stage, mode="overwrite", properties=properties)
    values = [c for c in rows.columns if c not in keys]
    with connection(spark, url, properties) as db:
        same = " AND ".join(f"t.{db.name(k)} = s.{db.name(k)}" for k in keys)
        update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f't.{db.name(c)} = s.{db.name(c)}' for c in values)} " if values else ""
        columns = ", ".join(db.name(c) for c in rows.columns)
        given = ", ".join(f"s.{db.name(c)}" for c in rows.columns)
        db.run(f"MERGE INTO {table} t USING {stage} s ON {same} {update}WHEN NOT MATCHED THEN INSERT ({columns}) VALUES ({given})")
        db.commit()


def sync_tables(spark: SparkSession, src_url: str, dst_url: str, tables: dict[str, str | None],
                sync_mode: str = "incremental", run: int = 0, control: str | None = None,
                properties: dict | None = None) -> dict[str, int]:
    """Full or incremental copy of each table (``{table: mark_column}``);
    returns the destination row count per table and advances the high-water marks."""
    if sync_mode not in ("full", "incremental"):
        raise ValueError("sync_mode must be full or incremental")
    marks = read_marks(spark, control) if sync_mode == "incremental" else {}
    copied = {}
    for table, mark_col in tables.items():
        src = read_table(spark, src_url, table=table, properties=properties)
        if mark_col and sync_mode == "incremental":
            # pin the upper mark first: the copy is the range (last, upper]
            upper = read_table(spark, src_url, query=f"SELECT MAX({mark_col}) AS m FROM {table}",
                               properties=properties).first()[0]
            if upper is None:
                copied[table] = 0
                continue
            _copy_range(spark, src, dst_url, table, mark_col, upper, marks.get(table), properties)
            write_mark(spark, table, upper, run, control)
        else:
            write_table(src, dst_url, table, mode="overwrite", properties=properties)
        copied[table] = read_table(spark, dst_url, query=f"SELECT COUNT(*) AS n FROM {table}",
                                   properties=properties).first()[0]
    return copied


MARKS_TABLE = "SYNC_MARKS"


def _copy_range(spark: SparkSession, src: DataFrame, dst_url: str, table: str, mark_col: str, upper, last, properties: dict | None) -> None:
    """Rows past the last mark, up to ``upper``, into the destination, with the new mark in the same transaction.

    The destination's own mark counts before ``last``: a run that died between its copy and the control folder's
    entry isn't copied again."""
    kind = src.schema[mark_col].dataType
    with connection(spark, dst_url, properties) as db:
        if not db.has_table(MARKS_TABLE):
            db.run(f"CREATE TABLE {MARKS_TABLE} (TABLE_NAME VARCHAR(200) NOT NULL PRIMARY KEY, LAST_MARK VARCHAR(200))")
            db.commit()
        own = db.first(f"SELECT LAST_MARK FROM {MARKS_TABLE} WHERE TABLE_NAME = ?", table)
        there = db.has_table(table)
    last = own if own is not None else last
    rows = src.filter(F.col(mark_col) <= F.lit(upper).cast(kind))
    if last is not None:
        rows = rows.filter(F.col(mark_col) > F.lit(last).cast(kind))
    if not there:
        write_table(rows.limit(0), dst_url, table, properties=properties)
    stage = f"{table}_STAGE"
    write_table(rows, dst_url, stage, mode="overwrite", properties=properties)
    with connection(spark, dst_url, properties) as db:
        columns = ", ".join(db.name(c) for c in rows.columns)
        db.run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}")
        db.run(f"DELETE FROM {MARKS_TABLE} WHERE TABLE_NAME = ?", table)
        db.run(f"INSERT INTO {MARKS_TABLE} VALUES (?, ?)", table, str(upper))
        db.commit()
