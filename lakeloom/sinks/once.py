"""Exactly-once sinks for micro-batches.

A micro-batch may run again after a failure, with the same id and rows.  Both sinks here make the second
run change nothing that a reader sees.

Files: a batch overwrites the folder of its own id, rows and dead letters alike, and then sets a mark; readers take
marked batches only.  Databases: rows go to a staging table in parallel; then one transaction on one connection
moves them to the target (``INSERT ... SELECT`` inside the database) and enters the batch in a ledger table, or
finds it there and moves nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources import jdbc as JDBC


class FileSink:
    """Good rows and dead letters of a stream under ``path``; a batch counts when it is marked."""

    def __init__(self, spark: SparkSession, path: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]]):
        self.spark, self.path, self.split = spark, path.rstrip("/"), split
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, batch: DataFrame, batch_id: int) -> bool:
        """For ``foreachBatch``.  False if the batch was there already."""
        if batch_id in self.committed():
            return False
        good, bad = self.split(batch)
        good.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{self.path}/dead/batch_id={batch_id}")
        self._fs.create(self._path(f"{self.path}/marks/{batch_id}"), True).close()
        return True

    def committed(self) -> list[int]:
        p = self._path(f"{self.path}/marks")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, kind: str = "rows") -> DataFrame | None:
        """Rows (or ``dead`` letters) of the marked batches; None before the first."""
        paths = [f"{self.path}/{kind}/batch_id={b}" for b in self.committed()]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else None


def write_once(batch: DataFrame, url: str, table: str, stream: str, batch_id: int, *, batch_size: int = 1000, properties: dict | None = None) -> bool:
    """Append a micro-batch of ``stream`` to a database table once, whatever the number of calls.

    Staging rows are written by all tasks; target and ledger change in one transaction.  False if the ledger has the batch."""
    spark = batch.sparkSession
    ledger, stage = f"{table}_LEDGER", f"{table}_STAGE"
    with JDBC.connection(spark, url, properties) as db:
        if not db.has_table(ledger):
            db.run(f"CREATE TABLE {ledger} (STREAM_NAME VARCHAR(200) NOT NULL, BATCH_ID BIGINT NOT NULL, PRIMARY KEY (STREAM_NAME, BATCH_ID))")
            db.commit()
        if db.first(f"SELECT COUNT(*) FROM {ledger} WHERE STREAM_NAME = ? AND BATCH_ID = ?", stream, batch_id):
            return False
        if not db.has_table(table):
            JDBC.write_table(batch.limit(0), url, table, properties=properties)
    JDBC.write_table(batch, url, stage, mode="overwrite", batch_size=batch_size, properties=properties)
    with JDBC.connection(spark, url, properties) as db:
        columns = ", ".join(db.name(c) for c in batch.columns)
        # the ledger's key refuses a second run that got this far at the same time
        db.run(f"INSERT INTO {ledger} VALUES (?, ?)", stream, batch_id)
        db.run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}")
        db.commit()
    return True


def database_sink(url: str, table: str, stream: str, dead_letter_path: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], *,
                  batch_size: int = 1000, properties: dict | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: good rows to the database, dead letters to a folder, each batch once."""
    tag = stream.replace("/", "_").replace("=", "_").replace(":", "_")

    def sink(batch: DataFrame, batch_id: int) -> None:
        good, bad = split(batch)
        bad.write.mode("overwrite").parquet(f"{dead_letter_path}/stream={tag}/batch_id={batch_id}")
        write_once(good, url, table, stream, batch_id, batch_size=batch_size, properties=properties)
    return sink


def replayed(sink: Callable[[DataFrame, int], object], times: int = 2) -> Callable[[DataFrame, int], None]:
    """``sink`` called ``times`` times for every batch, as after failures between its write and the stream's own commit."""
    def run(batch: DataFrame, batch_id: int) -> None:
        for _ in range(times):
            sink(batch, batch_id)
    return run


def by_validity(condition) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A split into rows for which ``condition`` holds and all others (unknown counts as not)."""
    holds = F.coalesce(condition, F.lit(False))
    return lambda batch: (batch.where(holds), batch.where(~holds))
