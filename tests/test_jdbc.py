"""JDBC reads and writes against an in-process embedded Derby database (no
server, no port): partitioned reads, insert, upsert, full and incremental sync."""

import tempfile
import uuid

from pyspark.sql import functions as F

from lakeloom.plans import patterns as PL
from lakeloom.sources import jdbc as J

PROPS = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _url():
    return f"jdbc:derby:memory:db_{uuid.uuid4().hex[:8]};create=true"


def _orders(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("ID"), (F.col("id") * 1.5).alias("AMOUNT"),
                                      (F.col("id") % 3).alias("GRP"))


def test_partitioned_read_and_query(spark):
    url = _url()
    J.write_table(_orders(spark, 0, 100), url, "ORDERS", mode="overwrite", properties=PROPS)
    df = J.read_table(spark, url, table="ORDERS", partition_column="ID", num_partitions=4, properties=PROPS)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    q = J.read_table(spark, url, query="SELECT GRP, COUNT(*) AS N FROM ORDERS GROUP BY GRP", properties=PROPS)
    assert sorted(r["N"] for r in q.collect()) == [33, 33, 34]


def test_upsert_table(spark):
    url = _url()
    J.write_table(_orders(spark, 0, 5), url, "T", mode="overwrite", properties=PROPS)
    batch = spark.createDataFrame([(1, 99.0, 7), (10, 1.0, 1)], "ID long, AMOUNT double, GRP long")
    J.upsert_table(spark, batch, url, "T", ["ID"], properties=PROPS)
    got = {r["ID"]: r["AMOUNT"] for r in J.read_table(spark, url, table="T", properties=PROPS).collect()}
    assert got[1] == 99.0 and got[10] == 1.0 and len(got) == 6


def test_incremental_sync_moves_only_new_rows(spark):
    src, dst = _url(), _url()
    control = tempfile.mkdtemp(prefix="lakeloom-marks-")
    J.write_table(_orders(spark, 0, 10), src, "ORDERS", mode="overwrite", properties=PROPS)
    J.write_table(_orders(spark, 0, 0), dst, "ORDERS", mode="overwrite", properties=PROPS)
    assert PL.database_to_database(spark, src, dst, {"ORDERS": "ID"}, run=1, control=control,
                                   properties=PROPS) == {"ORDERS": 10}
    J.write_table(_orders(spark, 10, 15), src, "ORDERS", mode="append", properties=PROPS)
    assert PL.database_to_database(spark, src, dst, {"ORDERS": "ID"}, run=2, control=control,
                                   properties=PROPS) == {"ORDERS": 15}
    assert J.read_marks(spark, control) == {"ORDERS": "14"}
    ids = sorted(r["ID"] for r in J.read_table(spark, dst, table="ORDERS", properties=PROPS).collect())
    assert ids == list(range(15))


def test_database_to_lakehouse_and_files(spark):
    url = _url()
    J.write_table(_orders(spark, 0, 20), url, "SRC", mode="overwrite", properties=PROPS)
    name = "lh_" + uuid.uuid4().hex[:8]
    PL.database_to_lakehouse(spark, url, "SRC", name, partition_column="ID", num_partitions=2, properties=PROPS)
    PL.database_to_lakehouse(spark, url, "SELECT * FROM SRC WHERE ID < 5", name, properties=PROPS)
    assert spark.table(name).count() == 25
    out = tempfile.mkdtemp(prefix="lakeloom-out-") + "/json"
    PL.database_to_files(spark, url, "SRC", "json", out, properties=PROPS)
    assert spark.read.json(out).count() == 20
