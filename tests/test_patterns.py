"""The ingest/transform patterns as jobs: topic -> storage, watched folder,
stream -> database with dead letters, landed drops, REST pages, files and
object storage -> database (embedded Derby, file streams, availableNow)."""

import io
import json
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.plans import patterns as PL
from lakeloom.sources import jdbc as J
from lakeloom.sources.tables import load
from lakeloom.streaming import topics as ST
from tests.conftest import SF

PROPS = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _tmp(kind):
    return tempfile.mkdtemp(prefix=f"lakeloom-{kind}-")


def _url():
    return f"jdbc:derby:memory:pl_{uuid.uuid4().hex[:8]};create=true"


def test_topic_to_storage_partitions_by_date(spark):
    src = _tmp("src") + "/e"
    e = load(spark, SF, "events")
    e.write.parquet(src)
    out, ck = _tmp("out"), _tmp("ck")
    stream = ST.file_stream(spark, src, "parquet", e.schema)
    PL.topic_to_storage(stream, out, ck).awaitTermination()
    landed = spark.read.parquet(out)
    assert landed.count() == e.count() and "dt" in landed.columns
    assert landed.select("dt").distinct().count() == e.select(F.to_date("ts")).distinct().count()


def test_watched_directory_appends_new_files(spark):
    src, out, ck = _tmp("watch"), _tmp("wout"), _tmp("wck")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    with open(os.path.join(src, "1.csv"), "w") as f:
        f.write("1,x\n2,y\n")
    with open(os.path.join(src, "skip.txt"), "w") as f:
        f.write("9,z\n")
    PL.watched_directory(spark, src, "*.csv", out, ck, schema).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    with open(os.path.join(src, "2.csv"), "w") as f:
        f.write("3,w\n")
    PL.watched_directory(spark, src, "*.csv", out, ck, schema).awaitTermination()
    assert sorted(r["a"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_stream_to_database_with_dead_letters(spark):
    src, ck, dead = _tmp("s2db"), _tmp("s2dbck"), _tmp("dead") + "/d"
    with open(os.path.join(src, "m.json"), "w") as f:
        f.write('{"ID": 1, "NAME": "a"}\nnot json\n{"ID": 2, "NAME": "b"}\n')
    url = _url()
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("NAME", T.StringType())])
    J.write_table(spark.createDataFrame([], schema), url, "MSGS", mode="overwrite", properties=PROPS)
    raw = ST.file_stream(spark, src, "text")
    PL.stream_to_database(raw, schema, url, "MSGS", ck, dead, properties=PROPS).awaitTermination()
    assert sorted(r["ID"] for r in J.read_table(spark, url, table="MSGS", properties=PROPS).collect()) == [1, 2]
    assert [r["_corrupt"] for r in spark.read.parquet(dead).collect()] == ["not json"]


def test_landed_drops_rest_and_file_patterns(spark):
    landing, out = _tmp("land"), _tmp("lout") + "/m"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.csv", "x,y")
    with open(os.path.join(landing, "drop.zip"), "wb") as f:
        f.write(buf.getvalue())
    PL.landed_drop_processing(spark, landing, "json", out)
    assert sorted(r["member"] for r in spark.read.json(out).collect()) == ["a.txt", "b.csv"]

    rest = _tmp("rest")
    with open(os.path.join(rest, "page1.json"), "w") as f:
        json.dump({"data": [{"country": "X", "year": 2024, "events": 3}, {"country": "Y", "year": 2023, "events": 1}]}, f)
    url = _url()
    n = PL.rest_to_database(spark, rest, url, "EVENTS", "data", {"country": "X"}, properties=PROPS)
    assert n == 1 and J.read_table(spark, url, table="EVENTS", properties=PROPS).count() == 1

    files = _tmp("files")
    for i in range(2):
        with open(os.path.join(files, f"f{i}.csv"), "w") as f:
            f.write("ID,V\n" + "\n".join(f"{i * 10 + j},{j}" for j in range(3)) + "\n")
    PL.files_to_database(spark, files, "*.csv", "csv", url, "LOADED", properties=PROPS)
    assert J.read_table(spark, url, table="LOADED", properties=PROPS).count() == 6
    PL.object_storage_to_database(spark, "file://" + files, "f0*", "csv", url, "OBJ", properties=PROPS)
    assert J.read_table(spark, url, table="OBJ", properties=PROPS).count() == 3
    assert PL.validate_requirements("files_to_database", {"source_directory": files}) == [
        "file_pattern", "input_format", "jdbc_url", "target_table"]
