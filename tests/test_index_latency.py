"""Indexed substring search and latency sketches on streams."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from lakeloom.operators.text_index import TextIndex
from lakeloom.streaming import latency as L


def _tmp():
    return os.path.join(tempfile.mkdtemp(prefix="lakeloom-index-"), "t")


def _scan(rows, patterns):
    hits = rows.join(patterns, F.expr("t ilike concat('%', pattern, '%')"))
    return sorted((r.pattern_id, r.k, r.t) for r in hits.collect())


def _found(index, patterns):
    return sorted((r.pattern_id, r.k, r.t) for r in index.search(patterns).collect())


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB_%\\.é") for _ in range(rng.randrange(0, 9))) for _ in range(600)] + [None, None, "", "ΑΣ", "ΑΣΑ", "same", "same", "😀a😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(3)
    words = ["".join(rng.choice("abA_%é.") for _ in range(rng.randrange(0, 6))) for _ in range(40)]
    words += ["", "%", "_", "__", "\\%", "\\_a", "a\\\\b", "ας", "ΑΣ", "SAME", "😀", "a%b_a", "nothing like it", None, "same", "same"]
    patterns = spark.createDataFrame(list(enumerate(words)), "pattern_id int, pattern string")
    index = TextIndex.build(rows, "t", _tmp())
    got = _found(index, patterns)
    assert got == _scan(rows, patterns) and len(got) > 1000
    # rows added later are found, in the same blocks or others, and a run that died before its rows changes nothing
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts[:50])], "k long, t string")
    index._post(more.withColumn("__row", F.lit(1 << 15) + F.col("k")).withColumn("__block", F.bitmap_bucket_number("__row")), "append")
    index.append(more)
    assert _found(index, patterns) == _scan(rows.union(more), patterns)


def test_index_reads_only_blocks_that_may_match(spark):
    rows = spark.range(200_000, numPartitions=1).select(F.col("id").alias("k"), F.concat(F.lit("file_"), F.col("id").cast("string")).alias("t"))
    index = TextIndex.build(rows, "t", _tmp())
    one = spark.createDataFrame([(1, "e_199_99")], "pattern_id int, pattern string")
    left = index.candidates(one).select("__block", F.bitmap_count("bits").alias("n")).collect()
    assert 0 < sum(r.n for r in left) < 2_000
    assert [r.t for r in index.search(one).orderBy("t").collect()] == [f"file_199{i}99" for i in range(10)]


def test_index_of_nothing(spark):
    rows = spark.createDataFrame([], "k long, t string")
    patterns = spark.createDataFrame([(1, "a"), (2, "")], "pattern_id int, pattern string")
    index = TextIndex.build(rows, "t", _tmp())
    assert _found(index, patterns) == []
    index.append(spark.createDataFrame([(1, "xay"), (2, None)], "k long, t string"))
    assert _found(index, patterns) == [(1, 1, "xay"), (2, 1, "xay")]
    assert _found(index, patterns.limit(0)) == []


def test_latency_of_several_runs(spark):
    """Files come in two runs of the stream; a run on the same path goes on, and sketches of both merge."""
    base, path = _tmp(), _tmp()
    made = spark.range(2000).select(F.col("id").alias("msg_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    reads = made.select("msg_id", F.when(F.col("msg_id") % 3 == 0, "a").otherwise("b").alias("topic"), (F.col("ts") + F.make_dt_interval(secs=(F.col("msg_id") % 100))).alias("consumed_at"))
    reads = reads.union(spark.sql("select 5000000L, 'a', timestamp_seconds(1700000000)")).union(spark.sql("select null, null, null")).toDF(*reads.columns)

    def run():
        streams = [spark.readStream.schema(df.schema).parquet(f"{base}/{name}") for df, name in ((made, "made"), (reads, "reads"))]
        L.start_latency(*streams, path).awaitTermination()

    first = F.coalesce(F.col("msg_id"), F.lit(0)) < 1000
    for part in (first, ~first):
        made.where(part).write.mode("append").parquet(f"{base}/made")
        reads.where(part).write.mode("append").parquet(f"{base}/reads")
        run()
    run()                                                                       # nothing new
    got = {r.topic: r for r in L.read_latency(spark, path).collect()}
    for topic, of in (("a", 0), ("b", None)):
        ms = sorted(i % 100 * 1000 for i in range(2000) if (i % 3 == 0) == (of == 0))
        r = got[topic]
        assert r.messages == len(ms) and r.max_ms == ms[-1] and abs(r.avg_ms - sum(ms) / len(ms)) < 1e-6
        for p, x in ((0.5, r.p50_ms), (0.95, r.p95_ms), (0.99, r.p99_ms)):
            assert sum(v < x for v in ms) <= (p + L.RANK_ERROR) * len(ms) and sum(v <= x for v in ms) >= (p - L.RANK_ERROR) * len(ms)
    assert set(got) == {"a", "b"}
    assert L.read_latency(spark, _tmp()) is None
