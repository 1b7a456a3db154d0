"""End-to-end latency on live streams (T12): produced and consumed records meet in a stream-stream join, and
each micro-batch leaves one mergeable KLL sketch a window and key.

The join's state is bounded by the watermarks: a message waits for its reads no longer than ``max_wait``.  A micro-batch
writes its sketches under its own id (a batch that runs again changes nothing), and any range of windows, or set of keys,
is answered later by merging sketches: percentiles within the sketch's rank error, counts and maxima exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators.topics import epoch_ms
from lakeloom.sinks.once import FileSink, by_validity
from lakeloom.streaming.topics import trigger_kwargs

#: Size of a sketch (k), and the rank error that it keeps with a probability of about 0.99.
K, RANK_ERROR = 400, 0.01


def joined(produced: DataFrame, consumed: DataFrame, *, max_wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(ts, consumed_at, latency_ms, and the other columns of ``consumed``) of every read: streams with ``msg_id`` and ``ts``, ``consumed_at``.

    Reads that come before their message is produced, or more than ``max_wait`` after, match nothing."""
    p = produced.select(F.col("msg_id").alias("p_id"), "ts").withWatermark("ts", late)
    c = consumed.withWatermark("consumed_at", late)
    within = F.expr(f"msg_id = p_id AND consumed_at >= ts AND consumed_at <= ts + INTERVAL {max_wait}")
    return p.join(c, within).withColumn("latency_ms", F.round(epoch_ms("consumed_at") - epoch_ms("ts")).cast("long")).drop("p_id")


def sketched(reads: DataFrame, window: str, keys: Sequence[str], k: int = K) -> DataFrame:
    """(window_start, keys, messages, total_ms, max_ms, sketch) of a batch of reads."""
    start = F.window("consumed_at", window)["start"].alias("window_start")
    return reads.groupBy(start, *keys).agg(F.count("*").alias("messages"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"),
                                           F.kll_sketch_agg_bigint("latency_ms", F.lit(k)).alias("sketch"))


def start_latency(produced: DataFrame, consumed: DataFrame, path: str, *, window: str = "1 hour", keys: Sequence[str] = ("topic",), k: int = K,
                  max_wait: str = "1 hour", late: str = "10 minutes", trigger: str | None = "available_now") -> StreamingQuery:
    """Run the join and keep its sketches under ``path``; started again on the same path it goes on where it stopped."""
    sink = latency_sink(produced.sparkSession, path)

    def keep(batch: DataFrame, batch_id: int) -> None:
        sink.write(sketched(batch, window, keys, k), batch_id)

    stream = joined(produced, consumed, max_wait=max_wait, late=late)
    return (stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode("append")
            .trigger(**trigger_kwargs(trigger)).start())


def latency_sink(spark: SparkSession, path: str) -> FileSink:
    return FileSink(spark, f"{path}/sketches", by_validity(F.col("messages") > 0))


def read_latency(spark: SparkSession, path: str, keys: Sequence[str] = ("topic",), first=None, last=None) -> DataFrame | None:
    """(keys, messages, avg_ms, max_ms, p50_ms, p95_ms, p99_ms, sketch) over the windows that start from ``first`` to ``last``; None before the first batch."""
    rows = latency_sink(spark, path).read()
    if rows is None:
        return None
    if first is not None:
        rows = rows.where(F.col("window_start") >= F.lit(first).cast("timestamp"))
    if last is not None:
        rows = rows.where(F.col("window_start") <= F.lit(last).cast("timestamp"))
    merged = rows.groupBy(*keys).agg(F.sum("messages").alias("messages"), (F.sum("total_ms") / F.sum("messages")).alias("avg_ms"),
                                     F.max("max_ms").alias("max_ms"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    quantiles = {f"p{n}_ms": F.kll_sketch_get_quantile_bigint("sketch", F.lit(n / 100)) for n in (50, 95, 99)}
    return merged.select(*keys, "messages", "avg_ms", "max_ms", *[q.alias(n) for n, q in quantiles.items()], "sketch")
