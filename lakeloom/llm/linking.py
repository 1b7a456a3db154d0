"""Linking without all pairs: leaders of buckets, salted verification of pairs, and
distributed union-find.

A bucket (rows that share a key) of any size gives one pair per member, (leader, member).
Pairs are verified in streams sorted by leader: a leader's members are cut into salted runs,
each beginning with the leader's own text, so no task holds more than one text's set and the
row at hand.  Components come from alternating large-star and small-star steps, each an
aggregation and a join on edges written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded, cut, overlap

#: Members that one salted run of a leader verifies.
RUN = 256


def star(df: DataFrame, node: str, other: str) -> DataFrame:
    """(other, m) of every edge, m being the smallest of ``node`` and its neighbours."""
    least = df.groupBy(node).agg(F.min(other).alias("__m"))
    return df.join(least, node).select(F.col(node).alias("u"), F.col(other).alias("v"),
                                       F.least(F.col(node), F.col("__m")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b: longs), root the smallest id of its component.

    Empty edges give an empty table.  Ids are compared as numbers; self edges are ignored."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = e.union(e.select("b", "a").toDF("a", "b"))
        large = star(both, "a", "b").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = star(large, "a", "b").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(small)
        # a forest of stars: every node has one edge, and no root is a leaf
        state = new.agg(F.count("*"), F.count_distinct("a")).first()
        done = state[0] == state[1] and not new.select("a").join(new.select(F.col("b").alias("a")).distinct(), "a").limit(1).count()
        e = new
        if done:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def verified(pairs: DataFrame, texts: DataFrame, sets: Callable[[list], list[np.ndarray]]) -> DataFrame:
    """(a, b, inter, na, nb) of every pair (a, b), with exact set sizes; ``texts`` has id and text.

    Each pair costs one copy of b's text; a's text goes once to each run of RUN members."""
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("n"))
    salted = pairs.join(runs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"))
    members = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    leaders = runs.join(texts.withColumnRenamed("id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rows = members.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, salt, kind, b = (col[x].to_pylist() for x in ("a", "salt", "kind", "b"))
            found = [[], [], [], [], []]
            for i, s in enumerate(sets(col["text"].to_pylist())):
                if kind[i] == 0:
                    at, own = (a[i], salt[i]), s
                elif at == (a[i], salt[i]):
                    for out, x in zip(found, (a[i], b[i], overlap(own, s), len(own), len(s))):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b", "inter", "na", "nb"])

    return rows.mapInArrow(run, "a long, b long, inter long, na long, nb long")


def fetch(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``docs`` whose ``on`` is in ``ids``: the id side is broadcast when counted small."""
    return docs.join(bounded(ids.select(on).distinct()), on, "left_semi")
