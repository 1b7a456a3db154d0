"""Lineage of any depth (T14): what a node reaches, with hop counts, over graphs with cycles.

Semi-naive closure: a round joins only the nodes found in the round before (the frontier) with the edges and keeps those not
found yet, so a cycle ends it and every edge is used once per direction.  Each round's frontier is written to the
shared folder: plans stay short and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import ensure_checkpoint_dir


def partition_edges(msgs: DataFrame, consumed: DataFrame) -> DataFrame:
    """(kind, src, dst, messages): producer to topic partition, partition to its topic, partition to consumer group."""
    part = F.concat_ws("/", "topic", F.col("part_no").cast("string"))
    one = F.count(F.lit(1)).alias("messages")
    produced = msgs.groupBy(F.lit("produces").alias("kind"), F.col("producer_id").alias("src"), part.alias("dst")).agg(one)
    holds = msgs.groupBy(F.lit("part_of").alias("kind"), part.alias("src"), F.col("topic").alias("dst")).agg(one)
    read = consumed.groupBy(F.lit("consumes").alias("kind"), part.alias("src"), F.col("group_id").alias("dst")).agg(one)
    return produced.union(holds).union(read)


def reachable(edges: DataFrame, roots: DataFrame, direction: str = "down", max_hops: int | None = None) -> DataFrame:
    """(root, node, hops) of every node that a root reaches, itself with 0 hops included, hops being the fewest.

    ``edges`` has src and dst; ``roots`` one column of nodes.  ``direction``: ``down`` follows edges, ``up`` goes against them,
    ``both`` ignores their direction.  NULL ends are no edges.  Ends at a fixpoint, or after ``max_hops``."""
    if direction not in ("down", "up", "both"):
        raise ValueError(f"direction {direction!r}: down, up or both")
    ensure_checkpoint_dir(edges.sparkSession)
    down = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    up = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = {"down": down, "up": up, "both": down.union(up)}[direction].where("a is not null and b is not null").distinct().checkpoint()
    name = roots.columns[0]
    frontier = roots.select(F.col(name).alias("root")).where("root is not null").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).checkpoint()
    found = frontier
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        next_ = frontier.join(steps, frontier["node"] == steps["a"]).select("root", F.col("b").alias("node")).distinct()
        frontier = next_.join(found, ["root", "node"], "left_anti").withColumn("hops", F.lit(hops)).checkpoint()
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found


def lineage(edges: DataFrame, roots: DataFrame, direction: str = "both", max_hops: int | None = None) -> DataFrame:
    """(root, hops, edge columns): the edges between nodes that a root reaches, with the hops of the nearer end."""
    near = reachable(edges, roots, direction, max_hops)
    a = near.select("root", F.col("node").alias("src"), F.col("hops").alias("__a"))
    b = near.select("root", F.col("node").alias("dst"), F.col("hops").alias("__b"))
    return edges.join(a, "src").join(b, ["root", "dst"]).select("root", F.least("__a", "__b").alias("hops"), *edges.columns)
