"""Exact top-k search by inner product with a distributed M-tree.

Vectors become integers floor(SCALE * x).  With M the largest norm, x' = (x, sqrt(M^2 - |x|^2))
turns the largest inner products of a query into its nearest Euclidean neighbours, a metric.
Equal vectors are one entry that carries the k+1 smallest ids having it: no other can be in an
answer.  A bounded, documented sample (``PIVOTS``) of vectors roots the subtrees; every vector goes to its
nearest pivot, a pivot with many is cut by hash into subtrees of about ``SUBTREE`` entries, and
each subtree is built as pages: leaf pages of at most ``PAGE`` entries under inner nodes, each with its
routing vector, covering radius and distance to its parent's routing vector.

A query first searches the subtrees of its nearest pivot, which bounds its k-th distance, then those whose
lower bound, max(0, d(q, pivot) - radius), is within the bound.  In a subtree the search is
best-first: a queue by lower bound, children and leaf entries passed over by the triangle
inequality on stored parent distances before any distance is computed.  A task holds one
subtree and streams its queries.  Nothing is approximate: recall is 1.

Results.  Rows whose vector is null, or has null or non-finite components, take no part; vectors shorter than the
longest count as padded with zeros.  A query's own id is no candidate; rows that repeat an id count
once, with their best score.  Fewer than k candidates: all.  Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, prepare, streamed

SCALE = 256
PIVOTS, PER_PIVOT, SUBTREE, PAGE, FANOUT = 512, 4000, 8000, 128, 8
#: Queries that one copy of a subtree serves.
STREAM = 20_000


class Node:
    __slots__ = ("routing", "radius", "to_parent", "children", "rows")

    def __init__(self, routing, radius, to_parent, children=None, rows=None):
        self.routing, self.radius, self.to_parent, self.children, self.rows = routing, radius, to_parent, children, rows


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - p) ** 2).sum(axis=-1), 0.0))


def build(points: np.ndarray, rows: np.ndarray, routing: np.ndarray, to_parent: float) -> Node:
    """M-tree over ``points[rows]`` by splitting around far-apart routing vectors until pages are full."""
    d = _distances(points[rows], routing)
    node = Node(routing, float(d.max(initial=0.0)), to_parent)
    if len(rows) <= PAGE:
        node.rows = (rows, d)
        return node
    seeds, least = [int(np.argmax(d))], None
    for _ in range(min(FANOUT, -(-len(rows) // PAGE)) - 1):
        far = _distances(points[rows], points[rows[seeds[-1]]])
        least = far if least is None else np.minimum(least, far)
        seeds.append(int(np.argmax(least)))
    near = np.argmin(np.stack([_distances(points[rows], points[rows[s]]) for s in seeds]), axis=0)
    if np.bincount(near, minlength=len(seeds)).max() == len(rows):
        near = np.arange(len(rows)) % len(seeds)
    node.children = []
    for k, s in enumerate(seeds):
        own = rows[near == k]
        if len(own):
            r = points[rows[s]]
            node.children.append(build(points, own, r, float(_distances(routing, r))))
    return node


class Subtree:
    """One task's M-tree: integer vectors, their ids and the lifted points."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], top: float):
        self.vectors, self.ids = vectors, ids
        norm = (vectors.astype(float) ** 2).sum(axis=1)
        self.points = np.hstack([vectors, np.sqrt(np.maximum(top - norm, 0.0))[:, None]])
        self.top = top
        self.root = build(self.points, np.arange(len(ids)), self.points.mean(axis=0), 0.0)
        self.seen = 0

    def search(self, qid: int, q: np.ndarray, k: int, bound: float) -> list[tuple[int, int]]:
        """(-score, id) of up to k best candidates within distance ``bound``, best first."""
        point = np.append(q.astype(float), 0.0)
        d0 = float(_distances(self.root.routing, point))
        queue, best, n = [(max(d0 - self.root.radius, 0.0), 0, d0, self.root)], [], 0
        slack = 1e-6 * (1.0 + d0)
        while queue:
            low, _, d, node = heapq.heappop(queue)
            if low > bound + slack:
                break
            if node.rows is None:
                for c in node.children:
                    if abs(d - c.to_parent) - c.radius > bound + slack:
                        continue
                    self.seen += 1
                    dc = float(_distances(c.routing, point))
                    if dc - c.radius <= bound + slack:
                        n += 1
                        heapq.heappush(queue, (max(dc - c.radius, 0.0), n, dc, c))
                continue
            rows, to_routing = node.rows
            rows = rows[np.abs(to_routing - d) <= bound + slack]
            if not len(rows):
                continue
            self.seen += len(rows)
            score = self.vectors[rows] @ q
            if len(best) == k:
                rows, score = rows[score >= -best[-1][0]], score[score >= -best[-1][0]]
            elif len(rows) > k + 1:
                # down to the score at which k ids beside the query's own are held: an id may have many vectors
                held, least = {qid}, score.min()
                for x in np.argsort(-score, kind="stable"):
                    held.update(self.ids[rows[x]])
                    if len(held) > k:
                        least = score[x]
                        break
                rows, score = rows[score >= least], score[score >= least]
            if not len(rows):
                continue
            best = sorted(best + [(-int(s), i) for s, r in zip(score, rows) for i in self.ids[r] if i != qid])
            seen, best = best, []
            for s, i in seen:
                if len(best) < k and all(i != j for _, j in best):
                    best.append((s, i))
            if len(best) == k:
                bound = min(bound, float(np.sqrt(max(self.top_of(point) + 2.0 * best[-1][0], 0.0))))
        return best

    def top_of(self, point: np.ndarray) -> float:
        """|q|^2 + M^2: distance^2 is that less twice the score."""
        return float((point ** 2).sum()) + self.top


@streamed
def _search(batches: Iterator[pa.RecordBatch], k: int, dim: int, top: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (subtree, copy, kind): entries (kind 0, id list) build the tree, queries (kind 1) stream."""
    at, vectors, ids, tree = None, [], [], None
    for batch in batches:
        out: list[list] = [[], [], []]
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for sub, copy, kind, own, v, bound in zip(*cols):
            if at != (sub, copy):
                at, vectors, ids, tree = (sub, copy), [], [], None
            q = np.zeros(dim, dtype=np.int64)
            q[: len(v)] = v
            if kind == 0:
                vectors.append(q)
                ids.append(own)
                continue
            if not vectors:
                continue
            if tree is None:
                tree = Subtree(np.array(vectors), ids, top)
            for s, i in tree.search(own[0], q, k, np.inf if bound is None else bound):
                for col, x in zip(out, (own[0], i, -s)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])


@streamed
def _route(batches: Iterator[pa.RecordBatch], pivots, dim: int, top: float, query: bool) -> Iterator[pa.RecordBatch]:
    """Nearest pivot and distance of every vector; for a query with a bound, every pivot within it but the nearest."""
    p, radius = pivots.value
    for batch in batches:
        vs = batch.column(1).to_pylist()
        x = np.zeros((len(vs), dim + 1))
        for i, v in enumerate(vs):
            x[i, : len(v)] = v
        if not query:
            x[:, dim] = np.sqrt(np.maximum(top - (x ** 2).sum(axis=1), 0.0))
        d2 = (x ** 2).sum(axis=1)[:, None] + (p ** 2).sum(axis=1)[None, :] - 2 * x @ p.T
        d = np.sqrt(np.maximum(d2, 0.0))
        near = d.argmin(axis=1)
        if radius is None:
            rows, to = np.arange(len(vs)), near
        else:
            bound = np.array([np.inf if b is None else b for b in batch.column(2).to_pylist()])
            hit = d - radius[None, :] <= (bound + 1e-6 * (1 + d.max(axis=1)))[:, None]
            hit[np.arange(len(vs)), near] = False
            rows, to = np.nonzero(hit)
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(to, pa.int32()),
                                          pa.array(d[rows, to])], ["own", "v", "bound", "pivot", "d"])


def integers(embedding: str, scale: int = SCALE) -> Column:
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    prepare(spark)
    fine = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    rows = vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), integers(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = cut(rows.groupBy("id", "v").agg(F.max("q").alias("q")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top, dim = rows.agg(F.max(square), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not dim:
        return spark.createDataFrame([], schema)
    first = Window.partitionBy("v").orderBy("id")
    entries = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("own"))
    entries = cut(entries)
    n = entries.count()
    # the sample that roots the subtrees: at most PIVOTS vectors, by hash
    some = entries.orderBy(F.xxhash64("v"), "v").limit(max(1, min(PIVOTS, -(-n // PER_PIVOT)))).select("v").collect()
    p = np.zeros((len(some), dim + 1))
    for i, r in enumerate(some):
        p[i, : len(r.v)] = r.v
    p[:, dim] = np.sqrt(np.maximum(top - (p ** 2).sum(axis=1), 0.0))
    fields = "own array<long>, v array<long>, bound double, pivot int, d double"

    def route(df: DataFrame, radius, query: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast((p, radius))
        return df.mapInArrow(partial(_route, pivots=shared, dim=dim, top=top, query=query), fields)

    dealt = cut(route(entries.select("own", "v", F.lit(None).cast("double").alias("bound")), None, False))
    parts = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / SUBTREE).cast("int").alias("parts"), F.max("d").alias("radius"))
    radius = np.full(len(p), -np.inf)
    for r in parts.collect():                                            # at most PIVOTS rows
        radius[r.pivot] = r.radius
    parts = F.broadcast(parts.select("pivot", "parts"))
    tree = dealt.join(parts, "pivot").select(F.struct("pivot", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part")).alias("sub"), "own", "v")

    def search(queries: DataFrame) -> DataFrame:
        asked = queries.join(parts, "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = cut(asked.select(F.struct("pivot", "part").alias("sub"), "own", "v", "bound"))
        copies = asked.groupBy("sub").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("copies"))
        asks = asked.join(copies, "sub").select("sub", F.pmod(F.xxhash64("own"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "own", "v", "bound")
        held = tree.join(copies, "sub").select("sub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "own", "v",
                                               F.lit(None).cast("double").alias("bound"))
        both = held.unionByName(asks).repartition("sub", "copy").sortWithinPartitions("sub", "copy", "kind")
        both = both.select(F.struct("sub.pivot", "sub.part").cast("string").alias("sub"), "copy", "kind", "own", "v", "bound")
        return cut(both.mapInArrow(partial(_search, k=k, dim=dim, top=top), "query_id long, vec_id long, score long"))

    queries = rows.where("q").select(F.array("id").alias("own"), "v", F.lit(None).cast("double").alias("bound"))
    near = search(route(queries, None, True))
    asked = rows.where("q").withColumn("norm", square).select("id", "v", "norm")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    # a second vector of the same id may be further away: its bound is worth more, never less
    bound = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + top - 2 * F.col("score"))) + 1e-6
    again = asked.join(kth, "id", "left").select(F.array("id").alias("own"), "v", bound.alias("bound"))
    far = search(route(again, radius, True))
    best = near.union(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
