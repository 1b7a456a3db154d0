"""Semantic search over embedding vectors.

Queries are a bounded set of vectors (here: each label's mean embedding).
They are checked against a size bound, shipped to every task once, and each
task scores its slice of the corpus with one matrix product per Arrow batch,
keeping only a running top-k per query.  The global top-k is then a two-level
reduction (hash buckets, then per query) over at most
``partitions x queries x k`` candidates; no pair is ever materialised.
Query sets above the bound are processed in blocks, one corpus pass each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERY_VECTORS = 4096
MAX_QUERY_VALUES = 8_000_000        # floats held per task for one query block
CANDIDATE_BUCKETS = 64

_OUT = "query_id long, vec_id long, score double"


def label_centroids(emb: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean embedding per label; the average runs per (label, dimension) with
    partial aggregation, then one row per label."""
    x = emb.select(F.col(label).alias("query_id"), F.posexplode(vec).alias("i", "v"))
    per_dim = x.groupBy("query_id", "i").agg(F.avg(F.col("v").cast("double")).alias("c"))
    return (per_dim.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("_c"))
            .select(F.col("query_id").cast("long"), F.transform("_c", lambda s: s["c"]).alias("query_vec")))


def _topk_block(corpus: DataFrame, qids: np.ndarray, qmat: np.ndarray, k: int, id_col: str, vec: str
                ) -> DataFrame:
    sc = corpus.sparkSession.sparkContext
    qn = qmat / np.linalg.norm(qmat, axis=1, keepdims=True)
    b = sc.broadcast((qids, qn))

    def score(batches):
        ids_q, qn_ = b.value
        best_s = np.full((len(ids_q), 0), -np.inf)
        best_i = np.zeros((len(ids_q), 0), dtype=np.int64)
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(x, axis=1)
            s = (x @ qn_.T) / np.where(norms == 0, np.nan, norms)[:, None]     # rows x queries
            s = np.nan_to_num(s, nan=-np.inf).T                               # queries x rows
            ids = pdf[id_col].to_numpy(dtype=np.int64)
            cand_s = np.concatenate([best_s, s], axis=1)
            cand_i = np.concatenate([best_i, np.broadcast_to(ids, s.shape)], axis=1)
            if cand_s.shape[1] > k:
                # order by score desc, then id asc; keep k per query
                order = np.lexsort((cand_i, -cand_s), axis=1)[:, :k]
                cand_s = np.take_along_axis(cand_s, order, axis=1)
                cand_i = np.take_along_axis(cand_i, order, axis=1)
            best_s, best_i = cand_s, cand_i
        if best_s.shape[1] == 0:
            return
        q = np.repeat(ids_q, best_s.shape[1])
        yield pd.DataFrame({"query_id": q, "vec_id": best_i.ravel(), "score": best_s.ravel()})

    return corpus.select(id_col, vec).mapInPandas(score, _OUT)


def topk_cosine(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                vec: str = "embedding") -> DataFrame:
    """Top-``k`` corpus vectors by cosine similarity for each query vector
    (ties by id).  ``queries``: ``(query_id long, query_vec array<double>)``."""
    n = queries.count()
    if n > MAX_QUERY_VECTORS * 64:
        raise ValueError(f"{n} query vectors exceed the supported bound")
    dim = len(queries.select("query_vec").first()[0]) if n else 0
    block = max(1, min(MAX_QUERY_VECTORS, MAX_QUERY_VALUES // max(dim, 1)))
    parts = []
    for lo in range(0, n, block):
        rows = (queries.orderBy("query_id").offset(lo).limit(block).collect())   # one block, size-bounded
        qids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        qmat = np.array([r["query_vec"] for r in rows], dtype=np.float64)
        parts.append(_topk_block(corpus, qids, qmat, k, id_col, vec))
    if not parts:
        return corpus.sparkSession.createDataFrame([], _OUT + ", rank long")
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    cand = cand.filter(F.col("score") > float("-inf"))
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    lvl1 = (cand.withColumn("_b", F.xxhash64("vec_id") % CANDIDATE_BUCKETS)
            .withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_b").orderBy(*order)))
            .filter(F.col("_r") <= k).drop("_b", "_r"))
    return (lvl1.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
            .filter(F.col("rank") <= k))
