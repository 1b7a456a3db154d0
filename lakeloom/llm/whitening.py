"""Embedding whitening from a polarised covariance, in exact integers.

Components become integers x = floor(SCALE * c).  The fit list is every distinct x vector once, n of them, with
sums S.  With y = n*x - S, the centred values, one pass adds up the squares of every dimension, y_i^2, and of
every pair's sum, (y_i + y_j)^2.  Polarisation gives all cross-covariances from variances alone:
2 * cov_ij = var(x_i + x_j) - var(x_i) - var(x_j).  All sums are whole numbers: a task adds blocks of rows as
halves of ``HALF`` bits (as Python integers where a value could need more), and hands them on as limbs of
``LIMB`` bits, which Spark sums.  Only the d(d+1)/2 sums reach the driver, for ``eigh``; each covariance
is one correctly rounded division.

Results.  One row per input row and component (numbered from 1 by falling eigenvalue; at most the dimension).
Rows whose vector is null, or holds null or non-finite entries, take no part.  A vector shorter than the longest counts
as padded with zeros.  Rows that repeat an id or a vector are whitened each; a null id stays null.  Components
without variance (an eigenvalue of rounding size) have a null ``whitened``; ``explained`` is null if no
dimension varies.  Of each eigenvector the entry of largest size is positive.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, prepare, streamed

SCALE, TOP = 256, 4
#: Rows that one block adds up, bits of the halves of a value, and the bits up to which halves do.
BLOCK, HALF, MOST = 2048, 25, 50
#: Bits of a limb and limbs of a sum: long sums of limbs are exact for 2^23 tasks.
LIMB, LIMBS = 40, 6


def integers(vector: str, scale: int = SCALE) -> Column:
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(vector: str) -> Column:
    """Neither null nor holding null or non-finite entries."""
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & whole, F.lit(False))


def matrix(col: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column of longs as rows padded with zeros."""
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    dim = int(size.max(initial=0)) if dim is None else dim
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), dtype=np.int64)
    at = np.arange(dim)[None, :] < size[:, None]
    out[at] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        held.append(matrix(batch.column(0), dim))
        n += len(held[-1])
        if n >= BLOCK:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _limbs(values: list[int]) -> list[list[int]]:
    """Columns of limbs, lowest first; the highest limb keeps the sign."""
    mask = (1 << LIMB) - 1
    return [[v >> LIMB * k & mask if k < LIMBS - 1 else v >> LIMB * k for v in values] for k in range(LIMBS)]


def _whole(row, prefix: str = "l") -> int:
    return sum(int(row[f"{prefix}{k}"]) << LIMB * k for k in range(LIMBS))


LIMB_FIELDS = ", ".join(f"l{k} long" for k in range(LIMBS))


def _limb_sums() -> list[Column]:
    return [F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]


@streamed
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, vectors, largest size of an entry, limbs of the sum) of a task's vectors."""
    total, n, top = [], 0, 0
    for batch in batches:
        x = matrix(batch.column(0))
        n += len(x)
        if x.size:
            top = max(top, int(x.max()), -int(x.min()))
            total += [0] * (x.shape[1] - len(total))
            # 200 rows or so: sums of the halves fit
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            for i, (h, v) in enumerate(zip(high.tolist(), low.tolist())):
                total[i] += (h << 32) + v
    if n:
        d = max(1, len(total))
        total += [0] * (d - len(total))
        columns = [pa.array(range(d), pa.int32()), pa.array([n if i == 0 else 0 for i in range(d)], pa.int64()), pa.array([str(top)] * d, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in _limbs(total))], ["i", "n", "top", *(f"l{k}" for k in range(LIMBS))])


def centred(x: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n*x - S, as Python integers where ``wide``."""
    return x.astype(object) * n - np.array(sums, dtype=object) if wide else x * n - np.array(sums, dtype=np.int64)


@streamed
def _squares(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], wide: bool) -> Iterator[pa.RecordBatch]:
    """(i, j, limbs) with the sums of (y_i + y_j)^2 for i < j and of y_i^2 for i = j."""
    d = len(sums)
    total = [np.zeros(d - i, dtype=object) for i in range(d)]
    seen = False
    for x in _blocks(batches, d):
        seen = True
        y = centred(x, n, sums, wide)
        for i in range(d):
            z = y[:, i:] + y[:, i, None]
            z[:, 0] = y[:, i]
            if wide:
                total[i] += (z * z).sum(axis=0)
                continue
            high, low = z >> HALF, z & ((1 << HALF) - 1)
            parts = [np.einsum("ij,ij->j", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low))]
            total[i] += parts[0] * (1 << 2 * HALF) + parts[1] * (1 << HALF + 1) + parts[2]
    for i in range(d if seen else 0):
        columns = [pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in _limbs([int(v) for v in total[i]]))], ["i", "j", *(f"l{k}" for k in range(LIMBS))])


def covariances(squares: dict[tuple[int, int], int], d: int, n: int) -> np.ndarray:
    """The covariance matrix from the sums of squares, by polarisation."""
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            c = squares[i, i] if i == j else (squares[i, j] - squares[i, i] - squares[j, j]) // 2
            out[i, j] = out[j, i] = c / n ** 3                            # exact integers, rounded once
    return out


@streamed
def _whiten(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], wide: bool, long: bool, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, deviation, whitened list) of every row of (id, x); ``long``: squares of a row may need more than 62 bits."""
    from decimal import Decimal
    d, k = len(sums), axes.shape[1]
    for batch in batches:
        y = centred(matrix(batch.column(1), d), n, sums, wide)
        off = (y.astype(object) ** 2).sum(axis=1) if long else (y * y).sum(axis=1)
        w = (y / n).astype(float) @ axes
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.reshape(-1), pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(int(v)) for v in off], pa.decimal128(38, 0)), lists], ["id", "deviation", "w"])


def whiten(vectors: DataFrame, k: int = TOP, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and its first ``k`` components.

    ``deviation`` is the row's sum of (n*x - S)^2; ``identity_error`` the largest difference between the
    covariance of the fit list's whitened components and the identity, the same on every row."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = cut(vectors.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), integers(vector_col, scale).alias("x")))
    fit = cut(rows.select("x").distinct())
    found = fit.mapInArrow(_sums, f"i int, n long, top string, {LIMB_FIELDS}").groupBy("i").agg(F.sum("n").alias("n"), F.max(F.col("top").cast("decimal(38,0)")).alias("top"), *_limb_sums())
    found = sorted(found.collect(), key=lambda r: r.i)                    # a row per dimension
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not found:
        return spark.createDataFrame([], schema)
    n, d = found[0].n, len(found)
    sums = [_whole(r) for r in found]
    top = max(int(r.top) for r in found)
    wide = 2 * n * (2 * top + 1) >= 1 << MOST
    squares = fit.mapInArrow(partial(_squares, n=n, sums=sums, wide=wide), f"i int, j int, {LIMB_FIELDS}").groupBy("i", "j").agg(*_limb_sums())
    v = covariances({(r.i, r.j): _whole(r) for r in squares.collect()}, d, n)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, d)
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    live = e[:k] > d * np.finfo(float).eps * max(float(e[0]), 0.0)
    axes = u[:, :k] / np.where(live, np.sqrt(np.maximum(e[:k], 1e-300)), np.inf)
    share = [float(x / np.trace(v)) if np.trace(v) > 0 else None for x in e[:k]]
    put = partial(_whiten, n=n, sums=sums, wide=wide, long=d * (n * (2 * top + 1)) ** 2 >= 1 << 62, axes=axes)
    fields = "id long, deviation decimal(38,0), w array<double>"

    use = [i for i in range(k) if live[i]]
    done = fit.select(F.lit(None).cast("long").alias("id"), "x").mapInArrow(put, fields)
    pairs = [(i, j) for i in use for j in use if i <= j]
    error = None
    if pairs:
        got = done.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    per = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.when(F.lit(bool(live[i])), F.col("w")[i]).alias("whitened"), F.lit(share[i]).cast("double").alias("explained")) for i in range(k)])
    out = rows.mapInArrow(put, fields).select("id", "deviation", F.inline(per))
    return out.select("id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
