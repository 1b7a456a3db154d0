"""Skew-proof ordered scans within groups: row numbers, ranks, running totals,
last-value carry (as-of).

A ``Window.partitionBy(key)`` puts every row of a key into one task, so a key
holding a third of the data becomes a third of the job on one core.  These
operators cut the composite sort key ``(keys, order)`` into chunks at
quantile bounds taken from a seeded sample: a hot key spans many chunks, and
rows with equal ``(keys, order)`` always share a chunk, which keeps ``rank``
and ``dense_rank`` exact across chunk borders.  Each chunk is scanned locally
(window over ``(group, chunk)``, one shuffle; the group is one struct of the
keys), a summary of at most ``groups + chunks`` rows gives the carry-in from
earlier chunks, and a join on the same ``(group, chunk)`` columns adds it
back without shuffling the big side again.  Small inputs (by Catalyst's size
estimate), and those of whose sample no key holds much more than a chunk, use a plain
window, which gives the same answer and computes the input once instead of twice.

The chunk id is a pure function of the row (a binary-search ``CASE`` tree
over literal bounds), so both branches of the plan, and any task re-run after
an executor loss, compute the same chunk for the same row.  Order
expressions are ascending.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PID = "__chunk"
SAMPLE_PER_CHUNK = 20               # sampled rows per chunk when picking bounds
HOT = 1.5                           # even shares of the sample that one key holds before chunks pay
# below this plan-size estimate, one chunk per group is cheap enough; setting
# LAKELOOM_FORCE_CHUNKS=1 takes the large-input plans everywhere (for testing them)
SMALL_INPUT_BYTES = 0 if os.environ.get("LAKELOOM_FORCE_CHUNKS") == "1" else 256 * 1024 * 1024


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _sort_key(keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
                    *[o.alias(f"o{i}") for i, o in enumerate(order)])


def chunk_bounds(df: DataFrame, keys: Sequence[str], order: Sequence[Column], num_chunks: int,
                 seed: int = 17) -> list:
    """Up to ``num_chunks - 1`` ascending, distinct bounds of the composite sort key; none
    where no key holds ``HOT`` even shares of the rows.

    The decision and the sample fraction come from Catalyst's size estimate of
    the input plan (no job); only a large input pays for sampling, one pass over
    its key columns, and the driver sees at most ``4 * SAMPLE_PER_CHUNK * num_chunks``
    rows whatever the estimate was.
    """
    est_bytes, est_rows = _estimate(df)
    if est_bytes <= SMALL_INPUT_BYTES or num_chunks <= 1:
        return []
    want = SAMPLE_PER_CHUNK * num_chunks
    frac = min(1.0, want / max(est_rows, 1))
    key = _sort_key(keys, order).alias("__k")
    # where the size estimate was low, an even part of the sample is left
    sampled = df.select(key).sample(fraction=frac, seed=seed).orderBy(F.rand(seed + 1)).limit(4 * want)
    sample = sampled.agg(F.sort_array(F.collect_list("__k"))).first()[0]
    if not sample:
        return []
    held = Counter(tuple(str(r[i]) for i in range(len(keys))) for r in sample)
    if max(held.values()) < HOT * len(sample) / num_chunks:
        return []
    bounds = []
    for i in range(1, num_chunks):
        b = sample[min(len(sample) - 1, i * len(sample) // num_chunks)]
        if not bounds or b != bounds[-1]:
            bounds.append(b)
    return bounds


def _estimate(df: DataFrame) -> tuple[int, int]:
    """(bytes, rows) from the plan statistics; unknown counts as large, so the
    skew-proof plan is the fallback."""
    est = _plan_estimate(df)
    return est if est is not None else (2 ** 62, 2 ** 62)


def _estimate_jvm(df: DataFrame) -> tuple[int, int]:
    """(bytes, rows) from the optimized plan's statistics.

    Without cost-based statistics Catalyst sizes a join as the product of its
    inputs, so the plan estimate is capped by the sum of its leaf scans (the
    data actually read).  Rows fall back to bytes / row width when no row
    count is known."""
    plan = df._jdf.queryExecution().optimizedPlan()
    stats = plan.stats()
    size = int(str(stats.sizeInBytes()))
    leaves = plan.collectLeaves()
    leaf_bytes = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if leaf_bytes > 0:
        size = min(size, leaf_bytes)
    rc = stats.rowCount()
    if rc.isDefined():
        return size, int(str(rc.get()))
    width = max(1, int(str(df._jdf.schema().defaultSize())))
    return size, size // width


def _chunk_expr(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bounds: list) -> Column:
    """Number of bounds <= the row's sort key, as a balanced CASE tree (log2 depth)."""
    if not bounds:
        return F.lit(0)
    key_type = df.select(_sort_key(keys, order).alias("__k")).schema["__k"].dataType
    row = _sort_key(keys, order)

    def lit_bound(b) -> Column:
        return F.struct(*[F.lit(b[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(key_type.fields)])

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(row < lit_bound(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(bounds))


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
             num_chunks: int | None) -> DataFrame | None:
    """The input with a chunk column, or None when one chunk per group will do
    (small input, or no hot key): callers then use a plain window, which gives the same answer."""
    n = num_chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = chunk_bounds(df, keys, order, n)
    if not bounds:
        return None
    return df.withColumn(_PID, _chunk_expr(df, keys, order, bounds))


def needs_chunks(df: DataFrame) -> bool:
    """Whether ordered scans over ``df`` are chunked (input above the size bound)."""
    return _estimate(df)[0] > SMALL_INPUT_BYTES


def _plan_estimate(df: DataFrame) -> tuple[int, int] | None:
    try:
        return _estimate_jvm(df)
    except Exception:  # noqa: BLE001 - no JVM plan handle (e.g. a remote session)
        return None


_G = "__grp"


def _with_group(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One struct column for the group keys.  Struct equality treats NULL fields
    as equal, so plain ``=`` on it is null-safe, and hash partitioning on it is
    exactly what the carry join asks for: the chunk window's exchange on
    ``(group, chunk)`` already satisfies the join, and only the small carry
    table is shuffled to meet it."""
    return df.withColumn(_G, F.struct(*[F.col(k) for k in keys]))


def _join_carry(local: DataFrame, carry: DataFrame) -> DataFrame:
    c = carry.select(F.col(_G).alias("__cg"), F.col(_PID).alias("__cpid"),
                     *[F.col(x) for x in carry.columns if x.startswith("__c_")])
    joined = local.join(c, (local[_G] == c["__cg"]) & (local[_PID] == c["__cpid"]), "left")
    return joined.drop("__cg", "__cpid")


def _carry_window() -> Window:
    return Window.partitionBy(_G).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)


def grouped_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    measures: dict[str, Column], *, inclusive: bool = True,
                    num_chunks: int | None = None) -> DataFrame:
    """Add running sums of ``measures`` within ``keys`` ordered by ``order``.

    ``order`` must be a total order inside a group (add a unique tie-break).
    ``inclusive=False`` gives the sum over strictly earlier rows.
    """
    base = df.select("*", *[m.alias(f"__m_{name}") for name, m in measures.items()])
    ranged = _chunked(base, keys, order, num_chunks)
    end = Window.currentRow if inclusive else -1
    if ranged is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return base.select(*[F.col(c) for c in df.columns],
                           *[F.coalesce(F.sum(f"__m_{n}").over(w), F.lit(0)).alias(n) for n in measures])
    ranged = _with_group(ranged, keys)
    w_local = Window.partitionBy(_G, _PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = ranged.select(
        "*", *[F.coalesce(F.sum(f"__m_{n}").over(w_local), F.lit(0)).alias(f"__l_{n}") for n in measures])
    summary = ranged.groupBy(_G, _PID).agg(*[F.sum(f"__m_{n}").alias(f"__t_{n}") for n in measures])
    carry = summary.select(_G, _PID, *[
        F.coalesce(F.sum(f"__t_{n}").over(_carry_window()), F.lit(0)).alias(f"__c_{n}") for n in measures])
    out = _join_carry(local, carry)
    return out.select(*[F.col(c) for c in df.columns],
                      *[(F.col(f"__l_{n}") + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n)
                        for n in measures])


def grouped_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out_col: str,
                 method: str = "row_number", num_chunks: int | None = None) -> DataFrame:
    """``row_number`` / ``rank`` / ``dense_rank`` within ``keys`` without a per-key task.

    For ``row_number`` the order must be total within a group.
    """
    ranged = _chunked(df, keys, order, num_chunks)
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    if ranged is None:
        return df.withColumn(out_col, fn().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    ranged = _with_group(ranged, keys)
    local = ranged.withColumn("__l", fn().over(Window.partitionBy(_G, _PID).orderBy(*order)).cast("long"))
    if method == "dense_rank":
        # distinct order values per chunk; equal values never straddle chunks
        summary = ranged.groupBy(_G, _PID).agg(F.count_distinct(F.struct(*order)).alias("__t"))
    else:
        summary = ranged.groupBy(_G, _PID).agg(F.count(F.lit(1)).alias("__t"))
    carry = summary.select(_G, _PID, F.coalesce(F.sum("__t").over(_carry_window()), F.lit(0)).alias("__c_n"))
    out = _join_carry(local, carry)
    return out.select(*[F.col(c) for c in df.columns],
                      (F.col("__l") + F.coalesce(F.col("__c_n"), F.lit(0))).cast("long").alias(out_col))


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
               values: dict[str, Column], num_chunks: int | None = None) -> DataFrame:
    """For each row, the last non-null value of each ``values`` expression at or
    before it within ``keys`` (forward fill across chunk borders)."""
    base = df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    ranged = _chunked(base, keys, order, num_chunks)
    if ranged is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return base.select(*[F.col(c) for c in df.columns],
                           *[F.last(f"__v_{n}", ignorenulls=True).over(w).alias(n) for n in values])
    ranged = _with_group(ranged, keys)
    w_local = Window.partitionBy(_G, _PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.last(f"__v_{n}", ignorenulls=True).over(w_local).alias(f"__l_{n}")
                                 for n in values])
    # last non-null value of each chunk: max_by over the order, nulls excluded
    order_key = F.struct(*order)
    summary = ranged.groupBy(_G, _PID).agg(*[
        F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), order_key)).alias(f"__t_{n}")
        for n in values])
    carry = summary.select(_G, _PID, *[
        F.last(f"__t_{n}", ignorenulls=True).over(_carry_window()).alias(f"__c_{n}") for n in values])
    out = _join_carry(local, carry)
    return out.select(*[F.col(c) for c in df.columns],
                      *[F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n in values])
