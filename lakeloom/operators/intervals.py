"""Interval-overlap joins and concurrency (J8), without pairing what doesn't overlap.

Times are whole units.  A half-open interval [lo, hi) is cut into its canonical dyadic blocks: at most two blocks of each
size 2^k, disjoint, together the interval.  A point lies in one block of each size, so an equi-join on (keys, size, block)
meets exactly the intervals that hold the point, each once.  Two intervals overlap when the later start lies in the
other one: two such joins, with the equal starts in one of them, give every overlapping pair once and no other.

Concurrency is a sweep over starts and ends.  Changes are added up per instant, and prefix sums are taken in blocks of ``SPAN``
instants, then of blocks, and so on: a block has at most ``SPAN`` rows whatever the number of intervals, so no key or
busy day gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Instants, or blocks of the level below, that one block adds up.
SPAN = 1024


def dyadic_blocks(lo: Column, hi: Column, levels: int) -> Column:
    """The canonical blocks (size exponent, block) of [lo, hi); ``levels`` covers the longest interval."""
    def at(k: Column) -> Column:
        # ceil(lo / 2^k) and floor(hi / 2^k)
        left, right = -F.call_function("shiftright", -lo, k), F.call_function("shiftright", hi, k)
        open_ = left < right
        return F.array_compact(F.array(F.when(open_ & (F.pmod(left, F.lit(2)) == 1), F.struct(k.alias("k"), left.alias("b"))),
                                       F.when(open_ & (F.pmod(right, F.lit(2)) == 1), F.struct(k.alias("k"), (right - 1).alias("b")))))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def point_blocks(t: Column, levels: int) -> Column:
    """The block of each size that holds ``t``."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("k"), F.call_function("shiftright", t, k).alias("b")))


def overlap_join(left: DataFrame, right: DataFrame, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of a left and a right row of equal ``keys`` whose intervals [lo, hi) share an instant, as structs ``l`` and ``r``.

    ``lo`` and ``hi`` are whole numbers.  Empty intervals (lo >= hi), NULL bounds and NULL keys are in no pair.  Repeated rows pair each."""
    keys = list(keys)

    def ready(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.struct(*df.columns).alias(side), *[F.col(k).alias(f"__{k}") for k in keys], F.col(lo).cast("long").alias("__lo"), F.col(hi).cast("long").alias("__hi"))
        return rows.where("__lo < __hi")
    a, b = ready(left, "l"), ready(right, "r")
    longest = a.select("__lo", "__hi").union(b.select("__lo", "__hi")).agg(F.max(F.col("__hi") - F.col("__lo"))).first()[0]
    levels = max(0, int(longest or 1).bit_length() - 1)
    on = [*[f"__{k}" for k in keys], "k", "b"]

    def within(points: DataFrame, holders: DataFrame, side: str, other: str) -> DataFrame:
        p = points.select(side, *[f"__{k}" for k in keys], F.inline(point_blocks(F.col("__lo"), levels)), F.col("__lo").alias("__t"))
        h = holders.select(other, *[f"__{k}" for k in keys], F.inline(dyadic_blocks(F.col("__lo"), F.col("__hi"), levels)))
        # Catalyst's size of either side is that of the rows before they are cut into blocks, many times too small: never broadcast
        return p.join(h.hint("merge"), on).select("l", "r")
    # a start of the right side in [lo, hi) of the left; a start of the left side in (lo, hi) of the right
    later = within(b, a, "r", "l")
    inside = b.withColumn("__lo", F.col("__lo") + 1).where("__lo < __hi")
    return later.union(within(a, inside, "l", "r"))


def _prefix(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, t, d; one row per t) with ``open``, the sum of d up to and with t."""
    spans = points.withColumn("__b", F.floor(F.col("t") / SPAN).cast("long"))
    w = Window.partitionBy(*keys, "__b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    local = spans.withColumn("__own", F.sum("d").over(w))
    # at most SPAN rows of the level below make one here
    totals = spans.groupBy(*keys, "__b").agg(F.sum("d").alias("d"))
    found = totals.agg(F.min("__b"), F.max("__b")).first()
    upper = totals.withColumnRenamed("__b", "t")
    if found[0] is None or found[0] == found[1]:
        before = upper.withColumn("__before", F.lit(0).cast("long"))
    else:
        before = _prefix(upper, keys).withColumn("__before", F.col("open") - F.col("d"))
    before = before.select(*[F.col(k).alias(f"__p_{k}") for k in keys], F.col("t").alias("__at"), "__before")
    on = [local[k].eqNullSafe(before[f"__p_{k}"]) for k in keys] + [local["__b"] == before["__at"]]
    return local.join(before, on).select(*keys, "t", "d", (F.col("__own") + F.col("__before")).alias("open"))


def concurrency(df: DataFrame, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, open): the number of intervals [lo, hi) open from each instant on at which it may change.

    A NULL ``hi`` never ends.  Empty intervals and NULL starts don't count."""
    keys = list(keys)
    rows = df.where(F.col(lo).isNotNull() & (F.col(hi).isNull() | (F.col(lo) < F.col(hi))))
    starts = rows.select(*keys, F.col(lo).cast("long").alias("t"), F.lit(1).cast("long").alias("d"))
    ends = rows.where(F.col(hi).isNotNull()).select(*keys, F.col(hi).cast("long").alias("t"), F.lit(-1).cast("long").alias("d"))
    return _prefix(starts.union(ends).groupBy(*keys, "t").agg(F.sum("d").alias("d")), keys).drop("d")


def peaks(df: DataFrame, lo: str, hi: str, period: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, period_no, peak): the most intervals open at once in each period of ``period`` units that holds a change.

    What is open when a period begins counts in it."""
    keys = list(keys)
    open_ = concurrency(df, lo, hi, keys)
    number = F.floor(F.col("t") / period).cast("long")
    own = open_.groupBy(*keys, number.alias("period_no")).agg(F.max("open").alias("most"), F.max_by("open", "t").alias("last"))
    # what was open at the end of the period before that has a change; a row a period
    w = Window.partitionBy(*keys).orderBy("period_no")
    # a change at the period's first instant leaves nothing over from before
    first = open_.groupBy(*keys, number.alias("period_no")).agg((F.min("t") > F.min(number) * period).alias("later"))
    both = own.join(first.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("period_no").alias("__p"), "later"),
                    [own[k].eqNullSafe(F.col(f"__{k}")) for k in keys] + [own["period_no"] == F.col("__p")])
    before = F.when(F.col("later"), F.coalesce(F.lag("last").over(w), F.lit(0))).otherwise(F.lit(0))
    return both.select(*keys, "period_no", F.greatest("most", before).alias("peak"))
