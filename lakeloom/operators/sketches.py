"""Distinct counts that roll up (A20, A9): a stored sketch per day and key, merged over any range.

A day's users are kept as a theta sketch (union, intersection and difference of user sets) and an HLL sketch (smaller, union
only).  Any range of days, or set of keys, is answered from the stored rows without the events: sketches merge, counts don't.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithms of the entries of a theta and of an HLL sketch.
THETA_LG, HLL_LG = 12, 12


def daily_sketches(df: DataFrame, ts: str, keys: Sequence[str], item: str, theta_lg: int = THETA_LG, hll_lg: int = HLL_LG) -> DataFrame:
    """(keys, day, theta, hll): sketches of the distinct ``item`` values of each day; NULL items don't count."""
    return df.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(
        F.theta_sketch_agg(item, theta_lg).alias("theta"), F.hll_sketch_agg(item, hll_lg).alias("hll"))


def roll_up(sketches: DataFrame, keys: Sequence[str], first=None, last=None) -> DataFrame:
    """(keys, theta, hll) over the days from ``first`` to ``last``, both included."""
    rows = sketches
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    return rows.groupBy(*keys).agg(F.theta_union_agg("theta").alias("theta"), F.hll_union_agg("hll").alias("hll"))


def estimates(rolled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, by_theta, by_hll): the estimated numbers of distinct items."""
    return rolled.select(*keys, F.theta_sketch_estimate("theta").alias("by_theta"), F.hll_sketch_estimate("hll").alias("by_hll"))


def both(a: Column, b: Column) -> Column:
    """Estimated number of items in both sets."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def only_first(a: Column, b: Column) -> Column:
    """Estimated number of items in the first set only."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def bound(size: Column, lg: int = THETA_LG, of: Column | None = None, sigmas: float = 4.0) -> Column:
    """The error that ``sigmas`` standard deviations allow an estimate of ``size``, from sketches of the union ``of`` (default: the set itself)."""
    whole = size if of is None else of
    return F.lit(sigmas / math.sqrt(2 ** lg)) * F.sqrt(F.greatest(size, F.lit(1)) * F.greatest(whole, F.lit(1))) + 1
