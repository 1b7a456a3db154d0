"""Exact percentiles without gathering a group's values in one task.

``percentile`` merges a value->count map per group in one task, so a hot
group with many distinct values is one large task.  Here the value histogram
is an aggregate per (group, value) (map-side combined), cumulative counts come
from the chunked running sum (a hot group is split across tasks), and each
requested rank is found by a range test on its histogram row.  Interpolation
is linear between the values at ranks ``floor(p*(n-1))`` and ``ceil(p*(n-1))``,
the same definition as ``percentile`` / ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.scan import grouped_running, needs_chunks


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float],
                      distributed: bool | None = None) -> DataFrame:
    """Per group: one column per entry of ``ps`` (name -> fraction in [0, 1]).

    ``distributed=None`` picks by the input's plan-size estimate: small inputs
    use the one-pass ``percentile`` aggregate (same exact answer), large ones
    the histogram path.
    """
    if distributed is None:
        distributed = needs_chunks(df)
    if not distributed:
        return df.groupBy(*keys).agg(*[F.percentile(F.col(value).cast("double"), p).alias(n)
                                       for n, p in ps.items()])
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"))
    cum = grouped_running(hist, list(keys), [F.col("__v")], {"__cum": F.col("__c")})
    sizes = hist.groupBy(*[F.col(k).alias(f"__s_{k}") for k in keys]).agg(F.sum("__c").alias("__n"))
    # null-safe: a NULL group is still a group
    j = cum.join(sizes, [cum[k].eqNullSafe(sizes[f"__s_{k}"]) for k in keys]).drop(*[f"__s_{k}" for k in keys])
    lo_rank = {name: F.floor(F.lit(p) * (F.col("__n") - 1)) for name, p in ps.items()}
    hi_rank = {name: F.ceil(F.lit(p) * (F.col("__n") - 1)) for name, p in ps.items()}
    start = F.col("__cum") - F.col("__c")

    def holds(rank):
        return (start <= rank) & (rank < F.col("__cum"))

    aggs = []
    for name, p in ps.items():
        aggs += [F.max(F.when(holds(lo_rank[name]), F.col("__v"))).alias(f"__lo_{name}"),
                 F.max(F.when(holds(hi_rank[name]), F.col("__v"))).alias(f"__hi_{name}"),
                 F.max(F.lit(p) * (F.col("__n") - 1) - lo_rank[name]).alias(f"__f_{name}")]
    any_hit = F.lit(False)
    for name in ps:
        any_hit = any_hit | holds(lo_rank[name]) | holds(hi_rank[name])
    g = j.filter(any_hit).groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[
        (F.col(f"__lo_{n}").cast("double")
         + F.col(f"__f_{n}") * (F.col(f"__hi_{n}").cast("double") - F.col(f"__lo_{n}").cast("double"))).alias(n)
        for n in ps])
