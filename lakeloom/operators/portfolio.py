"""Price-series analytics: returns, covariance, backtest, drawdown, weight search
(W1-W4, A12, V1-V6).

Prices arrive long, ``(dt, symbol, price)``, one row per symbol and day, i.e.
already aggregated from the raw feed; every window here runs over that daily
table, whose size grows with the calendar and the symbol list, not with the
raw data volume.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.scan import needs_chunks

TRADING_DAYS = 252
GRID_STEPS = 10          # weights are multiples of 1/GRID_STEPS
MAX_GRID_SYMBOLS = 12    # C(10+12-1, 11) = 352,716 candidates


def complete_prices(prices: DataFrame) -> DataFrame:
    """V2: keep dates where every symbol has a price (the reference fails on gaps).

    The symbol count is a scalar subquery (one aggregate, its value broadcast),
    complete dates an aggregate per date, and the filter a semi join on date.
    """
    p = prices.filter(F.col("price").isNotNull())
    if not needs_chunks(p):
        # a small daily table: one pass with a global window is cheaper than a subquery
        everywhere = Window.partitionBy()
        counted = p.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("dt")))
        return (counted.withColumn("_syms", F.size(F.collect_set("symbol").over(everywhere)))
                .filter(F.col("_n") == F.col("_syms")).drop("_n", "_syms"))
    n_symbols = p.agg(F.count_distinct("symbol")).scalar()
    complete = (p.groupBy("dt").agg(F.count_distinct("symbol").alias("_n"))
                .filter(F.col("_n") == n_symbols).select("dt"))
    return p.join(complete, "dt", "left_semi")


def returns(prices: DataFrame, truncate: bool = True) -> DataFrame:
    """``price / previous price - 1`` per symbol over complete dates.

    ``truncate`` casts prices to whole units first, like the reference.
    """
    p = complete_prices(prices)
    if truncate:
        p = p.withColumn("price", F.col("price").cast("long"))
    w = Window.partitionBy("symbol").orderBy("dt")
    prev = F.lag("price").over(w)
    return p.select("dt", "symbol", "price",
                    (F.try_divide(F.col("price").cast("double"), F.nullif(prev, F.lit(0)).cast("double")) - 1)
                    .alias("ret"))


def covariance(rets: DataFrame) -> DataFrame:
    """Sample covariance of returns per symbol pair (pairwise complete) and means."""
    a = rets.select("dt", F.col("symbol").alias("symbol_a"), F.col("ret").alias("ret_a"))
    b = rets.select("dt", F.col("symbol").alias("symbol_b"), F.col("ret").alias("ret_b"))
    return (a.join(b, "dt").groupBy("symbol_a", "symbol_b")
            .agg(F.covar_samp("ret_a", "ret_b").alias("cov"),
                 F.avg("ret_a").alias("mean_a"), F.avg("ret_b").alias("mean_b")))


def equal_weights(rets: DataFrame) -> DataFrame:
    """1/n per symbol; the symbol list is small, so one global window suffices."""
    syms = rets.select("symbol").distinct()
    return syms.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy()))


def backtest(rets: DataFrame, weights: DataFrame, amount: float) -> DataFrame:
    """V4: cumulative growth x weight x amount per symbol and date.

    The first date has no return: its value stays NULL, and the cumulative
    product skips it (pandas ``cumprod`` semantics).
    """
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.product(F.col("ret") + 1).over(w)
    g = rets.select("dt", "symbol", F.when(F.col("ret").isNotNull(), growth).alias("growth"))
    return (g.join(weights, "symbol")
            .select("dt", "symbol", (F.col("growth") * F.col("weight") * F.lit(float(amount))).alias("value")))


def drawdown(values: DataFrame) -> DataFrame:
    """Per-date total, running peak and drawdown ``(total - peak) / peak``."""
    total = values.groupBy("dt").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    t = total.withColumn("peak", F.max("total").over(w))
    return t.withColumn("drawdown", F.try_divide(F.col("total") - F.col("peak"), F.col("peak")))


def max_drawdown(dd: DataFrame) -> DataFrame:
    """V5: the minimum drawdown over the period (the requested limit is never a constraint)."""
    return dd.agg(F.min("drawdown").alias("max_drawdown"))


def _stats_row(rets: DataFrame) -> DataFrame:
    """One row: sorted symbols, mean returns and the flattened covariance matrix."""
    cov = covariance(rets)
    diag = F.col("symbol_a") == F.col("symbol_b")
    return cov.agg(
        F.array_sort(F.collect_list(F.when(diag, F.struct("symbol_a", "mean_a")))).alias("mu"),
        F.array_sort(F.collect_list(F.struct("symbol_a", "symbol_b", "cov"))).alias("sigma"))


def best_weights(rets: DataFrame, steps: int = GRID_STEPS) -> DataFrame:
    """V6: long-only weights on a grid (multiples of 1/steps, summing to 1) with the
    highest Sharpe ratio ``sum(w*mu)*252 / (sqrt(w'Sw)*sqrt(252))``.

    Candidates are generated from the one-row statistics by successive
    explodes (no join); the number of symbols is checked against a bound
    since the grid grows as C(steps+n-1, n-1).
    """
    stats = _stats_row(rets)
    n = stats.select(F.size("mu")).first()[0]
    if n == 0:
        return rets.sparkSession.createDataFrame([], "symbol string, weight double, ret double, risk double, "
                                                     "sharpe double")
    if n > MAX_GRID_SYMBOLS:
        raise ValueError(f"grid search over {n} symbols would need {math.comb(steps + n - 1, n - 1)} "
                         f"candidates; limit is {MAX_GRID_SYMBOLS} symbols")
    cand = stats.withColumn("_w", F.array().cast("array<int>")).withColumn("_left", F.lit(steps))
    for _ in range(n - 1):
        cand = (cand.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_left"))))
                .withColumn("_w", F.concat("_w", F.array(F.col("_x"))))
                .withColumn("_left", F.col("_left") - F.col("_x")).drop("_x"))
    cand = cand.withColumn("_w", F.concat("_w", F.array(F.col("_left"))))
    frac = 1.0 / steps
    mu = F.col("mu")
    ret = F.aggregate(F.zip_with("_w", mu, lambda w, m: w * frac * m["mean_a"]), F.lit(0.0),
                      lambda acc, x: acc + x) * TRADING_DAYS
    var = F.aggregate(
        F.transform(F.col("sigma"), lambda s, k: F.element_at("_w", (k / n).cast("int") + 1) * frac
                    * F.element_at("_w", (k % n).cast("int") + 1) * frac * s["cov"]),
        F.lit(0.0), lambda acc, x: acc + x)
    risk = F.sqrt(var) * math.sqrt(TRADING_DAYS)
    scored = cand.select("_w", "mu", ret.alias("ret"), risk.alias("risk")).withColumn(
        "sharpe", F.try_divide(F.col("ret"), F.col("risk")))
    best = scored.filter(F.col("sharpe").isNotNull()).agg(
        F.max_by(F.struct("_w", "mu", "ret", "risk", "sharpe"), F.struct("sharpe", "_w")).alias("b"))
    out = best.select(F.inline(F.arrays_zip(F.col("b.mu.symbol_a").alias("symbol"), F.col("b._w").alias("w"))),
                      F.col("b.ret").alias("ret"), F.col("b.risk").alias("risk"), F.col("b.sharpe").alias("sharpe"))
    return out.select("symbol", (F.col("w") * frac).alias("weight"), "ret", "risk", "sharpe")


def symbol_status(prices: DataFrame, requested: DataFrame) -> DataFrame:
    """V1: per requested symbol, whether any history exists."""
    counts = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"))
    j = requested.join(counts, "symbol", "left")
    return j.select("symbol", F.coalesce("n_days", F.lit(0)).alias("n_days"),
                    F.when(F.col("n_days") > 0, "Data Lookup complete").otherwise("No history found")
                    .alias("status"))
