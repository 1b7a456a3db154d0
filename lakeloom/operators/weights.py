"""Long-only weights of greatest Sharpe ratio, for many portfolios at once (V6; V4, V5 with these weights).

Spark makes the statistics: returns per portfolio and symbol, then one row per pair of a portfolio's symbols with their
sample covariance and mean returns.  Each portfolio is then solved in one task (its pairs are the square of its
symbols, whatever the length of its history) by an active set: with some positive mean, the weights are the scaled
solution of  min y'Sy / 2 - m'y, y >= 0,  found in finitely many steps by adding the symbol whose gradient is most negative and
stepping back to the boundary when a weight would turn negative.  Without a positive mean the ratio has no
maximum inside: the best single symbol is the answer.  There is no grid and no limit on symbols.

Every symbol's variance counts with ``RIDGE`` of the mean variance more.  Without that a history shorter than the list of
symbols would leave portfolios without any risk, and no greatest ratio; with it the answer is unique.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.portfolio import TRADING_DAYS

RIDGE = 1e-8


def portfolio_returns(prices: DataFrame, by: Sequence[str]) -> DataFrame:
    """W1 per portfolio: ``prices`` has ``by``, dt, symbol and price; only dates on which all of a portfolio's symbols have a price count."""
    p = prices.where("price is not null")
    size = p.groupBy(*by).agg(F.count_distinct("symbol").alias("__all"))
    full = p.groupBy(*by, "dt").agg(F.count_distinct("symbol").alias("__n")).join(size, list(by)).where("__n = __all").select(*by, "dt")
    w = Window.partitionBy(*by, "symbol").orderBy("dt")
    kept = p.join(full, [*by, "dt"], "left_semi")
    ret = F.try_divide(F.col("price").cast("double"), F.nullif(F.lag("price").over(w), F.lit(0)).cast("double")) - 1
    return kept.select(*by, "dt", "symbol", "price", ret.alias("ret"))


def moments(rets: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per pair of a portfolio's symbols: sample covariance and both mean returns, over dates on which both have one."""
    a = rets.select(*by, "dt", F.col("symbol").alias("symbol_a"), F.col("ret").alias("ret_a"))
    b = rets.select(*by, "dt", F.col("symbol").alias("symbol_b"), F.col("ret").alias("ret_b"))
    both = F.col("ret_a").isNotNull() & F.col("ret_b").isNotNull()
    return a.join(b, [*by, "dt"]).where(both).groupBy(*by, "symbol_a", "symbol_b").agg(
        F.covar_samp("ret_a", "ret_b").alias("cov"), F.avg("ret_a").alias("mean_a"), F.avg("ret_b").alias("mean_b"))


def max_sharpe(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Weights >= 0 that sum to 1 and maximise mean'w / sqrt(w'cov w)."""
    n = len(mean)
    out = np.zeros(n)
    risk = np.sqrt(np.maximum(np.diag(cov), 0.0))
    if mean.max() <= 0:
        # mean'w <= 0 everywhere: the ratio is quasi-convex, its maximum is a corner
        ratio = np.where(risk > 0, mean / np.where(risk > 0, risk, 1.0), np.where(mean < 0, -np.inf, 0.0))
        out[int(np.argmax(ratio))] = 1.0
        return out
    cov = cov + RIDGE * np.mean(np.diag(cov)) * np.eye(n)
    y, active = np.zeros(n), np.zeros(n, dtype=bool)
    scale = np.abs(mean).max()
    for _ in range(30 * n + 30):
        gain = mean - cov @ y
        gain[active] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= 1e-12 * scale:
            break
        active[k] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(cov[np.ix_(active, active)], mean[active], rcond=None)[0]
            if (z[active] > 0).all():
                y = z
                break
            # as far as no weight turns negative; those that reach zero leave
            down = active & (z <= 0)
            step = (y[down] / np.maximum(y[down] - z[down], 1e-300)).min()
            y = y + step * (z - y)
            left = active & (y <= 1e-15 * max(y.max(), 1e-300))
            y[left] = 0.0
            active &= ~left
            if not active.any():
                break
    return y / y.sum() if y.sum() > 0 else np.eye(n)[int(np.argmax(mean))]


def optimal_weights(rets: DataFrame, by: Sequence[str]) -> DataFrame:
    """V6: (``by``, symbol, weight, ret, risk, sharpe), a row per symbol; the last three are the portfolio's, a year's.

    A symbol without two returns has no statistics and gets weight 0; a portfolio without any is left out."""
    pairs = moments(rets, by)
    kinds = dict(rets.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "symbol string, weight double, ret double, risk double, sharpe double"])

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        symbols = sorted(set(rows["symbol_a"]))
        at = {s: i for i, s in enumerate(symbols)}
        mean, cov = np.full(len(symbols), np.nan), np.full((len(symbols), len(symbols)), np.nan)
        for a, b, c, m in zip(rows["symbol_a"], rows["symbol_b"], rows["cov"], rows["mean_a"]):
            cov[at[a], at[b]] = c
            if a == b:
                mean[at[a]] = m
        told = np.isfinite(mean) & np.isfinite(np.diag(cov))
        w = np.zeros(len(symbols))
        ret = risk = sharpe = None
        if told.any():
            inside = np.nan_to_num(cov[np.ix_(told, told)])
            w[told] = max_sharpe(mean[told], (inside + inside.T) / 2)
            ret = float(w[told] @ mean[told]) * TRADING_DAYS
            risk = float(np.sqrt(max(w[told] @ inside @ w[told], 0.0)) * np.sqrt(TRADING_DAYS))
            sharpe = ret / risk if risk > 0 else None
        out = pd.DataFrame({"symbol": symbols, "weight": w, "ret": ret, "risk": risk, "sharpe": sharpe})
        for name, value in zip(by, key):
            out[name] = value
        return out[[*by, "symbol", "weight", "ret", "risk", "sharpe"]].astype({"ret": "float64", "risk": "float64", "sharpe": "float64"})

    return pairs.groupBy(*by).applyInPandas(solve, schema)


def optimality(pairs: DataFrame, weights: DataFrame, by: Sequence[str], slack: float = 1e-6) -> DataFrame:
    """(``by``, symbols, weights_sum, stationary): whether the weights meet the conditions of the maximum, from the statistics
    alone.  With g = m * (w'Sw) - (Sw) * (m'w), S with its ridge, no symbol's g is above 0, and those held have 0; where m'w <= 0, a corner is held."""
    by = list(by)
    ridge = pairs.where("symbol_a = symbol_b").groupBy(*by).agg((F.avg("cov") * RIDGE).alias("ridge"))
    w = weights.select(*by, F.col("symbol").alias("symbol_b"), F.col("weight").alias("wb"))
    row = pairs.join(w, [*by, "symbol_b"]).groupBy(*by, "symbol_a").agg(F.sum(F.col("cov") * F.col("wb")).alias("sw"), F.max(F.when(F.col("symbol_a") == F.col("symbol_b"), F.col("mean_a"))).alias("m"))
    row = row.join(weights.select(*by, F.col("symbol").alias("symbol_a"), F.col("weight").alias("wa")), [*by, "symbol_a"]).join(ridge, by)
    row = row.withColumn("sw", F.col("sw") + F.col("ridge") * F.col("wa"))
    whole = row.groupBy(*by).agg(F.sum(F.col("wa") * F.col("sw")).alias("var"), F.sum(F.col("wa") * F.col("m")).alias("gain"),
                                 F.max(F.abs("m")).alias("most"), F.sum("wa").alias("weights_sum"), F.max("wa").alias("top"), F.count("*").alias("symbols"))
    g = F.col("m") * F.col("var") - F.col("sw") * F.col("gain")
    allowed = F.lit(slack) * F.col("most") * F.col("var")
    fine = F.when(F.col("gain") <= 0, F.col("top") > 1 - slack).otherwise((g <= allowed) & ((F.col("wa") <= slack) | (g >= -allowed)))
    return row.join(whole, by).groupBy(*by, "symbols", "weights_sum").agg(F.bool_and(fine & (F.col("wa") >= 0)).alias("stationary"))
