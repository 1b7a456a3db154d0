"""Join shapes Spark has no single operator for: as-of and band (interval) joins,
plus ordered analytics (lag/lead/first/ntile) without per-key tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.scan import carry_last, grouped_rank, grouped_running, needs_chunks


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              right_cols: Sequence[str], tie: str | None = None, prefix: str = "asof_") -> DataFrame:
    """For each left row, the right row with the greatest ``right_time <= left_time``
    and equal ``keys`` (ties by greatest ``tie``); right columns NULL when none.

    Both sides are unioned and scanned in time order per key with the chunked
    forward fill, so a hot key is split across tasks and nothing pairs rows.
    """
    lcols = left.columns
    tie_col = F.col(tie) if tie else F.lit(0)
    r = right.select(*[F.col(k) for k in keys], F.col(right_time).alias("__t"), F.lit(0).alias("__side"),
                     tie_col.cast("long").alias("__tie"),
                     F.struct(*[F.col(c).alias(c) for c in right_cols]).alias("__val"))
    l_ = left.select(*[F.col(k) for k in keys], F.col(left_time).alias("__t"), F.lit(1).alias("__side"),
                     F.lit(None).cast("long").alias("__tie"),
                     F.lit(None).cast(r.schema["__val"].dataType).alias("__val"),
                     F.struct(*[F.col(c).alias(c) for c in lcols]).alias("__row"))
    u = l_.unionByName(r, allowMissingColumns=True)
    # right rows sort before left rows at equal time (<=), greater tie last
    filled = carry_last(u, keys, [F.col("__t"), F.col("__side"), F.col("__tie")], {"__hit": F.col("__val")})
    out = filled.filter(F.col("__side") == 1)
    return out.select(*[F.col(f"__row.{c}").alias(c) for c in lcols],
                      *[F.col(f"__hit.{c}").alias(prefix + c) for c in right_cols])


def band_join_count(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
                    before_seconds: int, left_id: str, measures: dict[str, Column] | None = None,
                    inclusive_end: bool = False) -> DataFrame:
    """Per left row, aggregate the right rows with equal ``keys`` and
    ``left_time - before <= right_time < left_time`` (``<=`` with
    ``inclusive_end``, which is a RANGE frame ending at the current row, peers included).

    Both sides are bucketed by time (bucket width = the band), the left side is
    replicated to its own and the previous bucket, and the join is an equi-join
    on ``(keys, bucket)`` with the exact band as a residual condition: a hot key
    is split by time bucket, and each left row meets only two buckets.
    """
    w = before_seconds
    lt = F.col(left_time).cast("timestamp").cast("long")
    rt = F.col(right_time).cast("timestamp").cast("long")
    lb = left.select(*keys, left_id, F.col(left_time).alias("__lt"),
                     F.explode(F.array(F.floor(lt / w), F.floor(lt / w) - 1)).alias("__b"))
    rb = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(right_time).alias("__rt"),
                      F.floor(rt / w).alias("__rb"), *(
                          [v.alias(f"__m_{n}") for n, v in (measures or {}).items()]))
    cond = [lb[k] == rb[f"__r_{k}"] for k in keys] + [lb["__b"] == rb["__rb"]]
    upper = rb["__rt"] <= lb["__lt"] if inclusive_end else rb["__rt"] < lb["__lt"]
    cond += [rb["__rt"] >= lb["__lt"] - F.make_dt_interval(secs=F.lit(w)), upper]
    j = lb.join(rb, cond, "left")
    aggs = [F.count("__rb").alias("matches")]
    aggs += [F.sum(f"__m_{n}").alias(n) for n in (measures or {})]
    return j.groupBy(*keys, left_id).agg(*aggs)


def ordered_analytics(df: DataFrame, key: str, order: Sequence[Column], value: str, tiles: int = 4,
                      id_cols: Sequence[str] = ()) -> DataFrame:
    """``row_number``, ``lag``, ``lead``, ``first_value`` and ``ntile`` of ``value``
    within ``key`` (order must be total).  The row number comes from the chunked
    scan; lag/lead are equi-joins on ``(key, rn +- 1)``, which are unique pairs
    and so carry no skew; first value and group size join on ``key`` against one
    row per key."""
    if not needs_chunks(df):
        # small input: one window per key gives the same columns in one pass
        w = Window.partitionBy(key).orderBy(*order)
        return df.select(
            *id_cols, key, F.row_number().over(w).cast("long").alias("rn"), value,
            F.lag(value).over(w).alias("lag_value"), F.lead(value).over(w).alias("lead_value"),
            F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first_value"),
            F.ntile(tiles).over(w).cast("long").alias("ntile"),
            F.count(F.lit(1)).over(Window.partitionBy(key)).alias("cnt"))
    ranked = grouped_rank(df, [key], list(order), "rn")
    base = ranked.select(key, "rn", value, *id_cols)
    nxt = base.select(F.col(key).alias("__k"), (F.col("rn") - 1).alias("__rn"), F.col(value).alias("lead_value"))
    prv = base.select(F.col(key).alias("__k"), (F.col("rn") + 1).alias("__rn"), F.col(value).alias("lag_value"))
    per_key = base.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("cnt"),
                                                        F.min_by(value, "rn").alias("first_value"))
    # null-safe on the key: a NULL key is still a group
    j = (base.join(prv, base[key].eqNullSafe(prv["__k"]) & (base["rn"] == prv["__rn"]), "left").drop("__k", "__rn")
         .join(nxt, F.col(key).eqNullSafe(nxt["__k"]) & (F.col("rn") == nxt["__rn"]), "left").drop("__k", "__rn")
         .join(per_key, F.col(key).eqNullSafe(per_key["__k"])).drop("__k"))
    # ntile: the first (cnt % n) tiles hold one extra row
    q = F.floor(F.col("cnt") / tiles)
    r = F.col("cnt") % tiles
    big = r * (q + 1)
    ntile = F.when(F.col("rn") <= big, F.floor((F.col("rn") - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((F.col("rn") - 1 - big) / F.greatest(q, F.lit(1))) + 1)
    return j.select(*id_cols, key, "rn", value, "lag_value", "lead_value", "first_value",
                    ntile.cast("long").alias("ntile"), "cnt")


def range_frame_sums(df: DataFrame, keys: Sequence[str], time_col: str, id_col: str, measures: dict[str, Column],
                     window_seconds: int, include_current: bool = True, data: DataFrame | None = None,
                     data_id: str | None = None) -> DataFrame:
    """Sums over a time RANGE frame without pairing rows.

    For each row of ``df``, the sum of each measure over the rows of ``data``
    (default ``df``) with equal ``keys`` and time in ``[t - w, t]``
    (``[t - w, t)`` when ``include_current`` is False).  With S(x) the running
    sum up to time x, the answer is S(t) - S(t - w), and each S is an as-of
    lookup into the chunked running sums: work is linear in the rows whatever
    the density of a key's events, where a band join is quadratic in it.
    Count is the measure ``F.lit(1)``.  ``id_col`` (and ``data_id`` for
    ``data``) must be unique: they order rows with equal time deterministically.
    """
    self_frame = data is None
    data = df if data is None else data
    data_id = data_id or id_col
    names = list(measures)
    if self_frame and include_current and not needs_chunks(df):
        # small input, frame over its own rows: the native RANGE window gives the same sums
        us = F.unix_micros(F.col(time_col).cast("timestamp"))
        w = Window.partitionBy(*keys).orderBy(us).rangeBetween(-window_seconds * 1_000_000, 0)
        return df.select("*", *[F.sum(m).over(w).alias(n) for n, m in measures.items()])
    d = data.select(*keys, F.col(time_col).alias("__t"), F.col(data_id).alias("__rid"),
                    *[m.alias(f"__x_{n}") for n, m in measures.items()])
    # running sums in (time, row) order: S at a row includes everything up to it
    run = grouped_running(d, keys, [F.col("__t"), F.col("__rid")], {n: F.col(f"__x_{n}") for n in names})
    vals = F.struct(*[F.col(n).alias(n) for n in names])
    data_rows = run.select(*keys, "__t", F.lit(0).alias("__side"), F.col("__rid").cast("long").alias("__ord"),
                           vals.alias("__s"), F.lit(None).cast("long").alias("__pid"), F.lit(None).alias("__end"))
    w = F.make_dt_interval(secs=F.lit(window_seconds))
    probe_src = df.select(*keys, F.col(time_col).alias("__pt"), F.col(id_col).alias("__pid"))
    null_s = F.lit(None).cast(data_rows.schema["__s"].dataType)
    # upper probe: after every data row at the same time (inclusive) or before them (exclusive)
    upper = probe_src.select(*keys, F.col("__pt").alias("__t"), F.lit(1 if include_current else -1).alias("__side"),
                             F.lit(0).cast("long").alias("__ord"), null_s.alias("__s"), "__pid",
                             F.lit("hi").alias("__end"))
    # lower probe at t - w, before data rows at that time: sums strictly earlier rows
    lower = probe_src.select(*keys, (F.col("__pt") - w).alias("__t"), F.lit(-1).alias("__side"),
                             F.lit(0).cast("long").alias("__ord"), null_s.alias("__s"), "__pid",
                             F.lit("lo").alias("__end"))
    u = data_rows.unionByName(upper).unionByName(lower)
    filled = carry_last(u, keys, [F.col("__t"), F.col("__side"), F.col("__ord")], {"__c": F.col("__s")})
    probes = filled.filter(F.col("__pid").isNotNull())
    g = probes.groupBy("__pid").agg(F.max_by("__c", F.col("__end") == "hi").alias("__hi"),
                                    F.max_by("__c", F.col("__end") == "lo").alias("__lo"))
    out = g.select(F.col("__pid").alias(id_col), *[
        (F.coalesce(F.col(f"__hi.{n}"), F.lit(0)) - F.coalesce(F.col(f"__lo.{n}"), F.lit(0))).alias(n)
        for n in names])
    return df.join(out, id_col)
