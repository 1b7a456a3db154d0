"""Chunked scans must equal plain per-key windows, including a key that holds
most of the rows and ties in the order column."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import scan


def _skewed(spark):
    # key 0 holds ~2/3 of the rows; order values repeat (ties) for rank tests
    return spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.lit(0))
        .cast("int").alias("k"),
        (F.col("id") % 500).alias("v"), F.col("id").alias("id"))


def _force_chunks(monkeypatch):
    monkeypatch.setattr(scan, "SMALL_INPUT_BYTES", 0)


def test_chunk_bounds_split_hot_key(spark, monkeypatch):
    _force_chunks(monkeypatch)
    df = _skewed(spark)
    bounds = scan.chunk_bounds(df, ["k"], [F.col("id")], 8)
    assert 4 <= len(bounds) <= 7
    assert sum(1 for b in bounds if b["k0"] == 0) >= 2   # the hot key is cut


def test_grouped_rank_matches_window(spark, monkeypatch):
    _force_chunks(monkeypatch)
    df = _skewed(spark)
    for method, fn in [("row_number", F.row_number), ("rank", F.rank), ("dense_rank", F.dense_rank)]:
        order = [F.col("v"), F.col("id")] if method == "row_number" else [F.col("v")]
        got = scan.grouped_rank(df, ["k"], order, "r", method=method, num_chunks=8)
        w = Window.partitionBy("k").orderBy(*order)
        exp = df.withColumn("r", fn().over(w).cast("long"))
        assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0, method


def test_grouped_running_matches_window(spark, monkeypatch):
    _force_chunks(monkeypatch)
    df = _skewed(spark)
    got = scan.grouped_running(df, ["k"], [F.col("id")], {"s": F.col("v")}, num_chunks=8)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("s", F.sum("v").over(w))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_carry_last_matches_window(spark, monkeypatch):
    _force_chunks(monkeypatch)
    df = _skewed(spark).withColumn("x", F.when(F.col("id") % 97 == 0, F.col("id")))
    got = scan.carry_last(df, ["k"], [F.col("id")], {"last_x": F.col("x")}, num_chunks=8)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("last_x", F.last("x", ignorenulls=True).over(w))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_ordered_analytics_chunked_matches_windows(spark, monkeypatch):
    from lakeloom.operators.joins import ordered_analytics
    df = _skewed(spark).withColumn("val", F.col("v").cast("double"))
    plain = ordered_analytics(df, "k", [F.col("v"), F.col("id")], "val", tiles=4, id_cols=["id"])
    _force_chunks(monkeypatch)
    chunked = ordered_analytics(df, "k", [F.col("v"), F.col("id")], "val", tiles=4, id_cols=["id"])
    assert plain.exceptAll(chunked).count() == 0 and chunked.exceptAll(plain).count() == 0


def test_asof_join_chunked_matches_plain(spark, monkeypatch):
    from lakeloom.operators.joins import asof_join
    left = spark.range(0, 2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("t"),
                                       F.col("id").alias("lid"))
    right = spark.range(0, 500).select((F.col("id") % 3).alias("k"), (F.col("id") * 13 % 1000).alias("t"),
                                       F.col("id").alias("rid"))
    plain = asof_join(left, right, ["k"], "t", "t", ["rid"], tie="rid")
    _force_chunks(monkeypatch)
    chunked = asof_join(left, right, ["k"], "t", "t", ["rid"], tie="rid")
    assert plain.exceptAll(chunked).count() == 0 and chunked.exceptAll(plain).count() == 0
    # brute force: greatest right time <= left time, ties by greatest rid
    brute = (left.alias("l").join(right.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("r.t") <= F.col("l.t")), "left")
             .groupBy("l.lid").agg(F.max_by("r.rid", F.struct("r.t", "r.rid")).alias("asof_rid")))
    got = plain.select("lid", "asof_rid")
    assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0


def test_range_frame_sums_chunked_match_brute_force(spark, monkeypatch):
    from lakeloom.operators.joins import range_frame_sums
    # key 0 is hot and dense: many events share a time, so peers matter
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 4 == 0, F.lit(1)).otherwise(F.lit(0)).alias("k"), F.col("id").alias("rid"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 37 % 7200)).cast("timestamp_ntz").alias("t"),
        (F.col("id") % 5).cast("double").alias("v"))
    brute = (df.alias("a").join(df.alias("b"), (F.col("a.k") == F.col("b.k"))
                                & (F.col("b.t") >= F.col("a.t") - F.expr("INTERVAL 600 SECONDS"))
                                & (F.col("b.t") <= F.col("a.t")))
             .groupBy("a.rid").agg(F.count("*").alias("n"), F.sum("b.v").alias("s")))
    for force in (False, True):
        if force:
            _force_chunks(monkeypatch)
        got = range_frame_sums(df, ["k"], "t", "rid", {"n": F.lit(1).cast("long"), "s": F.col("v")}, 600)
        got = got.select("rid", "n", "s")
        assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0


def test_exact_percentiles_match_builtin(spark, monkeypatch):
    from lakeloom.operators.stats import exact_percentiles
    df = _skewed(spark).withColumn("x", (F.col("v") * 1.5).cast("double"))
    exp = df.groupBy("k").agg(*[F.percentile("x", p).alias(n) for n, p in
                                [("p0", 0.0), ("p37", 0.37), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0)]])
    for force in (False, True):
        if force:
            _force_chunks(monkeypatch)
        got = exact_percentiles(df, ["k"], "x", {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p99": 0.99, "p100": 1.0},
                                distributed=True)
        a = {r["k"]: tuple(round(r[c], 9) for c in ("p0", "p37", "p50", "p99", "p100")) for r in got.collect()}
        b = {r["k"]: tuple(round(r[c], 9) for c in ("p0", "p37", "p50", "p99", "p100")) for r in exp.collect()}
        assert a == b


def test_complete_prices_paths_agree(spark, monkeypatch):
    from lakeloom.operators import portfolio as P
    from lakeloom.sources.derived import prices
    from tests.conftest import SF
    p = prices(spark, SF).union(spark.createDataFrame([("2030-01-01", "click", 5)], "dt string, symbol string, price long")
                                .withColumn("dt", F.col("dt").cast("date")))
    small = P.complete_prices(p)
    _force_chunks(monkeypatch)
    large = P.complete_prices(p)
    assert small.count() == large.count() == prices(spark, SF).count()
    assert small.exceptAll(large).count() == 0


def test_hot_key_spread_evenly_over_chunks(spark, monkeypatch):
    """One key holds half the rows: no (group, chunk) task may hold much more
    than an even share of the data."""
    _force_chunks(monkeypatch)
    n, chunks = 20000, 16
    df = spark.range(0, n).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
                                  F.col("id").alias("v"))
    ranged = scan._chunked(df, ["k"], [F.col("v")], chunks)
    sizes = [r["n"] for r in ranged.groupBy("k", scan._PID).agg(F.count("*").alias("n")).collect()]
    hot = [r["n"] for r in ranged.filter(F.col("k") == 0).groupBy(scan._PID).agg(F.count("*").alias("n")).collect()]
    assert len(hot) >= chunks // 2                     # the hot key spans many chunks
    assert max(sizes) <= 3 * n / chunks                # and no piece is much above an even share


def test_large_input_without_hot_key_is_scanned_once(spark, monkeypatch):
    """Chunks compute their input twice: many even keys do without, one hot key among them does not."""
    _force_chunks(monkeypatch)
    even = spark.range(0, 20000).select((F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    assert scan.chunk_bounds(even, ["k"], [F.col("v")], 8) == []
    got = scan.carry_last(even, ["k"], [F.col("v")], {"x": F.when(F.col("v") % 3 == 0, F.col("v"))}, num_chunks=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Range (") == 1
    hot = even.union(spark.range(0, 20000).select(F.lit(7).cast("long"), F.col("id") + 20000))
    assert sum(b["k0"] == 7 for b in scan.chunk_bounds(hot, ["k"], [F.col("v")], 8)) >= 3
    assert len(scan.chunk_bounds(even, [], [F.col("v")], 8)) == 7
