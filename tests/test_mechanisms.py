"""Bucketed keyed tables, exactly-once sinks, schema-less redaction, weights, interval joins, lineage closure, sketches."""

import itertools
import json
import os
import random
import tempfile
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import intervals as IV
from lakeloom.operators import lineage as LN
from lakeloom.operators import portfolio as P
from lakeloom.operators import sketches as SK
from lakeloom.operators import weights as W
from lakeloom.operators.redaction import redact_any_json
from lakeloom.sinks.keyed import ConflictError, KeyedTable
from lakeloom.sinks.once import FileSink, by_validity, replayed, write_once
from lakeloom.sources import jdbc as J

PROPS = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix=f"lakeloom-{name}-"), "t")


def _url():
    return f"jdbc:derby:memory:db_{uuid.uuid4().hex[:8]};create=true"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- keyed tables

def _files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(os.path.join(path, "data")) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark):
    path = _tmp("keyed")
    table = KeyedTable(spark, path)
    table.create(spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1.5).alias("w")), ["k"], buckets=200)
    before = _files(path)
    # keys of two of the 200 buckets
    chosen = [r.k for r in table.read().where(KeyedTable._bucket(["k"], 200).isin(3, 77)).select("k").collect()]
    version = table.upsert(spark.createDataFrame([(k, "new", i) for i, k in enumerate(chosen)], "k long, v string, seq long"), order="seq")
    written = _files(path) - before
    assert before <= _files(path) and written and all("bucket=3/" in f or "bucket=77/" in f for f in written)
    got = {r.k: (r.v, r.w) for r in table.read().collect()}
    assert len(got) == 5000 and all(got[k] == (("new" if k in set(chosen) else "old"), 1.5) for k in got)
    # the plan of the next read names each bucket's own folder, and the version before still reads
    assert len({r.v for r in table.read(version - 1).collect()}) == 1


def test_a_dead_writer_leaves_the_old_table(spark, monkeypatch):
    path = _tmp("dead")
    table = KeyedTable(spark, path)
    table.create(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"], buckets=4)
    batch = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    # it dies after its data, before its manifest
    monkeypatch.setattr(table, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        table.upsert(batch)
    again = KeyedTable(spark, path)
    assert _rows(again.read()) == [(1, "a"), (2, "b")] and again.versions() == [1]
    # or in the middle of the manifest
    with open(f"{path}/commits/{2:012d}.json", "w") as f:
        f.write('{"parent": 1, "keys": ["k"]')
    assert _rows(again.read()) == [(1, "a"), (2, "b")]
    assert again.upsert(batch) == 3 and _rows(again.read()) == [(1, "x"), (2, "b"), (3, "y")]
    gone = again.vacuum(keep=1)
    assert gone and _rows(again.read()) == [(1, "x"), (2, "b"), (3, "y")] and again.versions() == [3]


def test_writers_at_once_conflict(spark, monkeypatch):
    path = _tmp("conflict")
    one, two = KeyedTable(spark, path), KeyedTable(spark, path)
    one.create(spark.createDataFrame([(1, "a")], "k long, v string"), ["k"], buckets=2)
    put = one._put
    monkeypatch.setattr(one, "_put", lambda *a: (two.upsert(spark.createDataFrame([(2, "two")], "k long, v string")), put(*a)))
    with pytest.raises(ConflictError):
        one.upsert(spark.createDataFrame([(1, "one")], "k long, v string"))
    assert _rows(two.read()) == [(1, "a"), (2, "two")]
    with pytest.raises(ConflictError):
        two.create(spark.createDataFrame([(1, "a")], "k long, v string"), ["k"])


def test_keyed_nulls_ties_types_and_empty(spark):
    table = KeyedTable(spark, _tmp("odd"))
    rows = spark.createDataFrame([(None, "x", 1), (1, None, 2), (1, "last", 3)], "k int, v string, seq int")
    table.create(rows, ["k"], buckets=8, order="seq")
    assert _rows(table.read()) == [(1, "last"), (None, "x")]
    # a long key is the table's int; NULL is a key; a NULL value overwrites
    table.upsert(spark.createDataFrame([(None, None), (7, "seven")], "k long, v string"))
    assert _rows(table.read()) == [(1, "last"), (7, "seven"), (None, None)]
    n = len(table.versions())
    assert table.upsert(rows.select("k", "v").limit(0)) == n and len(table.versions()) == n
    table.delete(spark.createDataFrame([(None,), (7,), (9,)], "k int"))
    assert _rows(table.read()) == [(1, "last")]
    table.delete(spark.createDataFrame([(1,)], "k int"))
    assert _rows(table.read()) == [] and table.read().columns == ["k", "v"]
    table.upsert(spark.createDataFrame([(5, "five")], "k int, v string"))
    assert _rows(table.read()) == [(5, "five")]
    empty = KeyedTable(spark, _tmp("none"))
    empty.create(rows.drop("seq").limit(0), ["k"])
    assert _rows(empty.read()) == []
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("x",)], "v string"))


def test_insert_into_keyed_table_sees_collisions(spark):
    table = KeyedTable(spark, _tmp("ins"))
    table.create(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"], buckets=4)
    hit = table.insert(spark.createDataFrame([(2, "z"), (9, "n")], "k long, v string"), collisions=_tmp("coll"))
    assert hit["collision"] and _rows(spark.read.parquet(hit["path"])) == [(2, "z"), (9, "n")] and _rows(table.read()) == [(1, "a"), (2, "b")]
    fine = table.insert(spark.createDataFrame([(9, "n")], "k long, v string"))
    assert not fine["collision"] and _rows(table.read()) == [(1, "a"), (2, "b"), (9, "n")]
    twice = table.insert(spark.createDataFrame([(10, "n"), (10, "m")], "k long, v string"), collisions=_tmp("twice"))
    assert twice["collision"] and table.read().count() == 3


# ---- exactly once

def test_replayed_batches_add_nothing_in_the_database(spark):
    url = _url()
    batch = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "ID long, NAME string")
    assert write_once(batch, url, "SUNK", "s1", 0, properties=PROPS)
    assert not write_once(batch, url, "SUNK", "s1", 0, properties=PROPS)
    assert write_once(batch, url, "SUNK", "s2", 0, properties=PROPS) and write_once(batch.limit(0), url, "SUNK", "s1", 1, properties=PROPS)
    assert J.read_table(spark, url, table="SUNK", properties=PROPS).count() == 6
    ledger = J.read_table(spark, url, table="SUNK_LEDGER", properties=PROPS).collect()
    assert sorted((r.STREAM_NAME, r.BATCH_ID) for r in ledger) == [("s1", 0), ("s1", 1), ("s2", 0)]


def test_a_batch_that_fails_half_way_is_whole_after_its_replay(spark, monkeypatch):
    url = _url()
    batch = spark.createDataFrame([(i, "x") for i in range(50)], "ID long, NAME string")
    run = J.Database.run

    def dies(self, sql, *values):
        if sql.startswith("INSERT INTO") and "SELECT" in sql:
            raise RuntimeError("connection lost")
        return run(self, sql, *values)
    monkeypatch.setattr(J.Database, "run", dies)
    with pytest.raises(RuntimeError):
        write_once(batch, url, "SUNK", "s", 7, properties=PROPS)
    monkeypatch.undo()
    assert J.read_table(spark, url, table="SUNK", properties=PROPS).count() == 0
    assert write_once(batch, url, "SUNK", "s", 7, properties=PROPS)
    assert J.read_table(spark, url, table="SUNK", properties=PROPS).count() == 50


def test_file_sink_shows_marked_batches_once(spark, monkeypatch):
    sink = FileSink(spark, _tmp("sink"), by_validity(F.col("v") > 0))
    batch = spark.createDataFrame([(1,), (-1,), (None,), (1,)], "v int")
    assert sink.read() is None
    replayed(sink.write, 3)(batch, 0)
    assert _rows(sink.read().select("v")) == [(1,), (1,)] and _rows(sink.read("dead").select("v")) == [(-1,), (None,)]
    # rows of a batch that died before its mark are not seen, and are replaced by its replay
    batch.write.parquet(f"{sink.path}/rows/batch_id=1")
    assert sink.read().count() == 2
    assert sink.write(batch.limit(0), 1) and sink.read().count() == 2 and sink.committed() == [0, 1]


def test_stream_to_database_replays_from_an_old_checkpoint(spark):
    from pyspark.sql import types as T
    from lakeloom.plans import patterns as PL
    from lakeloom.streaming import topics as ST
    src, dead, url = tempfile.mkdtemp(), _tmp("dl"), _url()
    with open(f"{src}/a.json", "w") as f:
        f.write('{"ID": 1}\nbroken\n{"ID": 2}\n')
    schema = T.StructType([T.StructField("ID", T.LongType())])
    ck = _tmp("ck")
    for _ in range(2):
        PL.stream_to_database(ST.file_stream(spark, src, "text"), schema, url, "M", ck, dead, properties=PROPS).awaitTermination()
        # the stream's own commits are lost: the batch runs again
        for name in os.listdir(f"{ck}/commits"):
            os.remove(f"{ck}/commits/{name}")
    assert sorted(r.ID for r in J.read_table(spark, url, table="M", properties=PROPS).collect()) == [1, 2]
    assert [r._corrupt for r in spark.read.parquet(dead).collect()] == ["broken"]


def test_merge_inside_the_database(spark):
    url = _url()
    J.upsert_table(spark, spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 2.0), (2, 1, "c", 3.0)], "A int, B int, V string, W double"), url, "T", ["A", "B"], properties=PROPS)
    batch = spark.createDataFrame([(1, 2, "new", 1), (1, 2, "newer", 2), (9, 9, None, 1)], "A int, B int, V string, SEQ int")
    J.upsert_table(spark, batch, url, "T", ["A", "B"], order="SEQ", properties=PROPS)
    got = {(r.A, r.B): (r.V, r.W) for r in J.read_table(spark, url, table="T", properties=PROPS).collect()}
    assert got == {(1, 1): ("a", 1.0), (1, 2): ("newer", 2.0), (2, 1): ("c", 3.0), (9, 9): (None, None)}
    J.upsert_table(spark, batch.limit(0), url, "T", ["A", "B"], order="SEQ", properties=PROPS)
    assert J.read_table(spark, url, table="T", properties=PROPS).count() == 4


def test_sync_does_not_copy_a_range_twice(spark, monkeypatch):
    src, dst, control = _url(), _url(), _tmp("marks")
    J.write_table(spark.range(10).select(F.col("id").alias("ID")), src, "T", mode="overwrite", properties=PROPS)
    # the run dies after the copy, before the control folder's entry
    monkeypatch.setattr(J, "write_mark", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        J.sync_tables(spark, src, dst, {"T": "ID"}, run=1, control=control, properties=PROPS)
    monkeypatch.undo()
    J.write_table(spark.range(10, 13).select(F.col("id").alias("ID")), src, "T", properties=PROPS)
    assert J.sync_tables(spark, src, dst, {"T": "ID"}, run=1, control=control, properties=PROPS) == {"T": 13}
    J.write_mark(spark, "T", 9, 1, control)
    assert J.read_marks(spark, control) == {"T": "12"}


# ---- redaction

KEYS = {"password", "passcode", "token", "secret", "kerberoskeytab", "sslkeystorepasswd"}


def plain_redact(x):
    if isinstance(x, dict):
        return {k: "***REDACTED***" if k.lower() in KEYS else plain_redact(v) for k, v in x.items()}
    return [plain_redact(v) for v in x] if isinstance(x, list) else x


def _random_json(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return {rng.choice(["a", "Token", "password", "x\"y", "sécret", "SECRET", "to\\ken", "{", "pass:word", ""]) + rng.choice(["", "", "1"]): _random_json(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 6:
        return [_random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 12, -1.5e10, "plain", 'q"u,o:t{e}', "back\\slash", "\\", "token", "é\n\t"])


def test_redaction_equals_a_plain_walk(spark):
    rng = random.Random(11)
    docs = [{"id": i, "body": _random_json(rng)} for i in range(400)]
    texts = [json.dumps(d, ensure_ascii=i % 2 == 0, indent=1 if i % 3 == 0 else None) for i, d in enumerate(docs)]
    deep = "x"
    for i in range(200):
        deep = {"token" if i % 3 == 0 else "k": [deep, i]}
    long = {"a": "\\n\" " * 30_000, "token": {"b": ["}"] * 5000}, "c": list(range(3000))}
    for d in (deep, long):
        docs.append(d)
        texts.append(json.dumps(d))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.r for r in df.select("i", redact_any_json("t").alias("r")).collect()}
    assert all(json.loads(got[i]) == plain_redact(d) for i, d in enumerate(docs))


def test_redaction_keeps_all_else_and_odd_texts(spark):
    cases = [(None, None), ("", ""), ("no json: token", "no json: token"), ('{"secret": 12 , "n": 1.50}', '{"secret": "***REDACTED***" , "n": 1.50}'),
             ('{"pass\\u0077ord":[1,{"a":"]"}],"b":2}', '{"pass\\u0077ord":"***REDACTED***","b":2}'), ('{"token":"open', '{"token":"***REDACTED***"'),
             ('["token", "token"]', '["token", "token"]'), ('{"a":"token","b":1}', '{"a":"token","b":1}'), ('{"token":}', '{"token":}'), ('{"extra":{"keep":2},"TOKEN":null}', '{"extra":{"keep":2},"TOKEN":"***REDACTED***"}')]
    df = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "i int, t string")
    got = [r.r for r in df.select("i", redact_any_json("t").alias("r")).orderBy("i").collect()]
    assert got == [w for _, w in cases]
    assert df.limit(0).select(redact_any_json("t")).collect() == []


# ---- weights

def test_weights_beat_every_grid_point():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4):
        for _ in range(30):
            a = rng.normal(size=(n + 2, n))
            cov, mean = a.T @ a / 10, rng.normal(size=n) + rng.choice([0.0, 0.5, -3.0])
            w = W.max_sharpe(mean, cov)
            assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9
            best = w @ mean / np.sqrt(w @ cov @ w)
            for g in itertools.product(range(11), repeat=n):
                if sum(g) == 10:
                    g = np.array(g) / 10
                    assert best >= g @ mean / np.sqrt(g @ cov @ g) - 1e-9


def test_weights_of_odd_portfolios():
    one = np.array([1.0])
    assert W.max_sharpe(one, np.array([[0.0]])).tolist() == [1.0]
    # equal symbols, a singular matrix, a gain without risk, only losses
    assert abs(W.max_sharpe(np.array([1.0, 1.0]), np.ones((2, 2))).sum() - 1) < 1e-9
    free = W.max_sharpe(np.array([1.0, 2.0, 0.5]), np.diag([1.0, 0.0, 0.0]))
    assert free[0] < 1e-6 and free[1] > free[2] and W.max_sharpe(np.array([1.0, 2.0]), np.zeros((2, 2))).tolist() == [0, 1]
    short = np.random.default_rng(1).normal(size=(2, 6)) + 0.1
    assert abs(W.max_sharpe(short.mean(axis=0), np.cov(short.T)).sum() - 1) < 1e-9
    assert W.max_sharpe(np.array([-1.0, -2.0]), np.diag([1.0, 100.0])).tolist() == [0, 1]
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 60))
    cov, mean = np.cov(a.T), a.mean(axis=0) + 0.02
    w = W.max_sharpe(mean, cov)
    g = mean * (w @ cov @ w) - (cov @ w) * (mean @ w)
    assert abs(w.sum() - 1) < 1e-9 and g.max() < 1e-9 and np.abs(g[w > 1e-9]).max() < 1e-9


def test_many_portfolios_and_their_backtest(spark):
    rng = random.Random(3)
    rows = [(p, f"2024-01-{d:02d}", s, 100 + rng.randrange(50)) for p in ("x", "y") for d in range(1, 25) for s in "ABCD"]
    rows += [("x", "2024-02-01", "A", 5), ("gap", "2024-01-01", "A", 1), ("gap", "2024-01-02", "A", None), (None, "2024-01-01", "A", 3)]
    prices = spark.createDataFrame(rows, "p string, dt string, symbol string, price long").withColumn("dt", F.col("dt").cast("date"))
    rets = W.portfolio_returns(prices, ["p"])
    found = W.optimal_weights(rets, ["p"])
    by = {}
    for r in found.collect():
        by.setdefault(r.p, {})[r.symbol] = r
    assert set(by) == {"x", "y"} and all(abs(sum(r.weight for r in v.values()) - 1) < 1e-9 for v in by.values())
    checked = W.optimality(W.moments(rets, ["p"]), found, ["p"]).collect()
    assert len(checked) == 2 and all(r.stationary and r.symbols == 4 for r in checked)
    # and a wrong answer is told
    wrong = found.withColumn("weight", F.lit(0.25))
    assert not any(r.stationary for r in W.optimality(W.moments(rets, ["p"]), wrong, ["p"]).collect())
    # V4, V5 with these weights
    own = rets.where("p = 'x'").drop("p")
    dd = P.drawdown(P.backtest(own, found.where("p = 'x'").select("symbol", "weight"), 1000.0))
    worst = P.max_drawdown(dd).first()[0]
    value, peak, want = {s: 1.0 for s in "ABCD"}, 0.0, 0.0
    px = {(r[1], r[2]): r[3] for r in rows if r[0] == "x"}
    for d in range(2, 25):
        for s in "ABCD":
            value[s] *= px[f"2024-01-{d:02d}", s] / px[f"2024-01-{d - 1:02d}", s]
        total = sum(value[s] * by["x"][s].weight * 1000 for s in "ABCD")
        peak = max(peak, total)
        want = min(want, (total - peak) / peak)
    assert abs(worst - want) < 1e-9
    assert W.optimal_weights(rets.limit(0), ["p"]).collect() == []


# ---- intervals

def test_overlaps_equal_brute_force_and_pair_nothing_else(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab") if i % 17 else None, lo, lo + rng.choice([0, 1, 2, 7, 100, 5000]) if i % 13 else None) for i, lo in enumerate(rng.randrange(-500, 2000) for _ in range(300))]
    rows += [(900, "a", 5, 5), (901, "a", 10, 3), (902, "a", None, 9), (903, "b", -7, 900), (903, "b", -7, 900)]
    df = spark.createDataFrame(rows, "id int, k string, s long, e long")
    for keys in (["k"], []):
        got = Counter((r.l.id, r.r.id) for r in IV.overlap_join(df, df, "s", "e", keys).collect())
        fine = [r for r in rows if r[2] is not None and r[3] is not None and r[2] < r[3]]
        want = Counter((a[0], b[0]) for a in fine for b in fine if a[2] < b[3] and b[2] < a[3] and (not keys or (a[1] == b[1] and a[1] is not None)))
        assert got == want
    assert IV.overlap_join(df.limit(0), df, "s", "e").collect() == []


def test_overlaps_are_never_broadcast(spark):
    # by its size before it is cut into blocks either side looks small enough
    df = spark.range(50).selectExpr("id", "id % 3 as k", "id * 10 as s", "id * 10 + 5000 as e")
    joined = IV.overlap_join(df, df, "s", "e", ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_concurrency_equals_a_plain_sweep(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), lo, lo + rng.choice([0, 1, 50, 4000, 200_000]) if i % 11 else None) for i, lo in enumerate(rng.choice([7, rng.randrange(-3000, 400_000)]) for _ in range(400))]
    rows += [("a", None, 4), ("c", 9, 9)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = {(r.k, r.t): r.open for r in IV.concurrency(df, "s", "e", ["k"]).collect()}
    fine = [r for r in rows if r[1] is not None and (r[2] is None or r[1] < r[2])]
    times = {(k, t) for k, s, e in fine for t in (s, e) if t is not None}
    open_ = {(k, t): sum(1 for k2, s, e in fine if k2 == k and s <= t and (e is None or t < e)) for k, t in times}
    assert got == open_
    tops = {(r.k, r.period_no): r.peak for r in IV.peaks(df, "s", "e", 10_000, ["k"]).collect()}
    for (k, p), top in tops.items():
        inside = [v for (k2, t), v in open_.items() if k2 == k and t // 10_000 == p]
        at_start = sum(1 for k2, s, e in fine if k2 == k and s <= p * 10_000 and (e is None or p * 10_000 < e))
        assert top == max(inside + [at_start])
    assert set(tops) == {(k, t // 10_000) for k, t in times}
    assert IV.concurrency(df.limit(0), "s", "e").collect() == [] and IV.peaks(df.limit(0), "s", "e", 10, ["k"]).collect() == []


# ---- lineage

def test_closure_over_cycles_and_long_chains(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(25)] + [("n25", "n3"), ("z", "n24"), ("n1", "n1"), (None, "n2"), ("n2", None), ("n0", "n1")]
    edges = spark.createDataFrame(chain, "src string, dst string")
    roots = spark.createDataFrame([("n0",), ("z",), ("lonely",), (None,), ("n0",)], "node string")
    got = {(r.root, r.node): r.hops for r in LN.reachable(edges, roots).collect()}
    assert got["n0", "n25"] == 25 and got["n0", "n0"] == 0 and got["z", "n3"] == 3 and got["lonely", "lonely"] == 0 and len([1 for k in got if k[0] == "n0"]) == 26
    up = {(r.root, r.node): r.hops for r in LN.reachable(edges, spark.createDataFrame([("n24",)], "n string"), "up").collect()}
    assert up["n24", "z"] == 1 and up["n24", "n0"] == 24 and up["n24", "n25"] == 22
    assert {r.node for r in LN.reachable(edges, roots, max_hops=1).where("root = 'z'").collect()} == {"z", "n24"}
    own = LN.lineage(edges.withColumn("messages", F.lit(1)), spark.createDataFrame([("z",)], "n string"), "both", 1)
    assert {(r.src, r.dst, r.hops) for r in own.collect()} == {("z", "n24", 0)}
    assert LN.reachable(edges.limit(0), roots.where("node = 'z'")).count() == 1 and LN.reachable(edges, roots.limit(0)).count() == 0
    with pytest.raises(ValueError):
        LN.reachable(edges, roots, "sideways")


# ---- sketches

def test_sketches_roll_up_over_any_range(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("k"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id % 10 as int))").alias("ts"),
                                      F.when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 7001).alias("u"))
    daily = SK.daily_sketches(rows, "ts", ["k"], "u")
    exact = {(r.k, r.n) for r in rows.where("ts >= '2024-01-03' and ts < '2024-01-06'").groupBy("k").agg(F.count_distinct("u").alias("n")).collect()}
    got = {r.k: (r.by_theta, r.by_hll) for r in SK.estimates(SK.roll_up(daily, ["k"], "2024-01-03", "2024-01-05"), ["k"]).collect()}
    for k, n in exact:
        assert all(abs(x - n) <= 4 * n / 64 + 1 for x in got[k])
    assert SK.roll_up(daily, ["k"], "2025-01-01").collect() == []
