"""Type inference, first-row projection, table writes, upserts and stats inserts
(M1-M8, K3, K4), one test per quirk recorded in the survey."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.inference import first_record_columns, infer_schema, typed_records
from lakeloom.operators.upsert import apply_changes, fold_status, upsert
from lakeloom.sinks import tables as K


def _records(spark, rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "row_idx long, record string")


def _types(spark, rows):
    return {r["column_name"]: r["sql_type"] for r in infer_schema(_records(spark, rows)).collect()}


def test_inference_rules(spark):
    t = _types(spark, [{"a": None, "b": 1, "c": 1, "d": True, "e": "x", "f": {"k": 1}, "g": 1.5},
                       {"a": 1, "b": None, "c": 1.5, "d": 1, "e": "y", "f": [1], "g": 2.5}])
    assert t == {"a": "TEXT", "b": "INTEGER", "c": "TEXT", "d": "TEXT", "e": "TEXT", "f": "JSONB",
                 "g": "DOUBLE PRECISION"}


def test_inference_users_example(spark):
    t = _types(spark, [{"name": "John", "email": "j@x.com", "age": 30, "active": True}])
    assert t == {"name": "TEXT", "email": "TEXT", "age": "INTEGER", "active": "BOOLEAN"}


def test_inference_column_order_is_first_appearance(spark):
    recs = _records(spark, [{"z": 1, "a": 2}, {"m": 3, "z": 4}])
    assert [r["column_name"] for r in infer_schema(recs).collect()] == ["z", "a", "m"]


def test_first_row_columns_only(spark):
    rows = [{"id": 1, "name": "a", "specs": {"w": 1}}, {"id": 2, "extra": "dropped", "specs": None}]
    recs = _records(spark, rows)
    schema = infer_schema(recs).collect()
    cols = first_record_columns(recs)
    assert cols == ["id", "name", "specs"]
    out = typed_records(recs, schema, cols).orderBy("row_idx").collect()
    assert out[0]["specs"] == '{"w":1}' and out[1]["name"] is None and "extra" not in out[1].asDict()


def test_text_column_renders_mixed_values(spark):
    recs = _records(spark, [{"v": "a"}, {"v": 1}, {"v": True}])
    schema = infer_schema(recs).collect()
    out = [r["v"] for r in typed_records(recs, schema, ["v"]).orderBy("row_idx").collect()]
    assert out == ["a", "1", "true"]


def test_upsert_last_duplicate_wins_and_null_overwrites(spark):
    target = spark.createDataFrame([(1, "old", 1.0), (2, "keep", 2.0)], "k long, status string, amount double")
    batch = spark.createDataFrame([(1, 10, "first", 5.0), (1, 11, None, 6.0), (3, 1, "new", 7.0)],
                                  "k long, seq long, status string, amount double")
    got = {r["k"]: (r["status"], r["amount"]) for r in upsert(target, batch, ["k"], "seq").collect()}
    assert got == {1: (None, 6.0), 2: ("keep", 2.0), 3: ("new", 7.0)}


def test_upsert_missing_columns_keep_old_values_and_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 1.0)], "k long, status string, amount double")
    batch = spark.createDataFrame([(1, "b"), (2, "c")], "k long, status string")
    once = upsert(target, batch, ["k"])
    twice = upsert(once, batch, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "b", 1.0), (2, "c", None)]


def test_upsert_key_only_batch_is_noop_and_requires_key(spark):
    target = spark.createDataFrame([(1, "a")], "k long, s string")
    assert upsert(target, spark.createDataFrame([(5,)], "k long"), ["k"]).collect() == target.collect()
    with pytest.raises(ValueError):
        upsert(target, target, [])


def test_apply_changes_delete_then_reinsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    changes = spark.createDataFrame([(1, 1, "delete", None), (2, 1, "delete", None), (2, 2, "upsert", "b2")],
                                    "k long, seq long, op string, s string")
    got = sorted(map(tuple, apply_changes(target, changes, ["k"], "seq").collect()))
    assert got == [(2, "b2")]


def test_fold_status_all_outcomes(spark):
    t0 = "2024-01-01 00:00:00"
    ev = spark.createDataFrame([
        ("kick", 0, "submitted", t0), ("kick", 1, "events", "2024-01-01 00:00:30"),
        ("kick", 2, "crew_kickoff_completed", "2024-01-01 00:01:00"),
        ("late", 0, "submitted", t0), ("late", 2, "crew_kickoff_completed", "2024-01-01 00:11:00"),
        ("err", 0, "submitted", t0), ("err", 3, "api_error", "2024-01-01 00:02:00"),
        ("prog", 0, "submitted", t0), ("prog", 1, "events", "2024-01-01 00:00:30"),
        ("new", 0, "submitted", t0)], "trace_id string, seq int, kind string, at string"
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {r["trace_id"]: (r["status"], r["crew_kickoff_completed"], r["error_message"])
           for r in fold_status(ev).collect()}
    assert got == {"kick": ("completed", True, None), "late": ("failed", False, "Polling timeout exceeded"),
                   "err": ("completed", True, None), "prog": ("in-progress", False, None),
                   "new": ("submitted", False, None)}


def _name():
    return "t_" + uuid.uuid4().hex[:10]


def test_insert_create_append_and_errors(spark):
    name = _name()
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    assert K.insert_rows(df, name, primary_key="id")["created"]
    K.insert_rows(spark.createDataFrame([(2, "b")], "id long, v string"), name)
    assert spark.table(name).count() == 2
    assert K.primary_key_of(spark, name) == "id"
    with pytest.raises(K.WriteError):
        K.insert_rows(df.limit(0), name)
    with pytest.raises(K.WriteError):
        K.insert_rows(df, _name(), create_if_not_exists=False)


def test_collision_writes_whole_batch_elsewhere(spark):
    name = _name()
    K.insert_rows(spark.createDataFrame([(1, "a")], "id long, v string"), name, primary_key="id")
    res = K.insert_rows(spark.createDataFrame([(1, "x"), (9, "y")], "id long, v string"), name,
                        collision_suffix="1700000000")
    assert res["collision"] and res["table"] == f"{name}_1700000000"
    assert spark.table(res["table"]).count() == 2 and spark.table(name).count() == 1


def test_collision_is_the_default_and_keys_may_be_composite(spark):
    name = _name()
    df = spark.createDataFrame([(1, "a", 10)], "id long, part string, v int")
    K.insert_rows(df, name, primary_key=["id", "part"])
    assert K.primary_key_of(spark, name) == "id,part"
    assert not K.insert_rows(spark.createDataFrame([(1, "b", 20)], df.schema), name).get("collision")
    res = K.insert_rows(spark.createDataFrame([(1, "a", 30), (2, "a", 40)], df.schema), name)
    assert res["collision"] and spark.table(res["table"]).count() == 2 and spark.table(name).count() == 2
    K.upsert_rows(spark.createDataFrame([(1, "b", 50), (3, "c", 60)], df.schema), name, ["id", "part"])
    assert {(r.id, r.part): r.v for r in spark.table(name).collect()} == {(1, "a"): 10, (1, "b"): 50, (3, "c"): 60}


def test_append_refuses_columns_the_table_lacks(spark):
    name = _name()
    K.insert_rows(spark.createDataFrame([(1,)], "id long"), name)
    with pytest.raises(K.WriteError):
        K.append_rows(spark.createDataFrame([(2, "lost")], "id long, extra string"), name)
    assert spark.table(name).count() == 1


def test_upsert_rows_catalog_table(spark):
    name = _name()
    K.insert_rows(spark.createDataFrame([("w1", 5, "d1")], "item_id string, quantity int, last_updated string"),
                  name, primary_key="item_id")
    K.upsert_rows(spark.createDataFrame([("w1", 7, "d2"), ("w2", 1, "d2")],
                                        "item_id string, quantity int, last_updated string"), name, "item_id")
    got = {r["item_id"]: r["quantity"] for r in spark.table(name).collect()}
    assert got == {"w1": 7, "w2": 1}


def test_stats_insert_validation_defaults_and_update(spark):
    name = _name()
    with pytest.raises(K.WriteError) as e:
        K.stats_insert(spark.createDataFrame([("f", "csv", "x", "y")],
                                             "file_name string, file_type string, extra_field string, "
                                             "unknown_column string"), "file_processing_stats", name=name)
    assert all(x in str(e.value) for x in ("extra_field", "unknown_column", "records_extracted"))
    with pytest.raises(K.WriteError):
        K.stats_insert(spark.createDataFrame([("f",)], "file_name string"), "no_such_table", name=name)
    rows = K.stats_insert(spark.createDataFrame([("t1", "f.csv", "submitted")],
                                                "trace_id string, file_name string, status string"),
                          "workflow_submissions", name=name).collect()
    assert rows[0]["id"] and rows[0]["submitted_at"] is not None
    first_id = rows[0]["id"]
    out = K.stats_insert(spark.createDataFrame([("t1", "completed"), ("t2", "submitted")],
                                               "trace_id string, status string"),
                         "workflow_submissions", name=name, update_if_exists=True)
    got = {r["trace_id"]: r for r in out.collect()}
    assert got["t1"]["status"] == "completed" and got["t1"]["file_name"] == "f.csv" and got["t1"]["id"] == first_id
    assert got["t2"]["id"] and got["t2"]["submitted_at"] is not None
