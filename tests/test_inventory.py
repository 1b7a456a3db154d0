"""Inventory flattening, name tests, point lookup, job samples, dashboard,
counter increments and notification read flags (P10-P12, A15, A17, A19, J6, T15)."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import inventory as INV
from lakeloom.sources.derived import fps, wes
from tests.conftest import SF

ENV_KEYS = {"workflow_id": "WF_ID", "model_id": "MODEL_ID", "render_mode": "RENDER_MODE"}


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame([
        ("a1", "Workflow: intake", "sub1", "APPLICATION_RUNNING", '{"WF_ID": "w1", "MODEL_ID": "m1", "RENDER_MODE": "x"}'),
        ("a2", "Plain app", None, "APPLICATION_STOPPED", "{not json"),
        ("a3", "file-to-relational demo", "sub3", "RUNNING", None)],
        "id string, name string, subdomain string, status string, environment string")


def test_flatten_and_counts(apps):
    flat = INV.flatten_inventory(apps, "example.org", ENV_KEYS)
    rows = {r["id"]: r for r in flat.collect()}
    assert rows["a1"]["url"] == "https://sub1.example.org" and rows["a1"]["workflow_id"] == "w1"
    assert rows["a2"]["url"] is None and rows["a2"]["workflow_id"] is None and not rows["a2"]["is_workflow"]
    c = INV.inventory_counts(flat).first()
    assert (c["count"], c["workflow_count"], c["running_count"]) == (3, 1, 2)
    assert INV.flatten_inventory(apps, None, ENV_KEYS).filter(F.col("url").isNotNull()).count() == 0


def test_name_tests(spark):
    df = spark.createDataFrame([("Data Studio",), ("data studio - me",), ("Data Studio2",), ("x Data Studio",)], "n string")
    got = [r[0] for r in df.select(INV.project_name_matches(F.col("n"), "Data Studio")).collect()]
    assert got == [True, True, False, False]
    assert df.select(INV.is_extractor_app(F.lit("PDF to Relational v2"))).first()[0]


def test_lookup_one(apps):
    assert INV.lookup_one(apps, "id", "a3")["name"] == "file-to-relational demo"
    with pytest.raises(INV.NotFound):
        INV.lookup_one(apps, "id", "zz", "application")


def test_jobs_with_samples(spark):
    jobs = spark.createDataFrame([("j1", "RUNNING", "s1"), ("j2", "STOPPED", None), ("j3", "RUNNING", "gone")],
                                 "job_id string, state string, sample_id string")
    samples = spark.createDataFrame([("s1", "r1", "RUNNING"), ("s1", "r2", "RUNNING")],
                                    "sample_id string, record string, job_status string")
    got = {r["job_id"]: (r["sample_records_count"], r["sample_status"])
           for r in INV.jobs_with_samples(jobs, samples).collect()}
    assert got == {"j1": (2, "RUNNING"), "j2": (0, "no_sample_id"), "j3": (0, "error")}
    s = INV.job_summary(jobs).first()
    assert (s["total_jobs"], s["running_jobs"]) == (3, 2)


def test_dashboard_matches_parts(spark):
    f, w = fps(spark, SF), wes(spark, SF)
    d = INV.dashboard(f, w).first()
    assert d["files"]["total_processed"] == f.count()
    counts = [t["count"] for t in d["files"]["by_type"]]
    assert counts == sorted(counts) and sum(counts) == f.count()
    assert d["workflows"]["total_executions"] == w.count()


def test_increment_counters_and_read_flags(spark):
    target = spark.createDataFrame([("agent-a", 5, 1)], "agent_name string, total_executions long, failed_executions long")
    deltas = spark.createDataFrame([("agent-a", 1, 0), ("agent-a", 1, 1), ("agent-b", 1, 0)],
                                   "agent_name string, total_executions long, failed_executions long")
    out = {r["agent_name"]: (r["total_executions"], r["failed_executions"]) for r in
           INV.increment_counters(target, deltas, ["agent_name"], ["total_executions", "failed_executions"]).collect()}
    assert out == {"agent-a": (7, 2), "agent-b": (1, 0)}
    notes = spark.createDataFrame([("n1", False), ("n2", False)], "notification_id string, is_read boolean")
    ids = spark.createDataFrame([("n2",), ("n9",)], "notification_id string")
    got = {r[0]: r[1] for r in INV.set_read(notes, ids).collect()}
    assert got == {"n1": False, "n2": True}
