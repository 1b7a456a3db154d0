"""Property tests: upsert is last-wins and idempotent, full outer join
row counts add up, redaction never leaks, ordered type inference follows its
rules — each against a small Python model on generated inputs."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeloom.functions.inference import infer_schema
from lakeloom.operators.quality import REDACTED, SENSITIVE_KEYS, redact_json_pattern
from lakeloom.operators.upsert import upsert

SPARK_SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

rows = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1000), st.sampled_from(["a", "b", None])),
                max_size=25)


@SPARK_SETTINGS
@given(target=rows, batch=rows)
def test_upsert_last_wins_and_idempotent(spark, target, batch):
    # unique keys in the target; batch rows carry a unique sequence number
    tgt = {k: (v, s) for k, v, s in target}
    t_df = spark.createDataFrame([(k, v, s) for k, (v, s) in tgt.items()], "k long, v long, s string")
    b_rows = [(k, i, v, s) for i, (k, v, s) in enumerate(batch)]
    b_df = spark.createDataFrame(b_rows, "k long, seq long, v long, s string")
    model = dict(tgt)
    for k, _, v, s in sorted(b_rows, key=lambda r: r[1]):
        model[k] = (v, s)
    once = upsert(t_df, b_df, ["k"], "seq")
    got = {r["k"]: (r["v"], r["s"]) for r in once.collect()}
    assert got == model
    twice = {r["k"]: (r["v"], r["s"]) for r in upsert(once, b_df, ["k"], "seq").collect()}
    assert twice == model


keys = st.lists(st.sampled_from(["x", "y", "z", "w", None]), max_size=15)


@SPARK_SETTINGS
@given(left=keys, right=keys)
def test_full_outer_row_count_identity(spark, left, right):
    a = spark.createDataFrame([(k, i) for i, k in enumerate(left)], "k string, a long")
    b = spark.createDataFrame([(k, i) for i, k in enumerate(right)], "k2 string, b long")
    cond = a["k"] == b["k2"]
    full = a.join(b, cond, "full_outer").count()
    inner = a.join(b, cond, "inner").count()
    only_a = a.join(b, cond, "left_anti").count()
    only_b = b.join(a, b["k2"] == a["k"], "left_anti").count()
    assert full == inner + only_a + only_b


json_leaf = st.one_of(st.integers(), st.text(max_size=5), st.booleans(), st.none())
json_key = st.one_of(st.sampled_from(list(SENSITIVE_KEYS) + ["Password", "TOKEN", "SslKeystorePasswd"]),
                     st.text(alphabet="abcdef", min_size=1, max_size=4))
json_tree = st.recursive(json_leaf, lambda c: st.one_of(st.lists(c, max_size=4),
                                                        st.dictionaries(json_key, c, max_size=4)), max_leaves=20)


def _leaks(obj) -> bool:
    if isinstance(obj, dict):
        return any((str(k).lower() in SENSITIVE_KEYS and v != REDACTED and not isinstance(v, (dict, list))) or _leaks(v)
                   for k, v in obj.items())
    if isinstance(obj, list):
        return any(_leaks(x) for x in obj)
    return False


@settings(max_examples=200, deadline=None)
@given(tree=json_tree)
def test_scalar_redaction_of_json_text_never_leaks(tree):
    text = re.sub(redact_json_pattern(), lambda m: f'{m.group(1)}"{REDACTED}"', json.dumps(tree))
    assert not _leaks(json.loads(text))


values = st.one_of(st.none(), st.integers(-5, 5), st.booleans(), st.sampled_from([1.5, -2.25]),
                   st.sampled_from(["s", "t"]))


def _model(records):
    """The rules: first value fixes the type (None -> TEXT); another non-null type -> TEXT."""
    def typ(v):
        if v is None:
            return None
        if isinstance(v, bool):
            return "BOOLEAN"
        if isinstance(v, int):
            return "INTEGER"
        if isinstance(v, float):
            return "DOUBLE PRECISION"
        return "TEXT"
    out = {}
    for rec in records:
        for k, v in rec.items():
            t = typ(v)
            if k not in out:
                out[k] = t if t is not None else "TEXT"
            elif t is not None and t != out[k]:
                out[k] = "TEXT"
    return out


@SPARK_SETTINGS
@given(records=st.lists(st.dictionaries(st.sampled_from(["a", "b", "c"]), values, min_size=1), min_size=1,
                        max_size=6))
def test_inference_matches_rules(spark, records):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "row_idx long, record string")
    got = {r["column_name"]: r["sql_type"] for r in infer_schema(df).collect()}
    assert got == _model(records)
