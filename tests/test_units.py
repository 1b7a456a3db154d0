"""Unit tests for the quirks recorded in the survey: query builder (P1-P5, A10,
A11, O1, C5), tracking helpers (J7, O4, P6, F1-F12), redaction and validation
(G1-G7), catalog and SQL surface (C1-C10), user functions (D1-D4) and
pattern jobs (C9, X9, M9, M10)."""

import json
import os
import tempfile
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.functions import scalar as S
from lakeloom.functions import udfs as U
from lakeloom.functions.text import html_to_text
from lakeloom.operators import quality as G
from lakeloom.operators import query_builder as QB
from lakeloom.operators import text as X
from lakeloom.operators import tracking as TR
from lakeloom.plans import catalog as C
from lakeloom.plans import patterns as PL
from lakeloom.sinks import tables as K
from lakeloom.sources.derived import fps, ws
from tests.conftest import SF


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("Ann", 30, 7.25, 1, "first"), ("Bob", 22, 8.05, 0, "third"), ("abc", 41, 71.28, 1, "first"),
         ("Cal", None, 13.0, 0, "second")], "name string, age int, fare double, survived int, class string")


def test_contains_faithful_like_vs_documented(people):
    faithful = QB.run_file_query(people, QB.FileQuery(filters=[QB.Filter("name", "contains", "b")],
                                                      faithful_contains=True))
    documented = QB.run_file_query(people, QB.FileQuery(filters=[QB.Filter("name", "contains", "b")]))
    assert faithful.count() == 0                                  # raw LIKE 'b' is equality
    assert sorted(r["name"] for r in documented.collect()) == ["Bob", "abc"]


def test_literal_typing_and_second_filter_alone(people):
    q = QB.FileQuery(column_names="name", filters=[QB.Filter("age", "greater_than_or_equal", "30"),
                                                   QB.Filter("class", "not_equal_to", "third")])
    assert sorted(r["name"] for r in QB.run_file_query(people, q).collect()) == ["Ann", "abc"]
    types = people.select(QB.typed_literal("1.5").alias("a"), QB.typed_literal("7").alias("b"),
                          QB.typed_literal("x").alias("c")).dtypes
    assert [t for _, t in types] == ["double", "int", "string"]
    with pytest.raises(ValueError):
        QB.predicate(QB.Filter("age", "between", 1))


def test_select_group_order_limit_offset_describe(people):
    q = QB.FileQuery(column_names="class, COUNT(*) AS n, ROUND(AVG(fare), 2) AS avg_fare", group_by="class",
                     order_by="n", order_direction="DESC", limit=1)
    r = QB.run_file_query(people, q).first()
    assert (r["class"], r["n"]) == ("first", 2)
    page = QB.run_file_query(people, QB.FileQuery(column_names="name", order_by="name", limit=2, offset=1))
    assert [x["name"] for x in page.collect()] == ["Bob", "Cal"]
    d = QB.run_file_query(people, QB.FileQuery(describe=True)).collect()
    assert [(x["column_name"], x["column_type"]) for x in d][:2] == [("name", "string"), ("age", "int")]
    sel = QB.run_file_query(people, QB.FileQuery(column_names="name, ROUND(fare, 1) AS f, 'a,b' AS s",
                                                 filters=[QB.Filter("name", "equal_to", "Ann")])).first()
    assert (sel["name"], sel["f"], sel["s"]) == ("Ann", 7.3, "a,b")


def test_chart_aggregate_and_pivot(people, spark):
    out = QB.chart_aggregate(people, [{"column_name": "class"}, {"column_name": "fare", "aggregate_function": "max"}])
    assert dict((r["class"], r["max_fare"]) for r in out.collect())["first"] == 71.28
    assert QB.chart_aggregate(people, [{"column_name": "name"}]).columns == ["name"]
    with pytest.raises(ValueError):
        QB.chart_aggregate(people, [])
    p = QB.pivot_counts(people, F.col("survived"), "class", ["first", "second", "third"])
    assert {r["survived"]: (r["first"], r["third"]) for r in p.collect()} == {1: (2, 0), 0: (0, 1)}


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("https://h/a/b/f.csv?x=1#y", "2024-01-01 10:00:00", "2024-01-01 10:00:00.5")],
                               "u string, t1 string, t2 string")
    r = df.select(S.url_last_segment("u").alias("a"), S.url_file_name("u").alias("b"),
                  S.iso_timestamp(F.col("t1").cast("timestamp_ntz")).alias("c"),
                  S.iso_timestamp(F.col("t2").cast("timestamp_ntz")).alias("d"),
                  S.pct_rate(F.lit(1), F.lit(0)).alias("e"), S.pct_rate(F.lit(1), F.lit(4)).alias("f"),
                  S.zero_as_null(F.lit(0.0)).alias("g"), S.word_count(F.lit("  a b\tc ")).alias("h"),
                  S.is_upper_text(F.lit("ABC 1")).alias("i"), S.is_upper_text(F.lit("123")).alias("j")).first()
    assert (r["a"], r["b"]) == ("f.csv?x=1#y", "f.csv")
    assert (r["c"], r["d"]) == ("2024-01-01T10:00:00", "2024-01-01T10:00:00.500000")
    assert (r["e"], r["f"], r["g"], r["h"], r["i"], r["j"]) == (0.0, 25.0, None, 3, True, False)
    with pytest.raises(Exception):
        spark.range(1).select(S.calc(F.lit(1), F.lit(0), "/")).collect()


def test_nested_submission_rows(spark):
    joined = TR.submission_file_join(ws(spark, SF), fps(spark, SF), limit=None)
    nested = TR.nest_submission_rows(joined)
    kinds = nested.select(F.col("workflow_submission").isNull().alias("a"),
                          F.col("file_processing").isNull().alias("b")).distinct().collect()
    assert {(r["a"], r["b"]) for r in kinds} == {(False, False), (False, True), (True, False)}
    faithful = TR.submission_file_join(ws(spark, SF), fps(spark, SF), limit=None, faithful=True)
    assert faithful.filter(F.col("ws_id").isNull() & F.col("file_name").isNull()).count() > 0


def test_recent_rows_ascending_flag_and_trace_overrides_status(spark):
    f = fps(spark, SF)
    asc = TR.recent_rows(f, "uploaded_at", "id", 3).collect()
    desc = TR.recent_rows(f, "uploaded_at", "id", 3, ascending=False).collect()
    assert asc[0]["uploaded_at"] < desc[0]["uploaded_at"]
    w = ws(spark, SF)
    one = TR.workflow_submissions(w, status="no-such-status", trace_id="trace-1").collect()
    assert len(one) == 1 and one[0]["trace_id"] == "trace-1"


def test_html_text_extraction():
    html = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head>"
            "<body><!-- c --><p> Hello &amp; <b>bye</b> </p>\n<div>  </div></body></html>")
    assert html_to_text(html) == "T\nHello &\nbye"
    assert html_to_text(html, "", False) == "T Hello & bye \n  "


@pytest.mark.parametrize("raw", [False, True])
def test_pages_reach_python_in_batches_of_bounded_size(spark, raw):
    bounds = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    for name in bounds:
        spark.conf.unset(name)
    pages = spark.range(0, 300, 1, 1).selectExpr("id as page_id", "'u' as url", "if(id = 7, null, concat('<p>', repeat('ab ', 60000), '</p>')) as html")
    got = X.page_text(pages, raw).agg(F.count("text"), F.count("*"), F.max("n_chars")).first()
    assert tuple(got) == (299, 300, 180_000 if raw else 179_999)

    @F.pandas_udf("long")
    def held(html: pd.Series) -> pd.Series:
        return pd.Series([int(html.str.len().sum())] * len(html))
    try:
        assert pages.select(held("html").alias("n")).agg(F.max("n")).first()[0] <= 2 * X.PAGE_BYTES
    finally:
        for name in bounds:
            spark.conf.unset(name)


def test_markdown_formatting(spark):
    text = "INTRO\n\n  Items:  \nplain line\nTHIS HEADING HAS WAY TOO MANY WORDS TO BE A HEADING AT ALL\n"
    r = spark.createDataFrame([(text,), ("   \n",)], "t string").select(X.text_to_markdown(F.col("t")).alias("m"))
    got = [x["m"] for x in r.collect()]
    assert got[0] == ("## INTRO\n\n**Items:**\n\nplain line\n\n"
                      "THIS HEADING HAS WAY TOO MANY WORDS TO BE A HEADING AT ALL\n\n\n---")
    assert got[1] == "---"


def test_redaction_tree_json_and_columns(spark):
    tree = {"user": "u", "Password": "p", "nested": {"TOKEN": "t", "list": list(range(250))},
            "sslKeystorePasswd": {"deep": 1}}
    shape = StructType.fromDDL("user string, Password string, nested struct<TOKEN: string, list: array<int>>, "
                               "sslKeystorePasswd struct<deep: int>")
    df = spark.createDataFrame([(json.dumps(tree),), ('{"token": "x", bad',), (None,)], "j string")
    out = [r[0] for r in df.select(G.redact_json("j", shape)).collect()]
    red = json.loads(out[0])
    assert red["Password"] == red["nested"]["TOKEN"] == red["sslKeystorePasswd"] == G.REDACTED
    assert red["user"] == "u" and red["nested"]["list"] == list(range(250))
    assert out[1] == '{"token": "' + G.REDACTED + '", bad' and out[2] is None
    nulls = spark.createDataFrame([(None, {"Token": "t", "k": "v"}, {"secret": 1, "n": 2})],
                                  "cfg struct<host: string, password: string>, m map<string,string>, c map<string,int>")
    n = G.redact_columns(nulls).first()
    assert n["cfg"] is None and n["m"] == {"Token": G.REDACTED, "k": "v"} and n["c"] == {"secret": None, "n": 2}
    flat = spark.createDataFrame([('{"a": 1, "Secret": "s", "token": 12, "n": {"passcode": true}}',)], "j string")
    txt = flat.select(G.redact_json_scalars("j")).first()[0]
    assert json.loads(txt) == {"a": 1, "Secret": G.REDACTED, "token": G.REDACTED, "n": {"passcode": G.REDACTED}}
    typed = spark.createDataFrame([(1, ("x", "pw"), [("k", "t")])],
                                  "id int, cfg struct<host:string, password:string>, "
                                  "items array<struct<name:string, token:string>>")
    r = G.redact_columns(typed).first()
    assert r["cfg"]["password"] == G.REDACTED and r["items"][0]["token"] == G.REDACTED and r["cfg"]["host"] == "x"
    t = spark.range(1).select(G.truncate_array(F.sequence(F.lit(1), F.lit(250))).alias("t")).first()["t"]
    assert len(t["items"]) == 200 and t["omitted_count"] == 50 and t["truncated"]


def test_validate_route_update_enrich(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, -1.0, None), (3, 60.0, "b")], "id int, v double, t string")
    v = G.validate(df, [("non_negative", F.col("v") >= 0), ("typed", F.col("t").isNotNull())])
    r = G.route(v, [("bad", ~F.col("valid")), ("big", F.col("v") > 50)], default="main")
    got = {x["id"]: (x["valid"], x["errors"], x["route"]) for x in r.collect()}
    assert got == {1: (True, [], "main"), 2: (False, ["non_negative", "typed"], "bad"), 3: (True, [], "big")}
    assert G.split_routes(r, ["bad"])["bad"].count() == 1
    assert G.update_fields(df, {"v": F.col("v") * 2}).agg(F.sum("v")).first()[0] == 128.0
    lookup = spark.createDataFrame([("a", "Alpha")], "t string, label string")
    assert G.enrich(df, lookup, "t").filter(F.col("label") == "Alpha").count() == 1
    assert G.sql_on_records(df, "SELECT COUNT(*) AS n FROM records WHERE v > 0", "records").first()["n"] == 2


def test_readonly_guard_and_sql_surface(spark):
    spark.range(3).createOrReplaceTempView("guard_t")
    assert C.readonly_sql(spark, "  SELECT * FROM guard_t").count() == 3
    for bad in ("DROP TABLE guard_t", "insert into x values (1)"):
        with pytest.raises(C.SqlRefused, match="Only read-only queries are allowed."):
            C.readonly_sql(spark, bad)
    with pytest.raises(ValueError):
        C.readonly_sql(spark, "   ")
    name = "g_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE TABLE {name} (id BIGINT) USING parquet")
    with pytest.raises(C.SqlRefused):
        C.readonly_sql(spark, f"WITH s AS (SELECT 1 AS id) INSERT INTO {name} SELECT * FROM s")
    assert C.run_sql(spark, "SELECT 1 AS x;").first()["x"] == 1
    assert C.rows_as_json(spark.sql("SELECT 1 AS a, DATE'2024-01-02' AS d")).first()["row"] == '["1","2024-01-02"]'
    assert name in [r["name"] for r in C.list_tables(spark).collect()]
    assert name in [r["table"] for r in C.table_tree(spark).collect()]
    ok = C.analyze_sql(spark, "SELECT id FROM guard_t")
    assert ok["valid"] and "Project" in ok["plan"] or "Range" in ok["plan"]
    bad = C.analyze_sql(spark, "SELECT nope FROM guard_t")
    assert not bad["valid"] and bad["error_type"] == "AnalysisException"
    ds, cols = C.dataset(spark, name, "ds_view")
    assert cols == ["id"]
    assert not C.validate_source(spark, {"type": "remote-kafka"}).valid
    assert C.validate_source(spark, {"format": "parquet", "path": f"{SF}/region.parquet"}).valid
    assert C.error_row(spark, ValueError("boom")).first()["error_type"] == "ValueError"


def test_user_functions(spark):
    U.register_scalar(spark, "plus_one", lambda s: s + 1, "long")
    assert spark.sql("SELECT plus_one(41) AS v").first()["v"] == 42
    U.register_aggregate(spark, "pd_median", lambda s: float(s.median()), "double")
    assert spark.sql("SELECT pd_median(id) AS m FROM range(5)").first()["m"] == 2.0
    U.register_table_function(spark)
    spark.createDataFrame([(1, "a\n\n b \nc")], "id int, text string").createOrReplaceTempView("docs_udtf")
    rows = spark.sql("SELECT d.id, t.line_no, t.line FROM docs_udtf d, LATERAL doc_lines(d.text) t").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(1, "a"), (2, "b"), (3, "c")]
    assert "plus_one" in [r["name"] for r in U.list_functions(spark, "plus*").collect()]

    import dataclasses

    @dataclasses.dataclass
    class Args:
        n: int

    tool = U.Tool("range_tool", lambda s, user, call: s.range(call.n), call_params=Args)
    assert tool(spark, call={"n": 4}).count() == 4


def test_pipeline_requirements_and_lifecycle(spark):
    assert PL.validate_requirements("log_aggregation", {"log_format": "json"}) == ["log_locations",
                                                                                  "output_directory"]
    with pytest.raises(ValueError):
        PL.validate_requirements("nope", {})
    ev = spark.createDataFrame([
        ("f1", "2024-01-01 00:00:00", "a.csv", "processing", None, None),
        ("f1", "2024-01-01 00:01:00", None, "completed", 10, 5.5)],
        "id string, at string, file_name string, processing_status string, records_extracted int, "
        "processing_duration_ms double")
    r = PL.fold_lifecycle(ev.withColumn("at", F.col("at").cast("timestamp"))).first()
    assert (r["file_name"], r["processing_status"], r["records_extracted"]) == ("a.csv", "completed", 10)
    lists = PL.lists_as_json(spark.createDataFrame([(["a", "b"],)], "agents array<string>"), ["agents"])
    assert lists.first()["agents"] == '["a","b"]'


def test_document_to_table_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="lakeloom-doc-")
    p = os.path.join(d, "people.csv")
    with open(p, "w") as f:
        f.write("Name,Age,City\nJohn,30,NYC\nJane,25,LA\n")
    table, stats = "doc_" + uuid.uuid4().hex[:8], "stats_" + uuid.uuid4().hex[:8]
    res = PL.document_to_table(spark, p, table, stats_table=stats, workflow_id="wf_1")
    assert res == {"table": table, "rows": 2, "columns": 3}
    assert sorted(map(tuple, spark.table(table).collect())) == [("Jane", "25", "LA"), ("John", "30", "NYC")]
    st = spark.table(stats).first()
    assert st["file_name"] == "people.csv" and st["records_extracted"] == 2 and st["id"]


def test_transformation_and_log_aggregation(spark):
    d = tempfile.mkdtemp(prefix="lakeloom-tr-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    pd.DataFrame({"k": [1, 2, 3], "v": [1.0, -1.0, 2.0]}).to_csv(os.path.join(src, "a.csv"), index=False)
    PL.transformation(spark, src, "csv", "parquet", os.path.join(d, "out"),
                      rules=[("pos", F.col("v").cast("double") > 0)], updates={"v2": F.col("v").cast("double") * 10},
                      dead_letter_directory=os.path.join(d, "dead"))
    assert spark.read.parquet(os.path.join(d, "out")).count() == 2
    assert spark.read.json(os.path.join(d, "dead")).count() == 1
    logs = os.path.join(d, "logs")
    os.makedirs(logs)
    with open(os.path.join(logs, "app.log"), "w") as f:
        f.write('{"ts": "2024-01-30 10:00:00", "msg": "new"}\n{"ts": "2023-01-01 00:00:00", "msg": "old"}\n')
    out = PL.log_aggregation(spark, [logs], "json", os.path.join(d, "agg"), tags={"env": "prod"},
                             retention_days=30, ts_col="ts", now="2024-01-31", json_schema="ts string, msg string")
    assert [r["msg"] for r in out.collect()] == ["new"] and out.first()["env"] == "prod"
    assert K.compact(spark, os.path.join(d, "out"), os.path.join(d, "compact")) == 1


def test_retention_drops_old_partitions(spark):
    d = tempfile.mkdtemp(prefix="lakeloom-ret-") + "/t"
    spark.createDataFrame([("2024-01-01", 1), ("2024-01-20", 2), ("2024-01-30", 3)], "dt string, v int") \
        .write.partitionBy("dt").parquet(d)
    dropped = K.drop_old_partitions(spark, d, "dt", "2024-01-15")
    assert [os.path.basename(x) for x in dropped] == ["dt=2024-01-01"]
    assert sorted(r["v"] for r in spark.read.parquet(d).collect()) == [2, 3]


def test_sinks_shapes(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert sorted(r["value"] for r in K.json_records(df).collect()) == ['{"a":1}', '{"a":2,"b":"b"}']
    assert [r["value"] for r in K.pipe_text(df).orderBy("o", "value").collect()] == ["a | b", "1 | ", "2 | b"]
    for fmt in ("json", "csv", "parquet", "orc"):
        K.write_files(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).option("header", "true").load(str(tmp_path / fmt)).count() == 2
    with pytest.raises(K.WriteError):
        K.write_files(df, str(tmp_path / "x"), "yaml")


def test_pruned_full_join_equals_full_join(spark, monkeypatch):
    from lakeloom.operators import scan
    monkeypatch.setattr(scan, "SMALL_INPUT_BYTES", 0)   # take the pruned path on small data
    t = "timestamp_ntz"
    ws_rows = [("ws-1", "trace-1", "https://x/in/a.csv", "a.csv", "completed", "2024-01-02 00:00:00"),
               ("ws-2", "trace-2", "https://x/in/b.csv?v=1", None, "failed", None),        # undated
               ("ws-3", "trace-3", "https://x/in/c.csv", "c.csv", "completed", "2024-01-01 00:00:00"),
               ("ws-4", "trace-4", "https://x/in/d.csv", "d.csv", "submitted", "2024-01-05 00:00:00"),
               ("ws-5", "trace-5", "https://x/in/z.csv", "z.csv", "completed", None)]       # undated, no file
    w = spark.createDataFrame(ws_rows, "id string, trace_id string, uploaded_file_url string, file_name string, "
                                       "status string, submitted_at string").withColumn(
        "submitted_at", F.col("submitted_at").cast(t))
    for c in ("workflow_id", "workflow_name", "error_message", "metadata"):
        w = w.withColumn(c, F.lit(None).cast("string"))
    w = w.withColumn("completed_at", F.lit(None).cast(t)).withColumn("crew_kickoff_completed", F.lit(False))
    fps_rows = [("f1", "a.csv", "2023-12-31 00:00:00"), ("f2", "a.csv", "2024-01-03 00:00:00"),
                ("f3", "b.csv?v=1", "2023-06-01 00:00:00"), ("f4", "lone1.csv", "2022-01-01 00:00:00"),
                ("f5", "lone2.csv", "2024-02-01 00:00:00"), ("f6", "c.csv", None), ("f7", "lone3.csv", None)]
    f = spark.createDataFrame(fps_rows, "id string, file_name string, uploaded_at string").withColumn(
        "uploaded_at", F.col("uploaded_at").cast(t))
    for c, typ in (("file_type", "string"), ("file_size_bytes", "bigint"), ("processing_status", "string"),
                   ("records_extracted", "int"), ("workflow_id", "string"), ("workflow_name", "string"),
                   ("processing_duration_ms", "double"), ("completed_at", t), ("error_message", "string")):
        f = f.withColumn(c, F.lit(None).cast(typ))
    for status in (None, "completed"):
        full = TR.submission_file_join(w, f, status=status, limit=None).collect()
        for k in (1, 2, 3, 5, 8, 20):
            got = TR.submission_file_join(w, f, status=status, limit=k).collect()
            assert [tuple(r) for r in got] == [tuple(r) for r in full[:k]], (status, k)


def test_convert_format_catalog_fallback_and_job_states(spark, tmp_path):
    from lakeloom.streaming import topics as ST
    src = tmp_path / "in.csv"
    src.write_text("a,b\n1,x\n2,y\n")
    K.convert_format(spark, str(src), "csv", str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert ST.resolve_catalog(spark, "no_such_catalog") == spark.catalog.currentCatalog()
    assert ST.resolve_catalog(spark, "spark_catalog") == "spark_catalog"
    assert ST.job_states(spark).count() == 0          # no active streams here


def test_cluster_conf_scales_with_input():
    from lakeloom.session import cluster_conf
    big = cluster_conf(100 * 2**40, 8000)
    small = cluster_conf(2**30, 8)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // 2 // (256 * 2**20) + 1
    assert int(small["spark.sql.shuffle.partitions"]) == 24
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_band_join_and_sampling_edges(spark):
    from lakeloom.operators.joins import band_join_count
    from lakeloom.operators.topics import sample_output
    t = "timestamp_ntz"
    left = spark.createDataFrame([(1, 10, "2024-01-01 01:00:00"), (1, 11, "2024-01-01 03:00:00")],
                                 "u int, id int, ts string").withColumn("ts", F.col("ts").cast(t))
    right = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:30:00", 2.0),
                                   (1, "2024-01-01 01:00:00", 4.0), (2, "2024-01-01 00:30:00", 8.0)],
                                  "u int, ts string, v double").withColumn("ts", F.col("ts").cast(t))
    got = {r["id"]: (r["matches"], r["s"]) for r in
           band_join_count(left, right, ["u"], "ts", "ts", 3600, "id", {"s": F.col("v")}).collect()}
    assert got == {10: (2, 3.0), 11: (0, None)}          # [t - 1h, t): 00:00 and 00:30
    incl = {r["id"]: r["matches"] for r in
            band_join_count(left, right, ["u"], "ts", "ts", 3600, "id", inclusive_end=True).collect()}
    assert incl == {10: 3, 11: 0}
    ev = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}") for i in range(10)], "id int, ts string") \
        .withColumn("ts", F.col("ts").cast(t))
    assert [r["id"] for r in sample_output(ev, "ts", "id", 0, 6, 3).collect()] == [3, 4, 5]
    assert [r["id"] for r in sample_output(ev, "ts", "id", 3000, 100, 100).collect()] == [0, 3, 6, 9]


def test_bucketed_tables_join_without_shuffle(spark):
    import uuid as _uuid
    a, b = "ba_" + _uuid.uuid4().hex[:8], "bb_" + _uuid.uuid4().hex[:8]
    K.save_bucketed(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")), a, ["k"], 8,
                    sort_by=["k"])
    K.save_bucketed(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("y")), b, ["k"], 8,
                    sort_by=["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table(a).join(spark.table(b), "k")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert j.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_readonly_guard_reads_the_parsed_plan(spark):
    spark.range(2).createOrReplaceTempView("guard_cols")
    # a column called "Command" is data, not a command
    assert C.readonly_sql(spark, "SELECT id AS Command, 'InsertIntoStatement' AS s FROM guard_cols").count() == 2
    assert C.readonly_sql(spark, "WITH a AS (SELECT 1 AS id) SELECT * FROM a").first()["id"] == 1
    assert C.readonly_sql(spark, "SHOW TABLES").count() >= 0


def test_analyze_never_executes(spark):
    name = "keep_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE TABLE {name} (id BIGINT) USING parquet")
    r = C.analyze_sql(spark, f"DROP TABLE {name}")
    assert r["valid"] and r["command"] and spark.catalog.tableExists(name)
    r = C.analyze_sql(spark, f"INSERT INTO {name} VALUES (1)")
    assert r["valid"] and spark.table(name).count() == 0


def test_json_and_db_value_helpers(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([('{"b": [1, 2], "a": {"x": null}}', "2024-01-02", (1, "z")), ("{oops", None, None)],
                               "j string, d string, s struct<i:int, t:string>")
    r = df.select(S.json_normalize("j").alias("n"), S.json_path("j", "$.a.x", "none").alias("p"),
                  S.to_db_value(F.col("d").cast("date"), T.DateType()).alias("ts"),
                  S.to_db_value("s", df.schema["s"].dataType).alias("sj")).collect()
    assert json.loads(r[0]["n"]) == {"a": {"x": None}, "b": [1, 2]} and r[1]["n"] is None
    assert r[0]["p"] == "none" and r[1]["p"] == "none"
    assert str(r[0]["ts"]).startswith("2024-01-02 00:00:00") and r[0]["sj"] == '{"i":1,"t":"z"}'
