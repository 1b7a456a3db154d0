"""File and document sources (S1-S10, S13, S14, S18-S21, X5, X6) on small
fixtures written to a fresh temp folder."""

import io
import json
import os
import sqlite3
import tempfile
import zipfile

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lakeloom.operators.text import tables_to_rows
from lakeloom.sources import documents as DOC
from lakeloom.sources import files as SRC


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="lakeloom-test-")


def _write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return path


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimited_all_strings_with_header(spark, tmp, sep):
    p = _write(os.path.join(tmp, "people.csv"), f"Name{sep}Age{sep}City\nJohn{sep}30{sep}NYC\nJane{sep}25{sep}LA\n")
    rows, meta = SRC.extract_delimited(spark, p, sep, True, max_rows=1)
    assert rows.columns == ["Name", "Age", "City"]
    assert [tuple(r) for r in rows.collect()] == [("John", "30", "NYC")]
    assert dict(meta.first().asDict()) == {"total_rows": 2, "total_columns": 3, "returned_rows": 1}
    assert all(f.dataType.simpleString() == "string" for f in rows.schema.fields)


def test_delimited_no_header_and_empty(spark, tmp):
    p = _write(os.path.join(tmp, "n.csv"), "John,30,NYC\nJane,25,LA\n")
    rows, meta = SRC.extract_delimited(spark, p, ",", False)
    assert rows.columns == ["Column_1", "Column_2", "Column_3"] and meta.first()["total_rows"] == 2
    e = _write(os.path.join(tmp, "e.csv"), "")
    rows, meta = SRC.extract_delimited(spark, e, ",", True)
    assert meta.first()["total_rows"] == 0 and rows.count() == 0


def test_csv_typed_and_json_root(spark, tmp):
    p = _write(os.path.join(tmp, "t.csv"), "a,b\n1,x\n2,y\n")
    assert dict(SRC.read_csv_typed(spark, p).dtypes) == {"a": "int", "b": "string"}
    j = _write(os.path.join(tmp, "c.json"), json.dumps(
        {"customers": [{"id": 1, "name": "A", "email": "a@x"}, {"id": 2, "name": "B", "email": "b@x"}]}))
    df = SRC.read_json_records(spark, j)
    assert sorted(df.columns) == ["email", "id", "name"] and df.count() == 2
    assert SRC.landed_records(spark, j, "customers", filters={"id": [2]}).first()["name"] == "B"


def test_file_table_and_external_table(spark, tmp):
    import pyarrow as pa
    import pyarrow.parquet as pq
    d = os.path.join(tmp, "ext")
    os.makedirs(d)
    pq.write_table(pa.table({"id": list(range(5))}), os.path.join(d, "0.parquet"))
    pq.write_table(pa.table({"id": list(range(5, 8))}), os.path.join(d, "1.parquet"))
    assert SRC.file_table(spark, os.path.join(d, "0.parquet"), view="ft").count() == 5
    sample = SRC.external_parquet_table(spark, "ext_" + os.path.basename(tmp).replace("-", "_"), d)
    assert sample.count() == 8


def test_listing_prefix_and_splits(spark, tmp):
    for name in ("a.csv", "b.csv", "c.txt"):
        _write(os.path.join(tmp, name), "x,y\n1,2\n")
    lst = SRC.list_directory(spark, tmp)
    assert lst.count() == 3 and set(lst.columns) == {"path", "length", "modificationTime"}
    assert SRC.read_prefix(spark, tmp, "csv", "*.csv").count() == 2
    base = os.path.join(tmp, "ds")
    spark.range(3).write.parquet(os.path.join(base, "train"))
    spark.range(2).write.parquet(os.path.join(base, "test"))
    got = {r["split"]: r["n"] for r in SRC.read_splits(spark, base).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 3, "test": 2}


def test_xml_rows(spark, tmp):
    p = _write(os.path.join(tmp, "r.xml"), "<rows><row><a>1</a></row><row><a>2</a></row></rows>")
    assert SRC.read_xml(spark, p, "row").count() == 2


def test_logs_syslog_apache_custom(spark, tmp):
    sys_p = _write(os.path.join(tmp, "sys.log"), "<34>Oct 11 22:14:15 host1 su[123]: 'su root' failed\nnot a line\n")
    df = SRC.read_logs(spark, sys_p, "syslog", tags={"env": "test"})
    rows = {r["parsed"]: r for r in df.collect()}
    assert rows[True]["host"] == "host1" and rows[True]["app"] == "su" and rows[True]["pid"] == "123"
    assert rows[False]["host"] is None and rows[True]["env"] == "test" and rows[True]["source_file"].endswith("sys.log")
    ap = _write(os.path.join(tmp, "a.log"), '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 2326\n')
    r = SRC.read_logs(spark, ap, "apache").first()
    assert r["status"] == "200" and r["request"] == "GET /a HTTP/1.0"
    cu = _write(os.path.join(tmp, "c.log"), "k=1 v=x\n")
    r = SRC.read_logs(spark, cu, "custom", pattern=r"k=(\d+) v=(\w+)", fields=["k", "v"]).first()
    assert (r["k"], r["v"]) == ("1", "x")
    js = _write(os.path.join(tmp, "j.log"), '{"level": "INFO", "msg": "ok"}\n')
    assert SRC.read_logs(spark, js, "json", json_schema="level string, msg string").first()["msg"] == "ok"


def _zip_bytes(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, t in members.items():
            z.writestr(n, t)
    return buf.getvalue()


def test_zip_members_and_concat(spark, tmp):
    _write(os.path.join(tmp, "a.zip"), _zip_bytes({"1.txt": "one", "2.md": "two", "x.bin": "skip"}), "wb")
    files = DOC.binary_files(spark, tmp, "*.zip")
    m = DOC.zip_members(files)
    assert sorted(r["member"] for r in m.collect()) == ["1.txt", "2.md"]
    assert DOC.zip_text(files).first()["full_text"] == "one\ntwo"


def test_sqlite_rows(spark, tmp):
    p = os.path.join(tmp, "d.db")
    con = sqlite3.connect(p)
    con.execute("create table t(a int, b text)")
    con.executemany("insert into t values (?, ?)", [(1, "x"), (2, "y")])
    con.commit()
    con.close()
    rows = DOC.sqlite_rows(DOC.binary_files(spark, tmp, "*.db")).collect()
    assert sorted(json.loads(r["row_json"])["a"] for r in rows) == [1, 2] and rows[0]["table_name"] == "t"


# the fake extractor below travels to the Python workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _fake_pdf(data: bytes):
    pages = json.loads(data.decode())
    return [{"page_number": i + 1, "text": p["text"], "tables": p.get("tables", [])} for i, p in enumerate(pages)]


def test_pdf_pages_tables_and_full_text(spark, tmp):
    doc = [{"text": "Page one", "tables": [{"data": [["Name", "", "Qty"], ["a", "b", "1"], ["c"]]},
                                           {"data": []}]},
           {"text": "Page two"}]
    _write(os.path.join(tmp, "r.pdf"), json.dumps(doc))
    _write(os.path.join(tmp, "bad.pdf"), "not json")
    pages = DOC.pdf_pages(DOC.binary_files(spark, tmp, "*.pdf"), extractor=_fake_pdf)
    ok = pages.filter(F.col("error").isNull())
    assert ok.count() == 2 and pages.filter(F.col("error").isNotNull()).count() == 1
    assert DOC.pdf_full_text(pages).first()["full_text"] == "Page one\n\nPage two"
    t = DOC.pdf_tables(pages)
    assert t.count() == 1   # the empty table is dropped
    rows = tables_to_rows(t, ["path", "page_number", "table_index"]).orderBy("row_index").collect()
    assert rows[0]["record"] == {"Name": "a", "Column_2": "b", "Qty": "1"}
    assert rows[1]["record"] == {"Name": "c", "Column_2": None, "Qty": None}


def test_mixed_reader_routes_by_extension(spark, tmp):
    _write(os.path.join(tmp, "a.json"), '{"x": 1}')
    _write(os.path.join(tmp, "b.html"), "<p>Hi <b>there</b></p><script>x()</script>")
    _write(os.path.join(tmp, "c.md"), "# Title\n**bold** [link](http://x)")
    _write(os.path.join(tmp, "d.png"), b"\x89PNG", "wb")
    _write(os.path.join(tmp, "e.txt"), "plain")
    got = {os.path.basename(r["path"]): r for r in DOC.read_any(DOC.binary_files(spark, tmp)).collect()}
    assert json.loads(got["a.json"]["text"]) == {"x": 1}
    assert got["b.html"]["text"] == "Hi there"
    assert got["c.md"]["text"] == "Title\nbold link"
    assert got["d.png"]["text"] is None and "no decoder" in got["d.png"]["error"]
    assert got["e.txt"]["text"] == "plain" and got["e.txt"]["kind"] == "text"


def test_bounded_topic_read(spark):
    from lakeloom.sources.derived import topic_messages
    from tests.conftest import SF
    m = topic_messages(spark, SF)
    out = SRC.bounded_topic_read(m, "click", 1, offset=3, limit=4).collect()
    assert [r["msg_offset"] for r in out] == [3, 4, 5, 6]
    offs = SRC.partition_offsets(m).filter((F.col("topic") == "click") & (F.col("part_no") == 1)).first()
    assert offs["begin_offset"] == 0 and offs["end_offset"] == m.filter(
        (F.col("topic") == "click") & (F.col("part_no") == 1)).count()
