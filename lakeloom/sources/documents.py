"""Binary documents: PDF pages and tables, zip members, SQLite dumps and a
mixed-type reader routed by extension (S6-S9, X5, X6).

Files are listed and read by the ``binaryFile`` source, so each task gets a
slice of the files; per-file decoding runs in ``mapInPandas`` with stdlib
codecs.  Decoders that need a third-party library (PDF, OCR, office formats)
are pluggable: a missing library turns into an ``error`` value on that row,
never into a failed job.
"""

from __future__ import annotations

import io
import json
import os
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import html_to_text

# Zip members whose text is kept, and the extension routing of
# the mixed-type reader.
ZIP_TEXT_SUFFIXES = (".txt", ".csv", ".json", ".xml", ".md")
ROUTES = {
    "pdf": "pdf", "docx": "docx", "png": "image", "jpg": "image", "jpeg": "image", "xls": "sheet",
    "xlsx": "sheet", "rtf": "rtf", "zip": "zip", "json": "json", "html": "html", "htm": "html", "md": "markdown",
    "sqlite": "sqlite", "db": "sqlite",
}

PAGE_SCHEMA = ("path string, page_number int, text string, "
               "tables array<struct<table_index:int, data:array<array<string>>>>, error string")
MEMBER_SCHEMA = "path string, member string, text string"
SQLITE_SCHEMA = "path string, table_name string, row_json string"
TEXT_SCHEMA = "path string, kind string, text string, error string"

PdfExtractor = Callable[[bytes], list[dict]]


def default_pdf_extractor(data: bytes) -> list[dict]:
    """Pages via pdfplumber (text and tables) or pypdf (text only), whichever is installed."""
    try:
        import pdfplumber  # type: ignore
    except ImportError:
        pdfplumber = None
    if pdfplumber is not None:
        out = []
        with pdfplumber.open(io.BytesIO(data)) as doc:
            for i, page in enumerate(doc.pages):
                tables = [t for t in (page.extract_tables() or []) if t]
                out.append({"page_number": i + 1, "text": page.extract_text() or "",
                            "tables": [{"table_index": j + 1, "data": t} for j, t in enumerate(tables)]})
        return out
    try:
        from pypdf import PdfReader  # type: ignore
    except ImportError as e:
        raise RuntimeError("no PDF backend installed (pdfplumber or pypdf)") from e
    r = PdfReader(io.BytesIO(data))
    return [{"page_number": i + 1, "text": p.extract_text() or "", "tables": []} for i, p in enumerate(r.pages)]


def binary_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path)


def _clean_table(t: list) -> list:
    return [[None if c is None else str(c) for c in row] for row in t]


def pdf_pages(files: DataFrame, extractor: PdfExtractor | None = None, extract_tables: bool = True) -> DataFrame:
    """One row per page: text and non-empty tables (page and table numbers from 1)."""
    ext = extractor or default_pdf_extractor

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    pages = ext(bytes(content))
                except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failed job
                    rows.append((path, None, None, [], f"{type(e).__name__}: {e}"))
                    continue
                for p in pages:
                    tables = [{"table_index": int(t.get("table_index", j + 1)), "data": _clean_table(t["data"])}
                              for j, t in enumerate(p.get("tables") or []) if t.get("data")] if extract_tables else []
                    rows.append((path, int(p["page_number"]), p.get("text") or "", tables, None))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "tables", "error"])
    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def pdf_full_text(pages: DataFrame) -> DataFrame:
    """Pages joined by a blank line, in page order."""
    from lakeloom.operators.text import assemble_pages
    return assemble_pages(pages.filter(F.col("error").isNull()), "path", "page_number", "text")


def pdf_tables(pages: DataFrame) -> DataFrame:
    """Tables as rows ``(path, page_number, table_index, data)`` for X5."""
    t = pages.select("path", "page_number", F.explode("tables").alias("t"))
    return t.select("path", "page_number", "t.table_index", "t.data")


def zip_members(files: DataFrame, suffixes=ZIP_TEXT_SUFFIXES) -> DataFrame:
    """One row per text member of each zip file (member order kept by name)."""
    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for name in z.namelist():
                            if name.lower().endswith(suffixes):
                                rows.append((path, name, z.read(name).decode("utf-8", errors="replace")))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "text"])
    return files.select("path", "content").mapInPandas(run, MEMBER_SCHEMA)


def zip_text(files: DataFrame) -> DataFrame:
    """U3 over S8: members concatenated, separated by newline, in member order."""
    from lakeloom.operators.text import assemble_pages
    return assemble_pages(zip_members(files), "path", "member", "text", sep="\n")


def _sqlite_rows(data: bytes) -> list[tuple[str, str]]:
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        out = []
        tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type='table' ORDER BY name")]
        for t in tables:
            cur = con.execute(f'SELECT * FROM "{t}"')
            names = [d[0] for d in cur.description]
            for row in cur:
                out.append((t, json.dumps(dict(zip(names, row)), default=str)))
        return out
    finally:
        con.close()


def sqlite_rows(files: DataFrame) -> DataFrame:
    """Every table's rows of each SQLite file as ``(table_name, row_json)``,
    decoded in memory (no local scratch file)."""
    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, t, j) for t, j in _sqlite_rows(bytes(content))]
                except sqlite3.DatabaseError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "table_name", "row_json"])
    return files.select("path", "content").mapInPandas(run, SQLITE_SCHEMA)


def _docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", errors="replace")
    paras = re.findall(r"<w:p[ >].*?</w:p>", xml, flags=re.S)
    return "\n".join("".join(re.findall(r"<w:t[^>]*>(.*?)</w:t>", p, flags=re.S)) for p in paras)


def _rtf_text(data: bytes) -> str:
    s = data.decode("latin-1")
    s = re.sub(r"\\par[d]?", "\n", s)
    s = re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", s)
    return s.strip()


def _markdown_text(s: str) -> str:
    from lakeloom.operators.text import MARKDOWN_RULES
    for pat, grp in MARKDOWN_RULES:
        s = re.sub(pat, (lambda m, g=grp: m.group(int(g))) if grp else "", s)
    return s


def decode_file(path: str, data: bytes, pdf_extractor: PdfExtractor | None = None) -> tuple[str, str | None, str | None]:
    """``(kind, text, error)`` for one file, chosen by extension."""
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    kind = ROUTES.get(ext, "text")
    try:
        if kind == "pdf":
            pages = (pdf_extractor or default_pdf_extractor)(data)
            return kind, "\n\n".join(p.get("text") or "" for p in pages), None
        if kind == "docx":
            return kind, _docx_text(data), None
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return kind, "\n".join(z.read(n).decode("utf-8", errors="replace") for n in z.namelist()
                                       if n.lower().endswith(ZIP_TEXT_SUFFIXES)), None
        if kind == "json":
            return kind, json.dumps(json.loads(data.decode("utf-8")), indent=2), None
        if kind == "html":
            return kind, html_to_text(data.decode("utf-8", errors="replace"), "", False), None
        if kind == "markdown":
            return kind, _markdown_text(data.decode("utf-8", errors="replace")), None
        if kind == "sqlite":
            return kind, "\n".join(f"{t}: {j}" for t, j in _sqlite_rows(data)), None
        if kind == "rtf":
            return kind, _rtf_text(data), None
        if kind in ("image", "sheet"):
            return kind, None, f"no decoder installed for .{ext} files"
        return kind, data.decode("utf-8", errors="replace"), None
    except Exception as e:  # noqa: BLE001
        return kind, None, f"{type(e).__name__}: {e}"


def read_any(files: DataFrame, pdf_extractor: PdfExtractor | None = None) -> DataFrame:
    """Mixed folder -> ``(path, kind, text, error)``; failures land in ``error``."""
    def run(batches):
        for pdf in batches:
            rows = [(p, *decode_file(p, bytes(c), pdf_extractor)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "error"])
    return files.select("path", "content").mapInPandas(run, TEXT_SCHEMA)
