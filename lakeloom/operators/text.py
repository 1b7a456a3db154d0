"""Document and text operators.

Line handling, markdown formatting and markdown stripping run JVM-side with
``split`` / ``transform`` / ``regexp_replace``.  HTML needs a real tokenizer,
so it is an Arrow-batched pandas UDF around the stdlib parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.scalar import is_upper_text
from lakeloom.functions.text import html_to_text, line_break_pattern, whitespace_chars, ws_class
from lakeloom.llm.common import give_back
from lakeloom.session import small_batches

DEFAULT_SYSTEM_PROMPT = "You are a data assistant. Answer questions about the extracted tables."
PAGE_BREAK = "\n---\n"


#: Rows and bytes of pages that a parser is handed at once: a batch is held several times over, in every Python worker.
PAGE_ROWS, PAGE_BYTES = 200, 1 << 22


def _texts(batches: Iterator[pd.Series], separator: str, strip: bool) -> Iterator[pd.Series]:
    for html in batches:
        yield html.map(lambda h: html_to_text(h, separator, strip))
    give_back()


@F.pandas_udf(T.StringType())
def html_text_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stripped text nodes joined by newlines."""
    return _texts(batches, "\n", True)


@F.pandas_udf(T.StringType())
def html_raw_text_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Raw concatenation of text nodes."""
    return _texts(batches, "", False)


def page_text(pages: DataFrame, raw: bool = False) -> DataFrame:
    small_batches(pages.sparkSession, PAGE_ROWS, PAGE_BYTES)
    fn = html_raw_text_udf if raw else html_text_udf
    t = pages.select("page_id", "url", fn(F.col("html")).alias("text"))
    return t.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"),
                    F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def _lines(text: Column) -> Column:
    """``str.splitlines`` then ``str.strip`` per line, blanks dropped."""
    parts = F.split(text, line_break_pattern("java"))
    stripped = F.transform(parts, lambda l: F.trim(l, F.lit(whitespace_chars())))
    return F.filter(stripped, lambda l: l != "")


def _word_count(line: Column) -> Column:
    return F.size(F.split(line, ws_class("java") + "+"))


def text_to_markdown(text: Column) -> Column:
    """Blank lines dropped; short all-caps lines become ``## `` headings; lines
    ending in ``:`` become bold; a ``---`` page break closes the page; blocks are
    separated by a blank line and the result is stripped."""
    lines = _lines(text)
    md = F.transform(lines, lambda l: F.when(is_upper_text(l) & (_word_count(l) < 10), F.concat(F.lit("## "), l))
                     .when(l.endswith(":"), F.concat(F.lit("**"), l, F.lit("**"))).otherwise(l))
    return F.when(text.isNull(), F.lit(None).cast("string")).when(
        F.size(md) > 0, F.concat(F.array_join(md, "\n\n"), F.lit("\n\n" + PAGE_BREAK.rstrip()))
    ).otherwise(F.lit(PAGE_BREAK.strip()))


# Fixed rewrite rules for markdown -> plain text (documented subset of the
# syntax), as (pattern, replacement group or "").
MARKDOWN_RULES = [
    ("(?m)^[ \\t]*#{1,6}[ \\t]*", ""),               # ATX headings
    ("(?m)^[ \\t]*-{3,}[ \\t]*$", ""),               # horizontal rules
    ("!\\[([^\\]]*)\\]\\([^)]*\\)", "1"),             # images -> alt text
    ("\\[([^\\]]*)\\]\\([^)]*\\)", "1"),              # links -> text
    ("\\*\\*(.+?)\\*\\*", "1"),                       # bold
    ("__(.+?)__", "1"),
    ("`([^`]*)`", "1"),                               # inline code
    ("(?m)^[ \\t]*>[ \\t]?", ""),                     # block quotes
    ("(?m)^[ \\t]*[-*+][ \\t]+", ""),                 # bullets
]


def markdown_to_text(md: Column) -> Column:
    """Strip the markdown syntax subset above, JVM-side."""
    out = md
    for pat, grp in MARKDOWN_RULES:
        out = F.regexp_replace(out, pat, f"${grp}" if grp else "")
    return out


def markdown_rules_sql(col: str) -> str:
    """The same rules as nested DuckDB ``regexp_replace`` calls (oracle text)."""
    out = col
    for pat, grp in MARKDOWN_RULES:
        rep = f"\\{grp}" if grp else ""
        out = f"regexp_replace({out}, '{pat}', '{rep}', 'g')"
    return out


def assemble_pages(pages: DataFrame, doc: str, page: str, text: str, sep: str = "\n\n") -> DataFrame:
    """One document's pages joined in page order.  A document is the unit
    of output, so its pages meet in one task by definition."""
    return (pages.groupBy(doc)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))).alias("_ps"))
            .select(doc, F.array_join(F.transform("_ps", lambda x: x["t"]), sep).alias("full_text"),
                    F.size("_ps").cast("long").alias("pages")))


def conversation_messages(conv: DataFrame, system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """A system message first, then the turns in order, as rows
    ``(conv_id, pos, role, content)``; ``pos`` 0 is the system message."""
    system = (conv.select("conv_id").distinct()
              .select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"),
                      F.lit(system_prompt).alias("content")))
    turns = conv.select("conv_id", (F.col("turn") + 1).cast("long").alias("pos"), "role",
                        F.col("text").alias("content"))
    return system.unionByName(turns)


def conversation_payload(conv: DataFrame, system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """X8 assembled: ``[{role, content}]`` per conversation, system message first."""
    msgs = conversation_messages(conv, system_prompt)
    return (msgs.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("_m"))
            .select("conv_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                    m["content"].alias("content")))
                    .alias("messages")))


def tables_to_rows(tables: DataFrame, id_cols: list[str], data_col: str = "data") -> DataFrame:
    """An extracted table (array of rows of cells) becomes relational rows:
    the first row is the header, blank header cells become ``Column_i``,
    short rows are padded with NULL; output is one row per data row with a
    ``map<header, cell>``."""
    hdr = F.transform(F.try_element_at(F.col(data_col), F.lit(1)),
                      lambda h, i: F.when(F.coalesce(F.trim(h), F.lit("")) == "", F.concat(F.lit("Column_"),
                                                                                          (i + 1).cast("string")))
                      .otherwise(h))
    body = F.slice(F.col(data_col), 2, F.greatest(F.size(F.col(data_col)) - 1, F.lit(0)))
    x = tables.select(*id_cols, hdr.alias("_h"), F.posexplode(body).alias("row_index", "_r"))
    padded = F.transform("_h", lambda h, i: F.try_element_at(F.col("_r"), (i + 1).cast("int")))
    return x.select(*id_cols, (F.col("row_index") + 1).alias("row_index"),
                    F.map_from_arrays(F.col("_h"), padded).alias("record"))
