"""Parameterised file query: describe, select list, up to three AND-ed filters,
group by, order, limit and offset (P1-P5, A10, A11, A18, O1, C5).

Filter values become typed literals and columns become Column expressions;
no value is ever spliced into SQL text.  The select list and group-by list
are SQL expressions by contract (the caller passes ``COUNT(*)``), so that
part is read by Spark's SQL parser over a temp view of the already-filtered
frame.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The seven operation names of the reference's filter parameters.
OPERATIONS = ("equal_to", "contains", "less_than", "greater_than", "less_than_or_equal",
              "greater_than_or_equal", "not_equal_to")

AGG_FUNCTIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


@dataclass
class Filter:
    column: str
    operation: str
    value: Any


@dataclass
class FileQuery:
    column_names: str | None = "*"
    filters: list[Filter] = field(default_factory=list)
    group_by: str | None = None
    order_by: str | None = None
    order_direction: str | None = None
    limit: int | None = None
    offset: int | None = None
    describe: bool = False
    faithful_contains: bool = False   # P3: raw LIKE without added wildcards


def typed_literal(value: Any) -> Column:
    """The value is numeric when ``float(value)`` parses, else a string."""
    if isinstance(value, bool):
        return F.lit(value)
    try:
        f = float(value)
    except (TypeError, ValueError):
        return F.lit(str(value))
    if not math.isfinite(f):
        return F.lit(str(value))
    text = str(value).strip()
    try:
        return F.lit(int(text))
    except ValueError:
        return F.lit(f)


def predicate(flt: Filter, faithful_contains: bool = False) -> Column:
    """One filter as a Column predicate."""
    if flt.operation not in OPERATIONS:
        raise ValueError(f"unknown operation {flt.operation!r}; expected one of {OPERATIONS}")
    if flt.value is None or flt.column is None:
        raise ValueError("filter column and value are required")
    c = F.col(flt.column)
    v = typed_literal(flt.value)
    op = flt.operation
    if op == "contains":
        if faithful_contains:
            return c.like(str(flt.value))
        return c.cast("string").contains(F.lit(str(flt.value)))
    return {
        "equal_to": lambda: c == v, "less_than": lambda: c < v, "greater_than": lambda: c > v,
        "less_than_or_equal": lambda: c <= v, "greater_than_or_equal": lambda: c >= v,
        "not_equal_to": lambda: c != v,
    }[op]()


def describe(df: DataFrame) -> DataFrame:
    """``(column_name, column_type, null)`` from the schema (no data scan)."""
    rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, null string")


def run_file_query(df: DataFrame, q: FileQuery) -> DataFrame:
    """P1-P5, A10, O1 over one file-backed DataFrame."""
    if q.describe:
        return describe(df)
    conds = [predicate(f, q.faithful_contains) for f in q.filters if f.operation]
    if conds:
        df = df.filter(reduce(lambda a, b: a & b, conds))   # P5: intended conjunction
    cols = q.column_names if q.column_names and q.column_names.strip() else "*"
    # the select and group-by lists are SQL by contract: Spark's parser reads them
    # over a view of the already-filtered frame (no value is spliced into text)
    name = f"_fq_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    group = f" GROUP BY {q.group_by}" if q.group_by else ""
    out = df.sparkSession.sql(f"SELECT {cols} FROM {name}{group}")
    if q.order_by:
        direction = (q.order_direction or "ASC").strip().upper()
        if direction not in ("ASC", "DESC"):
            raise ValueError(f"order_direction must be ASC or DESC, got {q.order_direction!r}")
        o = F.expr(q.order_by)
        # DuckDB (the engine the reference used here) puts NULLs last both ways
        out = out.orderBy(o.asc_nulls_last() if direction == "ASC" else o.desc_nulls_last())
    if q.offset:
        out = out.offset(int(q.offset))
    if q.limit:
        out = out.limit(int(q.limit))
    return out


def chart_aggregate(df: DataFrame, columns: list[dict]) -> DataFrame:
    """``[{column_name, aggregate_function?}]``; plain columns are group keys,
    output names ``fn_column``; no function at all is a plain projection."""
    if not columns:
        raise ValueError("`columns` cannot be empty")
    keys, aggs = [], []
    for spec in columns:
        name = spec["column_name"]
        fn = spec.get("aggregate_function")
        if fn is None:
            keys.append(name)
        elif fn not in AGG_FUNCTIONS:
            raise ValueError(f"Invalid column configuration: unknown aggregate {fn!r}")
        else:
            aggs.append(AGG_FUNCTIONS[fn](F.col(name)).alias(f"{fn}_{name}"))
    if not aggs:
        return df.select(*keys)
    return df.groupBy(*keys).agg(*aggs)


def pivot_counts(df: DataFrame, row_key: Column, pivot_col: str, values: list[str]) -> DataFrame:
    """Counts per ``row_key`` with one column per pivot value (0 when absent).

    Explicit values avoid the extra distinct-values job a bare ``pivot`` runs.
    """
    out = df.groupBy(row_key).pivot(pivot_col, values).agg(F.count(F.lit(1)))
    return out.fillna(0, subset=values)
