"""Scalar helpers (F1-F16) as JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default names used when a value is missing.
UNNAMED_WORKFLOW = "Unnamed Workflow"
UNKNOWN_TYPE = "UNKNOWN"
PENDING_STATUS = "pending"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_last_segment(url: str | Column) -> Column:
    """text after the last ``/``, query string kept (``REGEXP_REPLACE(url,'.*/','')``)."""
    return F.regexp_replace(col(url), ".*/", "")


def url_file_name(url: str | Column) -> Column:
    """last path segment with the query string dropped."""
    return F.regexp_replace(url_last_segment(url), "\\?.*", "")


def pct_rate(part: str | Column, total: str | Column) -> Column:
    """``part / total * 100`` with a zero (or NULL) guard returning 0."""
    return F.coalesce(F.try_divide(col(part).cast("double"), col(total).cast("double")) * 100, F.lit(0.0))


def zero_as_null(c: str | Column) -> Column:
    """the reference renders a duration of 0 as NULL (truthiness test)."""
    return F.nullif(col(c), F.lit(0))


def blank_as_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def iso_timestamp(c: str | Column) -> Column:
    """ISO-8601 text, microseconds only when non-zero (like ``datetime.isoformat``)."""
    ts = col(c)
    return F.when(ts.isNull(), F.lit(None).cast("string")).when(
        F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def is_upper_text(c: str | Column) -> Column:
    """Python ``str.isupper``: some cased character and none lower-case."""
    s = col(c)
    return (s == F.upper(s)) & (s != F.lower(s))


def word_count(c: str | Column) -> Column:
    """``len(s.split())`` on ASCII whitespace."""
    s = F.regexp_replace(col(c), "^\\s+|\\s+$", "")
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, "\\s+")))


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "^\\s+|\\s+$", "")


def round6(c: str | Column) -> Column:
    return F.round(col(c).cast("double"), 6)


def calc(a: str | Column, b: str | Column, op: str) -> Column:
    """the four operators; a zero divisor raises under ANSI mode."""
    a, b = col(a), col(b)
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return a / b
    raise ValueError(f"unsupported operator {op!r}")


def json_path(c: str | Column, path: str, default=None) -> Column:
    """a JSON path value with a default when missing or malformed."""
    v = F.get_json_object(col(c), path)
    return v if default is None else F.coalesce(v, F.lit(default))


def json_normalize(c: str | Column) -> Column:
    """parse and re-render JSON text compactly; malformed text becomes NULL."""
    return F.to_json(F.try_parse_json(col(c)))


def date_text(c: str | Column) -> Column:
    """``YYYY-MM-DD``."""
    return F.date_format(col(c), "yyyy-MM-dd")


def truncate_units(c: str | Column) -> Column:
    """prices truncated toward zero to whole units (like an int64 cast)."""
    return col(c).cast("long")


def to_db_value(c: str | Column, data_type=None) -> Column:
    """F8: nested values (struct, array, map) to JSON text, dates to midnight
    timestamps, others unchanged; ``data_type`` is the column's Spark type."""
    from pyspark.sql import types as T
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col(c))
    if isinstance(data_type, T.DateType):
        return col(c).cast("timestamp")
    return col(c)


def now() -> Column:
    """the query's timestamp (outside oracle-checked output)."""
    return F.current_timestamp()


def new_id() -> Column:
    """a random UUID text."""
    return F.expr("uuid()")
