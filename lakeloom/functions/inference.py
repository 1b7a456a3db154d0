"""Order-dependent row-type inference (M1) and first-row column projection (M3)
over JSON records, on Spark's VARIANT type.

Rules: booleans are not integers; the first value of a column fixes its
type (a NULL first value fixes TEXT); any later non-null value of another type
turns the column to TEXT; a later NULL never changes it.  So ``[null, 1]`` is
TEXT, ``[1, null]`` INTEGER, ``[1, 1.5]`` TEXT, ``[true, 1]`` TEXT.  The
result depends on row order, so records carry an explicit order column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The SQL type names of the inferred columns.
TEXT, INTEGER, DOUBLE, BOOLEAN, TIMESTAMP, JSONB = ("TEXT", "INTEGER", "DOUBLE PRECISION", "BOOLEAN",
                                                    "TIMESTAMP", "JSONB")
SPARK_TYPES = {TEXT: T.StringType(), INTEGER: T.LongType(), DOUBLE: T.DoubleType(), BOOLEAN: T.BooleanType(),
               TIMESTAMP: T.TimestampType(), JSONB: T.StringType()}


def _sql_type(variant_type: str) -> str:
    """Map a ``schema_of_variant`` name to the inferred SQL type (NULL for JSON null)."""
    return (f"CASE WHEN {variant_type} = 'VOID' THEN NULL "
            f"WHEN {variant_type} = 'BOOLEAN' THEN '{BOOLEAN}' "
            f"WHEN {variant_type} IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') THEN '{INTEGER}' "
            f"WHEN {variant_type} LIKE 'DECIMAL%' OR {variant_type} IN ('DOUBLE', 'FLOAT') THEN '{DOUBLE}' "
            f"WHEN {variant_type} LIKE 'OBJECT%' OR {variant_type} LIKE 'ARRAY%' THEN '{JSONB}' "
            f"WHEN {variant_type} LIKE 'TIMESTAMP%' OR {variant_type} = 'DATE' THEN '{TIMESTAMP}' "
            f"ELSE '{TEXT}' END")


def cells(records: DataFrame, order_col: str = "row_idx", json_col: str = "record") -> DataFrame:
    """One row per (record, key): ``(row_idx, key, ordinal, value variant, sql_type)``."""
    v = records.select(F.col(order_col).alias("row_idx"), F.parse_json(json_col).alias("v"),
                       F.json_object_keys(json_col).alias("keys"))
    obj = F.try_variant_get("v", "$", "map<string,variant>")
    e = v.select("row_idx", "keys", F.explode(obj).alias("key", "value"))
    return e.select("row_idx", "key", (F.array_position("keys", F.col("key")) - 1).alias("ordinal"), "value",
                    F.expr(_sql_type("schema_of_variant(value)")).alias("sql_type"))


def infer_schema(records: DataFrame, order_col: str = "row_idx", json_col: str = "record") -> DataFrame:
    """M1: ``(column_name, sql_type, position)`` in first-appearance order.

    One aggregation per column name (partial aggregation map-side): the type at
    the smallest ``(row_idx, ordinal)``, and the set of non-null types seen.
    """
    c = cells(records, order_col, json_col)
    first_at = F.struct("row_idx", "ordinal")
    g = c.groupBy(F.col("key").alias("column_name")).agg(
        F.min_by("sql_type", first_at).alias("first_type"),
        F.min(first_at).alias("first_at"),
        F.collect_set("sql_type").alias("types"))
    typ = (F.when(F.col("first_type").isNull(), F.lit(TEXT))
           .when(F.size(F.array_remove("types", F.col("first_type"))) > 0, F.lit(TEXT))
           .otherwise(F.col("first_type")))
    return g.select("column_name", typ.alias("sql_type"), "first_at").orderBy("first_at").drop("first_at")


def to_struct(schema_rows: list) -> T.StructType:
    return T.StructType([T.StructField(r["column_name"], SPARK_TYPES[r["sql_type"]]) for r in schema_rows])


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def typed_records(records: DataFrame, schema_rows: list, columns: list[str], order_col: str = "row_idx",
                  json_col: str = "record") -> DataFrame:
    """M3: project every record onto ``columns`` (the first record's keys):
    extra keys are dropped, missing ones are NULL, nested values become JSON
    text, values of a TEXT column are rendered as text."""
    types = {r["column_name"]: r["sql_type"] for r in schema_rows}
    v = F.parse_json(json_col)
    out = [F.col(order_col)]
    for c in columns:
        t = types.get(c, TEXT)
        raw = F.try_variant_get(v, _path(c), "variant")
        if t == JSONB:
            e = F.when(F.is_variant_null(raw) | raw.isNull(), F.lit(None)).otherwise(F.to_json(raw))
        elif t == TEXT:
            e = F.when(F.is_variant_null(raw) | raw.isNull(), F.lit(None)).otherwise(raw.cast("string"))
        else:
            e = F.try_variant_get(v, _path(c), SPARK_TYPES[t].simpleString())
        out.append(e.cast(SPARK_TYPES[t]).alias(c))
    return records.select(*out)


def first_record_columns(records: DataFrame, order_col: str = "row_idx", json_col: str = "record") -> list[str]:
    """M3: the keys of the first record (one row brought to the driver)."""
    first = records.orderBy(order_col).select(F.json_object_keys(json_col).alias("k")).first()
    return list(first["k"]) if first and first["k"] else []
