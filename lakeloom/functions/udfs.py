"""User functions (D1-D4): scalar, aggregate and table functions registered for
SQL, and the typed tool contract.  Vectorized (Arrow) forms are the default."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


def register_scalar(spark: SparkSession, name: str, fn: Callable[[pd.Series], pd.Series], return_type: str):
    """A vectorized scalar function callable from SQL and the DataFrame API.
    Registering again under the same name updates it."""
    f = F.pandas_udf(fn, return_type)
    return spark.udf.register(name, f)


def register_aggregate(spark: SparkSession, name: str, fn: Callable[[pd.Series], Any], return_type: str):
    """A grouped-aggregate pandas UDF (Series -> scalar); note that these do
    not combine map-side, so each group's values meet in one task."""
    def agg(s: pd.Series) -> float:   # Series -> scalar hint makes it a grouped aggregate
        return fn(s)
    f = F.pandas_udf(agg, return_type)
    return spark.udf.register(name, f)


@udtf(returnType=T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())]))
class DocLines:
    """D3: one document -> many rows (its non-blank lines, numbered from 1)."""

    def eval(self, text: str):
        if text is None:
            return
        n = 0
        for line in text.splitlines():
            if line.strip():
                n += 1
                yield n, line.strip()


def register_table_function(spark: SparkSession, name: str = "doc_lines", fn=DocLines):
    """D3: usable as ``SELECT * FROM t, LATERAL doc_lines(t.text)``."""
    spark.udtf.register(name, fn)
    return fn


def list_functions(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Registered functions (temporary ones included)."""
    rows = [(f.name, f.className, f.isTemporary) for f in spark.catalog.listFunctions(pattern=pattern)]
    return spark.createDataFrame(rows, "name string, class_name string, is_temporary boolean")


def describe_function(spark: SparkSession, name: str) -> str:
    return "\n".join(r[0] for r in spark.sql(f"DESCRIBE FUNCTION {name}").collect())


@dataclasses.dataclass
class Tool:
    """Typed user parameters + typed call parameters -> DataFrame result."""
    name: str
    run: Callable[..., DataFrame]
    user_params: type | None = None
    call_params: type | None = None

    def __call__(self, spark: SparkSession, user: Any = None, call: Any = None) -> DataFrame:
        if self.user_params is not None and user is not None and not isinstance(user, self.user_params):
            user = self.user_params(**user)
        if self.call_params is not None and call is not None and not isinstance(call, self.call_params):
            call = self.call_params(**call)
        return self.run(spark, user, call)
