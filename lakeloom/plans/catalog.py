"""SQL and catalog surface (C1-C8, C10): guarded SQL, JSON rows, table listings,
describe, analyze-without-running, datasets and source validation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The read-only guard's allowed first words and refusal text.
READONLY_PREFIXES = ("select", "show", "describe", "with")
READONLY_REFUSAL = "Only read-only queries are allowed."
# Connector types accepted for virtual topic tables.
ALLOWED_CONNECTORS = ("local-kafka",)
KNOWN_FORMATS = ("json", "csv", "avro", "parquet", "orc", "text", "xml")

# Root nodes of a parsed statement that write or change state.
_WRITE_NODES = {"InsertIntoStatement", "InsertIntoDir", "MergeIntoTable", "DeleteFromTable", "UpdateTable",
                "AppendData", "OverwriteByExpression", "OverwritePartitionsDynamic", "CreateTableAsSelect",
                "ReplaceTableAsSelect", "CreateTable", "ReplaceTable", "CreateView", "DropTable", "DropView",
                "TruncateTable"}


class SqlRefused(ValueError):
    pass


def first_word(sql: str) -> str:
    parts = sql.strip().lower().split()
    if not parts:
        raise ValueError("empty SQL text")
    return parts[0]


def readonly_sql(spark: SparkSession, sql: str, check_plan: bool = True) -> DataFrame:
    """The reference's first-word guard, plus a parsed-plan check so that
    ``WITH … INSERT`` (which passes the word guard) is refused too."""
    if first_word(sql) not in READONLY_PREFIXES:
        raise SqlRefused(READONLY_REFUSAL)
    if check_plan and first_word(sql) in ("with", "select") and _writes(spark, sql):
        raise SqlRefused(READONLY_REFUSAL)
    return spark.sql(sql)


def _writes(spark: SparkSession, sql: str) -> bool:
    """Whether the parsed statement (CTE wrappers removed) is a write or a command."""
    jvm = spark._jvm
    node = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    while node.nodeName() in ("UnresolvedWith", "WithCTE"):
        node = node.child()
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    return node.getClass().getSimpleName() in _WRITE_NODES or command.isInstance(node)


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON array of strings (non-JSON values stringified)."""
    return df.select(F.to_json(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("row"))


def run_sql(spark: SparkSession, sql: str, database: str | None = None) -> DataFrame:
    """Optional ``USE <db>``, one trailing ``;`` dropped."""
    if database:
        spark.catalog.setCurrentDatabase(database)
    text = sql.strip()
    if text.endswith(";"):
        text = text[:-1]
    return spark.sql(text)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """C4: tables of a database (temp views included)."""
    rows = [(t.name, t.database, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, database string, table_type string, is_temporary boolean")


def table_tree(spark: SparkSession) -> DataFrame:
    """C4: catalog -> database -> table, for the session catalog's databases."""
    current = spark.catalog.currentCatalog()
    rows = []
    for db in spark.catalog.listDatabases():
        for t in spark.catalog.listTables(db.name):
            if not t.isTemporary:
                rows.append((current, db.name, t.name))
    return spark.createDataFrame(rows, "catalog string, database string, table string")


def describe(df: DataFrame) -> DataFrame:
    """``(column_name, column_type, null)``."""
    rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, null string")


def analyze_sql(spark: SparkSession, sql: str) -> dict:
    """Parse and analyse without running anything (commands are not
    executed: only their analysed plan is returned); errors come back as data."""
    try:
        state = spark._jsparkSession.sessionState()
        parsed = state.sqlParser().parsePlan(sql)
        modes = getattr(getattr(spark._jvm.org.apache.spark.sql.execution, "CommandExecutionMode$"), "MODULE$")
        qe = state.executePlan(parsed, modes.SKIP())      # SKIP: commands are never run
        analyzed = qe.analyzed()
        command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
        if command.isInstance(analyzed) or analyzed.getClass().getSimpleName() in _WRITE_NODES:
            return {"valid": True, "command": True, "plan": analyzed.treeString()}
        names = [a.name() for a in _seq(analyzed.output())]
        return {"valid": True, "command": False, "columns": names,
                "plan": spark._jvm.PythonSQLUtils.explainString(qe, "formatted")}
    except Exception as e:  # noqa: BLE001 - parse and analysis errors are the answer
        from py4j.protocol import Py4JJavaError
        from pyspark.errors.exceptions.captured import convert_exception
        err = convert_exception(e.java_exception) if isinstance(e, Py4JJavaError) else e
        text = str(err)
        kind = type(err).__name__
        if "PARSE_SYNTAX_ERROR" in text:
            kind = "ParseException"
        return {"valid": False, "error_type": kind, "error_message": text.strip().split("\n")[0][:500]}


def _seq(jseq) -> list:
    return [jseq.apply(i) for i in range(jseq.size())]


def dataset(spark: SparkSession, table_name: str, ds_name: str) -> tuple[DataFrame, list[str]]:
    """A named dataset over a table (``SELECT *``) and its column list."""
    df = spark.table(table_name)
    df.createOrReplaceTempView(ds_name)
    return df, df.columns


@dataclass
class SourceCheck:
    valid: bool
    errors: list[str] = field(default_factory=list)


def validate_source(spark: SparkSession, config: dict) -> SourceCheck:
    """Connector type allowed, format known, and (for file sources) the path
    readable, checked with a zero-row read."""
    errors = []
    ctype = config.get("type") or config.get("connector")
    if ctype and ctype not in ALLOWED_CONNECTORS and ctype not in KNOWN_FORMATS:
        errors.append(f"connector '{ctype}' is not allowed; allowed: {list(ALLOWED_CONNECTORS)}")
    fmt = (config.get("format") or "json").lower()
    if fmt not in KNOWN_FORMATS:
        errors.append(f"unknown format '{fmt}'")
    path = config.get("path")
    if path and not errors:
        try:
            spark.read.format(fmt).load(path).limit(0).collect()
        except Exception as e:  # noqa: BLE001
            errors.append(f"cannot read {path}: {type(e).__name__}")
    return SourceCheck(not errors, errors)


def error_row(spark: SparkSession, exc: Exception) -> DataFrame:
    """An exception as a structured one-row result at the job edge."""
    return spark.createDataFrame([(True, type(exc).__name__, str(exc), f"Operation failed: {exc}")],
                                 "error boolean, error_type string, error_message string, message string")
