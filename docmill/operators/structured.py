"""Structured computation over tables, and a planner for plain questions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.values import UNITS

FUNCTIONS = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max}
#: Words of columns that hold amounts, and of those that rows are grouped by, in order of preference: fixed values.
AMOUNTS = ("amount", "amt", "contribution", "revenue", "budget", "cost", "spend", "total", "price", "value", "sum")
GROUPS = ("category", "year", "tier", "type", "level", "month", "department", "faculty", "event")


def aggregate(df: DataFrame, group: str, column: str, function: str) -> DataFrame:
    """group and its aggregate, named after the function, largest first."""
    name = function.lower()
    return df.groupBy(group).agg(FUNCTIONS[function.upper()](column).alias(name)).orderBy(F.desc(name), group)


def total_of(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.sum(column).alias("total"))


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a SQL condition over this table's columns holds; ValueError for anything else."""
    if re.search(r";|--|/\*|\b(select|from|over)\b", re.sub(r"'(?:[^']|'')*'", "''", condition), re.IGNORECASE):
        raise ValueError(f"not a condition on columns: {condition}")
    try:
        kind = df.select(F.expr(condition).alias("c")).schema["c"].dataType
        df.filter(F.expr(condition)).schema  # no aggregate can be a filter  # noqa: B018
    except AnalysisException as e:
        raise ValueError(f"not a condition on columns: {condition}") from e
    if not isinstance(kind, T.BooleanType):
        raise ValueError(f"not a condition: {condition}")
    return df.filter(F.expr(condition))


def query_table(spark: SparkSession, df: DataFrame, name: str, sql: str) -> tuple[DataFrame | None, str | None]:
    """(rows, None) of a SQL query over one table under a name, or (None, what is wrong): errors are data."""
    df.createOrReplaceTempView(name)
    try:
        out = spark.sql(sql)
        out.schema  # analysed now, so that what cannot run is told here  # noqa: B018
        return out, None
    except Exception as e:
        return None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


# ---------------------------------------------------------------- registry of tables

REGISTRY = "table_id string, doc_id string, path string, created timestamp, columns array<struct<name: string, kind: string>>, rows long"


PROVENANCE = "table_id string, doc_id string, provenance map<string, string>"


def registered(spark: SparkSession, table_id: str, df: DataFrame, path: str, created, doc_id: str | None = None) -> DataFrame:
    """The registry's row of a table."""
    columns = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return spark.createDataFrame([(table_id, doc_id, path, created, columns, df.count())], REGISTRY)


def stored_table(spark: SparkSession, table_id: str, df: DataFrame, folder: str, created, provenance: dict[str, str], doc_id: str | None = None) -> DataFrame:
    """Writes a table as Parquet, and beside it where it is from; gives its row of the registry. A table of the id is replaced."""
    path = f"{folder.rstrip('/')}/{table_id}"
    df.write.mode("overwrite").parquet(path)
    told = spark.createDataFrame([(table_id, doc_id, provenance)], PROVENANCE)
    told.coalesce(1).write.mode("overwrite").json(f"{path}.provenance")
    return registered(spark, table_id, spark.read.parquet(path), path, created, doc_id)


def provenance_of(spark: SparkSession, path: str) -> dict[str, str]:
    """Where a stored table is from; nothing of a table without such a file."""
    try:
        found = spark.read.schema(PROVENANCE).json(f"{path}.provenance").first()
    except AnalysisException:
        return {}
    return dict(found["provenance"] or {}) if found else {}


def upsert(registry: DataFrame, rows: DataFrame) -> DataFrame:
    return registry.join(rows.select("table_id"), "table_id", "left_anti").unionByName(rows)


def list_tables(registry: DataFrame) -> DataFrame:
    """All tables, the latest first."""
    return registry.orderBy(F.desc("created"), "table_id")


def find_tables(registry: DataFrame, word: str) -> DataFrame:
    """Tables whose id or one of whose columns has the word."""
    low = F.lit(word.lower())
    return registry.filter(F.contains(F.lower("table_id"), low) | F.exists("columns", lambda c: F.contains(F.lower(c["name"]), low)))


def describe(registry: DataFrame, table_id: str) -> DataFrame:
    """name, kind, numeric of a table's columns; no rows for a table that is not there."""
    each = registry.filter(F.col("table_id") == table_id).select(F.explode("columns").alias("c"))
    return each.select("c.name", "c.kind", F.col("c.kind").rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$").alias("numeric"))


def sort_rows(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))


@dataclass(frozen=True)
class Plan:
    intent: str
    amount: str | None = None
    group: str | None = None
    descending: bool = True
    threshold: float | None = None
    inclusive: bool = False
    values: tuple[str, ...] = ()


def plan(df: DataFrame, question: str) -> Plan | None:
    """First rule that fits: sort, total, compare, group, filter."""
    q = question.lower()
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    amounts = [c for c in numeric if any(a in c.lower() for a in AMOUNTS)]
    groups = [c for c in df.columns if c not in numeric]
    amount = next((c for c in amounts + numeric if c.lower() in q), (amounts or numeric or [None])[0])
    if re.search(r"\b(sort|largest|highest|maximum|top|biggest|ranking|descending|lowest|smallest)\b", q) and not re.search(r"\bsum\b", q) and amount:
        return Plan("sort", amount, descending=not re.search(r"\b(lowest|smallest)\b", q))
    if re.search(r"\btotal\b|\bsum of\b|\boverall\b", q) and re.search("sponsorship|amount|revenue|budget", q):
        return Plan("total", amount)
    if (m := re.search(r"\bcompare\s+(.+?)\s+(?:and|with|to|versus|vs\.?)\s+(.+?)\s+by\s+(\w+)", question, re.IGNORECASE)) and amount:
        group = next((c for c in groups if c.lower() == m[3].lower()), None)
        if group:
            return Plan("compare", amount, group, values=(m[1], m[2]))
    if re.search(r"\b(by|per|each|group)\b", q):
        group = next((c for c in groups if re.search(rf"\b{re.escape(c.lower())}\b", q)), None) or next((c for c in GROUPS if c in groups), groups[0] if groups else None)
        if group and amount:
            return Plan("group", amount, group)
    words = "|".join(sorted(UNITS, key=len, reverse=True))
    if (m := re.search(rf"(above|over|greater than|more than|exceeding|at least|>=|>)\s*(?:\D{{0,4}}\s)?(\d[\d,]*(?:\.\d+)?)\s*({words})?\b", q)) and amounts:
        return Plan("filter", amount, threshold=float(m[2].replace(",", "")) * UNITS.get(m[3], 1.0), inclusive="at least" in q)
    return None


def answer(df: DataFrame, question: str) -> DataFrame:
    """Runs the plan of a question; ValueError where no rule fits."""
    p = plan(df, question)
    if p is None:
        raise ValueError(f"no plan for: {question}")
    if p.intent == "sort":
        return sort_rows(df, p.amount, p.descending)
    if p.intent == "total":
        return total_of(df, p.amount)
    if p.intent == "compare":
        wanted = [v.lower() for v in p.values]
        return df.filter(F.lower(p.group).isin(wanted)).groupBy(p.group).agg(F.count("*").alias("rows"), F.sum(p.amount).alias("total"), F.avg(p.amount).alias("mean")).orderBy(p.group)
    if p.intent == "group":
        return df.groupBy(p.group).agg(F.sum(p.amount).alias("total")).orderBy(F.desc("total"))
    return df.filter(F.col(p.amount) >= p.threshold if p.inclusive else F.col(p.amount) > p.threshold)
