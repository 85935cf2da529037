"""Four named ways to say that two results match, and summaries of evaluation runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .gateway import analysed, error_class
from .rewrite import star_expanded


def _positional(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def _same_set(a: DataFrame, b: DataFrame) -> bool:
    if len(a.columns) != len(b.columns):
        return a.isEmpty() and b.isEmpty()
    a, b = _positional(a).distinct(), _positional(b).distinct()
    try:
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    except Exception:  # kinds that have no common type: equal only if there is nothing
        return a.isEmpty() and b.isEmpty()


def match_set_or_subset(golden: DataFrame, made: DataFrame) -> bool:
    """Equal as sets of rows by position; or as many rows (some), and equal in the golden columns, found by name."""
    if _same_set(golden, made):
        return True
    names = {c.lower(): c for c in made.columns}
    if not all(c.lower() in names for c in golden.columns):
        return False
    n = golden.count()
    return n > 0 and n == made.count() and _same_set(golden, made.select(*(F.col(f"`{names[c.lower()]}`") for c in golden.columns)))


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Whole and floating numbers rounded as doubles; decimals and all else as they are."""
    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)
    return df.select(*(F.round(F.col(f"`{f.name}`").cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`").cast("double"), digits).alias(f.name) if isinstance(f.dataType, plain) else F.col(f"`{f.name}`") for f in df.schema.fields))


def match_rounded_set(golden: DataFrame, made: DataFrame) -> bool:
    return _same_set(rounded(golden), rounded(made))


def normal_values(df: DataFrame) -> DataFrame:
    """Numbers and booleans as doubles rounded to six places, dates as ISO text, all else as it is."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("double")
        elif isinstance(f.dataType, T.NumericType):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def numbered(df: DataFrame) -> DataFrame:
    """df with `at`: the place of each row. It is written once, for the order that a plan gives may differ the next time."""
    rows = cut(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), part == F.col("_p")).withColumn("at", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_before")


def match_bag_or_ordered(golden: DataFrame, made: DataFrame, golden_sql: str = "", made_sql: str = "") -> bool:
    """Equal as bags; as sequences if either text orders its rows. 1 equals 1.0, but not '1': columns of unlike kinds differ unless both are empty."""
    a, b = _positional(normal_values(golden)), _positional(normal_values(made))
    if [f.dataType for f in a.schema.fields] != [f.dataType for f in b.schema.fields]:
        kinds = [(x.dataType, y.dataType) for x, y in zip(a.schema.fields, b.schema.fields)]
        if len(a.columns) != len(b.columns) or any(x != y and T.NullType() not in (x, y) for x, y in kinds):
            return a.isEmpty() and b.isEmpty()
    if re.search(r"\border\s+by\b", f"{golden_sql} {made_sql}", re.I):
        a, b = numbered(a), numbered(b)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def empty_class(df: DataFrame) -> str:
    """empty: no rows, or nothing but nulls; else rows."""
    some = F.greatest(F.lit(False), *(F.col(f"`{c}`").isNotNull() for c in df.columns)) if df.columns else F.lit(False)
    return "rows" if not df.where(some).isEmpty() else "empty"


def rollup(results: DataFrame, by: list[str]) -> DataFrame:
    """Rates of a table of results (valid, executed, matched, exact, repaired: booleans; latency_ms) by condition."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), rate("valid").alias("valid_rate"), rate("executed").alias("execution_rate"), rate("matched").alias("accuracy"),
        F.round(F.avg(F.when(F.col("valid"), F.col("matched").cast("double"))), 6).alias("accuracy_valid"), rate("exact").alias("exact_rate"), F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"), F.count_if("repaired").alias("repairs"))


def outcome(spark: SparkSession, sql: str) -> tuple[str, str, DataFrame | None]:
    """(class, message of 100 characters at most, result): rows, empty, or the error's class."""
    try:
        df = spark.sql(sql.strip().rstrip(";"))
        return empty_class(df), "", df
    except Exception as e:  # the class of whatever was raised is the outcome
        return error_class(e), str(e)[:100], None


def validation_report(spark: SparkSession, queries: list[tuple[str, str]], top: int = 5) -> tuple[DataFrame, DataFrame]:
    """((id, sql, outcome, message) of each query, (outcome, n, percent, examples) by outcome with the first `top` ids).

    The queries are a list of statements to run one after the other, as a driver does."""
    rows = [(str(key), sql, *outcome(spark, sql)[:2]) for key, sql in queries]
    each = spark.createDataFrame(rows, "id string, sql string, outcome string, message string")
    n = max(1, len(rows))
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, top)
    return each, each.groupBy("outcome").agg(F.count("*").alias("n"), F.round(100 * F.count("*") / F.lit(n), 1).alias("percent"), ids.alias("examples"))


def revalidated(spark: SparkSession, truth: list[tuple[str, str]], columns: dict[str, list[str]]) -> DataFrame:
    """(id, sql, changed, status): stars expanded; a statement that no longer binds goes back to what it was if that did. status: OK or ERROR."""
    rows = []
    for key, sql in truth:
        new = star_expanded(sql, columns)
        error = analysed(spark, new)
        back = error is not None and new != sql and analysed(spark, sql) is None
        rows.append((str(key), sql if back else new, new != sql and not back, "OK" if error is None or back else "ERROR"))
    return spark.createDataFrame(rows, "id string, sql string, changed boolean, status string")
