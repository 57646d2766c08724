"""Checks of extracted rows before anything is written: one aggregate for all but uniqueness, one for that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence.functions.text import strip
from evidence.rules.spec import Check

FINDINGS = "rule string, column_name string, severity string, failed_rows long, total_rows long, passed boolean, message string"
#: Examples in a message.
REPEATED, OUTSIDE = 3, 5


def is_empty(rows: DataFrame, name: str) -> Column:
    """Null, blank text, or a list without a non-null element."""
    kind = rows.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.ArrayType):
        return c.isNull() | ~F.exists(c, lambda x: x.isNotNull())
    return c.isNull() | (strip(c) == "") if isinstance(kind, T.StringType) else c.isNull()


def not_null(rows: DataFrame, name: str) -> Column:
    return F.count_if(is_empty(rows, name))


def outside(rows: DataFrame, name: str, values) -> Column:
    return ~is_empty(rows, name) & ~F.col(name).cast("string").isin(*values)


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, count of the values of several columns that aren't empty: one scan and one shuffle for all."""
    own = F.array(*(F.struct(F.lit(c).alias("column"), F.when(~is_empty(rows, c), F.col(c).cast("string")).alias("value")) for c in columns))
    return rows.select(F.explode(own).alias("x")).where("x.value is not null").groupBy("x.column", "x.value").count()


def repeated(rows: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, list[str]]]:
    """For each column with values that occur more than once: their rows, how many they are, and the least few of them."""
    twice = value_counts(rows, columns).where("count > 1")
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    few = twice.withColumn("n", place).where(F.col("n") <= REPEATED).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    found = twice.groupBy("column").agg(F.sum("count").alias("failed"), F.count("*").alias("values")).join(few, "column")
    return {r["column"]: (r["failed"], r["values"], r["examples"]) for r in found.collect()}


def strays(rows: DataFrame, name: str, values) -> tuple[int, list[str]]:
    """How many distinct values aren't allowed, and the least few of them."""
    found = rows.where(outside(rows, name, values)).select(F.col(name).cast("string").alias("value")).distinct()
    return found.count(), [r[0] for r in found.orderBy("value").limit(OUTSIDE).collect()]


def _message(check: Check, failed: int, total: int, more) -> str:
    if check.rule == "min_rows":
        return f"{total} rows where at least {check.min} are wanted"
    if check.rule == "unique":
        return f"{check.column}: {more[0]} values in more than one row, such as {', '.join(more[1])}"
    if check.rule == "allowed_values":
        return f"{check.column}: {more[0]} values that aren't allowed, such as {', '.join(more[1])}"
    limit = f", where {check.max:.0%} may be" if check.rule == "max_null_fraction" else ""
    return f"{check.column}: {failed} of {total} rows are empty{limit}"


def run_checks(rows: DataFrame, checks: tuple[Check, ...], mode: str = "full") -> DataFrame:
    """A row for each check that applies; min_rows applies to full loads only. message says what failed, with examples."""
    todo = [c for c in checks if mode == "full" or c.rule != "min_rows"]
    aggregates = [F.count("*").alias("total")]
    for i, c in enumerate(todo):
        if c.rule in ("not_null", "max_null_fraction"):
            aggregates.append(not_null(rows, c.column).alias(f"f{i}"))
        elif c.rule == "allowed_values":
            aggregates.append(F.count_if(outside(rows, c.column, c.values)).alias(f"f{i}"))
    got = rows.agg(*aggregates).first()
    unique = sorted({c.column for c in todo if c.rule == "unique"})
    twice = repeated(rows, unique) if unique else {}
    total, out = got["total"], []
    for i, c in enumerate(todo):
        more = None
        if c.rule == "min_rows":
            failed, passed = max(0, c.min - total), total >= c.min
        elif c.rule == "unique":
            failed, *more = twice.get(c.column, (0, 0, []))
            passed = failed == 0
        else:
            failed = got[f"f{i}"]
            passed = failed <= c.max * total if c.rule == "max_null_fraction" else failed == 0
            if c.rule == "allowed_values" and not passed:
                more = strays(rows, c.column, c.values)
        out.append((c.rule, c.column, c.severity, int(failed), total, bool(passed), None if passed else _message(c, failed, total, more)))
    return rows.sparkSession.createDataFrame(out, FINDINGS)


def blocks(findings: DataFrame) -> bool:
    """Whether a batch must stop: some check of severity error failed."""
    return bool(findings.where("severity = 'error' and not passed").take(1))
