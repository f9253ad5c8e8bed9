"""Checks and summaries of raw bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.operators.features import missing_cells

REQUIRED = ("datetime", "open", "high", "low", "close")
PRICES = ("open", "high", "low", "close")


def quality_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, first and last time, missing cells over all columns, repeated timestamps."""
    repeated = "count(1) - count(DISTINCT datetime) - coalesce(max(CAST(datetime IS NULL AS BIGINT)), 0L)"
    return df.groupBy(*by).agg(
        F.expr("count(1) AS rows"),
        F.expr("min(datetime) AS date_start"),
        F.expr("max(datetime) AS date_end"),
        F.expr(f"{missing_cells(df, df.columns)} AS missing_values"),
        F.expr(f"{repeated} AS duplicate_timestamps"),
    )


def validation_report(df: DataFrame) -> DataFrame:
    """Number of violations of each rule a bar table must obey, in one pass."""
    rules = ["struct('zero rows' AS rule, CAST(count(1) = 0 AS BIGINT) AS violations)"]
    for name in REQUIRED:
        count = f"count_if({name} IS NULL)" if name in df.columns else "count(1)"
        rules.append(f"struct('{name}' AS rule, {count} AS violations)")
    return df.agg(F.expr(f"array({', '.join(rules)})").alias("_rules")).selectExpr("inline(_rules)")


def violations(columns: Sequence[str]) -> dict[str, str]:
    """Aggregates of the rules as SQL text by name, for one pass with others."""
    return {f"bad_{name}": f"count_if({name} IS NULL)" if name in columns else "count(1)" for name in REQUIRED}


def refuse_columns(columns: Sequence[str], required: Sequence[str] = REQUIRED) -> None:
    absent = [name for name in required if name not in columns]
    if absent:
        raise ValueError(f"Missing required columns: {absent}")


def refuse(rows: int, bad: Mapping[str, int]) -> None:
    """ValueError for the first rule that is violated; `bad` has the violations by column."""
    if not rows:
        raise ValueError("The bar table is empty")
    if bad["datetime"]:
        raise ValueError("Some rows have no readable datetime")
    for name in PRICES:
        if bad[name]:
            raise ValueError(f"Some rows have no number in column {name}")


def check_bars(df: DataFrame, required: Sequence[str] = REQUIRED) -> None:
    """Raise ValueError if the table is not a usable bar table."""
    refuse_columns(df.columns, required)
    found = {row["rule"]: row["violations"] for row in validation_report(df).collect()}
    refuse(not found["zero rows"], found)
