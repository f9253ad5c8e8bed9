"""Forward-looking labels."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.sql import q, safe_ratio
from candlewick.operators.cells import over_series

LABEL = "target_opportunity"
HORIZON = 5
THRESHOLD = 0.002


def label_value(window: str, horizon: int, threshold: float) -> str:
    """The label over a given window."""
    move = f"try_divide(lead(close, {horizon}) OVER ({window}), close) - 1.0D"
    return f"CAST(abs({move}) > {float(threshold)!r}D AS INT)"


def add_label(
    df: DataFrame, horizon: int = HORIZON, threshold: float = THRESHOLD, **over: Any
) -> DataFrame:
    """Append 1 where close moves by more than `threshold` within `horizon` bars, else 0.

    The last `horizon` bars of a series have no label.
    """

    def build(part: DataFrame, window: str) -> DataFrame:
        return part.selectExpr("*", f"{label_value(window, horizon, threshold)} AS {LABEL}")

    return over_series(df, build, after=horizon, **over)


def value_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels present and their numbers of rows, as a map sorted by label."""
    labels = df.filter(f"{LABEL} IS NOT NULL").selectExpr(*map(q, by), f"CAST({LABEL} AS INT) AS _label")
    counts = labels.groupBy(*by, "_label").agg(F.expr("count(1) AS _n"))
    # one pair per distinct label
    pairs = "map_from_entries(sort_array(collect_list(struct(_label, _n)))) AS label_distribution"
    return counts.groupBy(*by).agg(F.expr(pairs))


def label_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Label counts and the share of positives among labelled rows (0.0 without any)."""
    counts = df.groupBy(*by).agg(
        F.expr(f"count_if({LABEL} = 0) AS label_0"),
        F.expr(f"count_if({LABEL} = 1) AS label_1"),
        F.expr(f"count({LABEL}) AS labeled"),
    )
    return counts.selectExpr("*", f"coalesce({safe_ratio('label_1', 'labeled')}, 0.0D) AS positive_rate")
