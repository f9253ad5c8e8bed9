"""Binary event flags."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.sql import q, text
from candlewick.operators.cells import over_series
from candlewick.operators.features import earlier, last_rows

EVENT_PREFIX = "event_"
PART = 10  # rows per partial aggregate
PARTS = 5  # partial aggregates per flag: 50 rows
LOOKBACK = 49  # rows before a bar that its flags depend on, given the features
FEATURE_LOOKBACK = 13  # rows atr_14 itself looks back


def flag(test: str) -> str:
    """1 where the test holds; 0 where it fails or a side is missing."""
    return f"coalesce(CAST({test} AS INT), 0)"


def event_levels(df: DataFrame, window: str) -> DataFrame:
    """Add the levels the flags compare with: `atr_mean_50` and `ret_std_50`, over 50 rows each.

    They are merged from five 10-row parts: sums for the mean; means and variances for the sample
    deviation, which keeps it numerically stable.
    """
    parts = df.selectExpr(
        "*",
        f"{last_rows('sum', 'atr_14', window, PART)} AS _sum",
        f"{last_rows('avg', 'ret_3', window, PART)} AS _mean",
        f"{last_rows('var_pop', 'ret_3', window, PART)} AS _var",
    )
    names = ("_sum", "_mean", "_var")
    parts = parts.selectExpr("*", *[x for name in names for x in earlier(name, window, PART, PARTS - 1)])

    def each(name: str) -> list[str]:
        return [name, *[f"{name}_{i}" for i in range(1, PARTS)]]

    parts = parts.selectExpr("*", f"({' + '.join(each('_mean'))}) / {PARTS}.0D AS _ret_mean")
    within = " + ".join(each("_var"))
    between = " + ".join(f"({m} - _ret_mean) * ({m} - _ret_mean)" for m in each("_mean"))
    return parts.selectExpr(
        *map(q, df.columns),
        f"({' + '.join(each('_sum'))}) / {PART * PARTS}.0D AS atr_mean_50",
        f"sqrt({PART}.0D * ({within} + {between}) / {PART * PARTS - 1}.0D) AS ret_std_50",
    )


def event_columns(df: DataFrame, window: str) -> DataFrame:
    """Add the event flags over a given window, from atr_14 and ret_3."""
    return event_levels(df, window).selectExpr(
        *map(q, df.columns),
        f"{flag('atr_14 > atr_mean_50')} AS event_vol_spike",
        f"{flag('abs(ret_3) > ret_std_50')} AS event_impulse",
    )


def add_events(df: DataFrame, **over: Any) -> DataFrame:
    """Append event_vol_spike and event_impulse to a frame with features."""
    return over_series(df, event_columns, before=LOOKBACK, **over)


def event_names(df: DataFrame) -> list[str]:
    """Event columns: all whose name starts with `event_`."""
    return [name for name in df.columns if name.startswith(EVENT_PREFIX)]


def event_summary(df: DataFrame) -> dict[str, Any]:
    """Number and names of the event columns."""
    names = event_names(df)
    return {"event_count": len(names), "event_columns": names}


def event_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per event that fired: the frame without its event columns, plus `event_name`."""
    names = names or event_names(df)
    fired = ", ".join(f"CASE WHEN {q(name)} = 1 THEN {text(name)} END" for name in names)
    rest = [q(name) for name in df.columns if name not in event_names(df)]
    return df.selectExpr(*rest, f"explode(array_compact(array({fired}))) AS event_name")


def event_frequency(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each event fired."""
    fired = event_rows(df.select(*by, *event_names(df)))
    return fired.groupBy(*by, "event_name").agg(F.expr("count(1) AS frequency"))
