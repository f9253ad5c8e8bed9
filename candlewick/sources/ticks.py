"""Bars from single observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.sql import q, truncate_time


def bars_from_ticks(
    df: DataFrame, *, series: str, time: str, value: str, tie: str | None = None, unit: str = "hour"
) -> DataFrame:
    """OHLC bars per series and minute or hour; `tie` orders observations of the same instant.

    One aggregation, combined map-side, so a busy bar does not load one task. Without a tie the instant
    alone orders the ticks and Spark aggregates by hash; with one it has to sort.
    """
    ticks = df.selectExpr(
        f"{q(series)} AS series",
        f"{truncate_time(q(time), unit)} AS datetime",
        f"{q(value)} AS _value",
        f"{q(time) if tie is None else f'struct({q(time)}, {q(tie)})'} AS _at",
    )
    return ticks.groupBy("series", "datetime").agg(
        F.expr("min_by(_value, _at) AS open"),
        F.expr("max(_value) AS high"),
        F.expr("min(_value) AS low"),
        F.expr("max_by(_value, _at) AS close"),
    )


def single_bars(df: DataFrame, *, series: str, time: str, value: str, tie: str) -> DataFrame:
    """One flat bar per observation, keeping `tie` as tick_id to order equal instants."""
    return df.selectExpr(
        f"{q(series)} AS series",
        f"{q(time)} AS datetime",
        f"{q(tie)} AS tick_id",
        *[f"{q(value)} AS {name}" for name in ("open", "high", "low", "close")],
    )
