"""Features, events and label in one pass over the series."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from candlewick.operators import events, features, labels
from candlewick.operators.cells import over_series

LOOKBACK = max(features.LOOKBACK, events.LOOKBACK + events.FEATURE_LOOKBACK)


def add_signals(
    df: DataFrame,
    horizon: int = labels.HORIZON,
    threshold: float = labels.THRESHOLD,
    *,
    label: bool = True,
    **over: Any,
) -> DataFrame:
    """Same columns as add_features, add_events and add_label in turn, with a single shuffle."""

    def build(part: DataFrame, window: str) -> DataFrame:
        extra = {labels.LABEL: labels.label_value(window, horizon, threshold)} if label else {}
        out = events.event_columns(features.feature_columns(part, window, **extra), window)
        rest = [name for name in out.columns if name not in extra]
        return out.select(*rest, *extra)

    return over_series(df, build, before=LOOKBACK, after=horizon if label else 0, **over)
