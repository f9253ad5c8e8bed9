"""Complete rows, time folds, their summaries, and expanding-window splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.sql import boundary, q, time_limit
from candlewick.operators.cells import TIME_STEP, add_position, hash_levels, measure, row_hash, time_levels
from candlewick.operators.labels import LABEL, label_summary, value_counts

FOLDS = ("train", "val", "test")


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing cell (in `subset`, default all columns), with an integer label."""
    kept = df.dropna("any", subset=list(subset) if subset else None)
    return kept.withColumn(LABEL, F.col(LABEL).cast("int")) if LABEL in df.columns else kept


def fold_of(train_end, val_end, time: str = "datetime") -> str:
    """SQL text: train up to and including train_end, val up to and including val_end, then test."""
    first, second = boundary(train_end), boundary(val_end)
    if first >= second:
        raise ValueError(f"train_end {first} must come before val_end {second}")
    at = q(time)
    return f"CASE WHEN {at} <= {time_limit(first)} THEN 'train' WHEN {at} <= {time_limit(second)} THEN 'val' ELSE 'test' END"


def time_split(df: DataFrame, train_end, val_end, time: str = "datetime") -> DataFrame:
    """Append `fold`."""
    return df.selectExpr("*", f"{fold_of(train_end, val_end, time)} AS fold")


def fold_sizes(df: DataFrame) -> dict[str, int]:
    """Rows of each fold (action over a table of at most three rows)."""
    return {row["fold"]: row["count"] for row in df.groupBy("fold").count().collect()}


def refuse_empty(sizes: Mapping[str, int]) -> None:
    """ValueError naming the folds without rows."""
    empty = [name for name in FOLDS if not sizes.get(name)]
    if empty:
        raise ValueError(f"Folds without rows: {empty}")


def check_folds(df: DataFrame) -> dict[str, int]:
    """Rows per fold; raises ValueError naming the empty ones."""
    sizes = fold_sizes(df)
    refuse_empty(sizes)
    return sizes


def fold_report(df: DataFrame) -> DataFrame:
    """All three folds with their rows, empty ones included, in one pass."""
    counts = df.groupBy().pivot("fold", list(FOLDS)).count()
    pairs = ", ".join(f"'{name}', coalesce({name}, 0L)" for name in FOLDS)
    return counts.selectExpr(f"stack({len(FOLDS)}, {pairs}) AS (fold, rows)").selectExpr("*", "rows = 0 AS empty")


def fold_summary(df: DataFrame) -> DataFrame:
    """Rows, label counts and positive rate of every fold in one pass."""
    return label_summary(df, ["fold"]).withColumnRenamed("labeled", "rows")


def fold_distribution(df: DataFrame) -> DataFrame:
    """Label distribution of every fold as a map."""
    return value_counts(df, ["fold"])


def expanding_role(position: str, rows: int, splits: int, split: str) -> str:
    """'train', 'test' or NULL for a 0-based row position in one expanding-window split."""
    size = rows // (splits + 1)
    start = f"({rows} - ({splits} - {split}) * {size})"
    return f"CASE WHEN {position} < {start} THEN 'train' WHEN {position} < {start} + {size} THEN 'test' END"


def expanding_splits(
    df: DataFrame, splits: int, *, series: Sequence[str] = ("series",), time: str = "datetime", **split
) -> DataFrame:
    """Each row once per split it takes part in, with `split` (from 0) and `role` (train or test).

    Rows are ordered by time, then series. Of s splits, number i tests the i-th of the last s equal
    parts and trains on everything before it.
    """
    numbered = number_rows(df, series=series, time=time, **split)
    total = df.count()
    if total < splits + 1:
        raise ValueError(f"Cannot make {splits} splits of {total} rows")
    each = numbered.selectExpr("*", f"explode(sequence(0, {splits - 1})) AS split")
    role = expanding_role("position", total, splits, "split")
    return each.selectExpr("*", f"{role} AS role").filter("role IS NOT NULL")


def number_rows(
    df: DataFrame, *, series: Sequence[str] = ("series",), time: str = "datetime", **split
) -> DataFrame:
    """Append `position`, 0-based, in the order of time, series, hash of the row, over the whole table."""
    rest = row_hash(df, [time, *series])
    order = [*map(q, [time, *series]), rest]
    cells = measure(df, [], [*time_levels(df, time), *map(q, series), *hash_levels(rest)], **split)
    out = add_position(df, "position", groups=[], order=order, cells=cells)
    return out.selectExpr(*map(q, df.columns), "position - 1 AS position")


def number_bars(
    df: DataFrame,
    *,
    series: Sequence[str] = ("series",),
    time: str = "datetime",
    tie: Sequence[str] = (),
    step: int = TIME_STEP,
    **split,
) -> DataFrame:
    """Append `bar_idx`, 0-based, in time order within each series; `tie` orders equal times."""
    rest = row_hash(df, [*series, time, *tie])
    levels = [*time_levels(df, time, step), *map(q, tie), *hash_levels(rest)]
    cells = measure(df, series, levels, **split)
    order = [q(time), *map(q, tie), rest]
    out = add_position(df, "bar_idx", groups=list(series), order=order, cells=cells)
    return out.selectExpr(*map(q, df.columns), "bar_idx - 1 AS bar_idx")
