"""Ranking by score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from candlewick.functions.sql import over, q
from candlewick.operators.cells import (
    add_position,
    hash_levels,
    measure,
    row_hash,
    score_levels,
    time_levels,
)

SCORE = "p_opportunity"
RANK = "rank_opportunity"


def score_order(score: str, time: str, series: Sequence[str]) -> list[str]:
    """Best score first; equal scores in row order, which is time, then series."""
    return [f"{q(score)} DESC NULLS LAST", q(time), *map(q, series)]


def add_rank(
    df: DataFrame,
    *,
    by: Sequence[str] = ("fold",),
    score: str = SCORE,
    time: str = "datetime",
    series: Sequence[str] = ("series",),
    **split,
) -> DataFrame:
    """Append rank_opportunity: 1 for the highest score of the fold, no two rows alike.

    Equal scores rank by time, then series, then a hash of the row. Further keywords go to `measure`.
    """
    rest = row_hash(df, [*by, score, time, *series])
    levels = [*score_levels(score), *time_levels(df, time), *map(q, series), *hash_levels(rest)]
    cells = measure(df, by, levels, **split)
    order = [*score_order(score, time, series), rest]
    return add_position(df, RANK, groups=list(by), order=order, cells=cells)


def best_per_group(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First n rows of each group with their `rank`.

    Spark keeps only n rows per group and task before it shuffles, so a large group does no harm.
    """
    ranked = df.selectExpr("*", f"row_number() {over(map(q, by), order)} AS rank")
    return ranked.filter(f"rank <= {n}")
