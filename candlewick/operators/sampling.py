"""Exact, reproducible samples in hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.sql import epoch_seconds, q, sample_key, second_fraction
from candlewick.operators.cells import first_rows, hash_levels, hex_levels, row_hash, sortable
from candlewick.operators.labels import LABEL


def sample_rows(
    df: DataFrame,
    n: int,
    *,
    seed: int = 42,
    series: Sequence[str] = ("series",),
    time: str = "datetime",
    **cut,
) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: those whose hashed key comes first.

    Further keywords go to `first_rows`.
    """
    keyed = df.selectExpr("*", f"{sample_key(seed, *map(q, series), epoch_seconds(df, time))} AS _key")
    rest = row_hash(df, [*series, time])
    order = ["_key", *map(q, [time, *series]), rest, *map(q, sortable(df))]
    levels = [*hex_levels("_key"), second_fraction(df, time), *map(q, series), *hash_levels(rest)]
    return first_rows(keyed, n, order=order, levels=levels, **cut).drop("_key")


def downsample_negatives(
    df: DataFrame, ratio: int = 8, seed: int = 42, label: str = LABEL, counts: tuple[int, int] | None = None, **sample
) -> DataFrame:
    """All positives and min(negatives, positives * ratio) negatives; `counts` spares counting both, if it is known."""
    if ratio < 1:
        raise ValueError("The ratio of negatives to positives must be 1 or more")
    y = q(label)
    positive, negative = counts or df.agg(F.expr(f"count_if({y} = 1)"), F.expr(f"count_if({y} = 0)")).head()
    if not positive:
        raise ValueError("No positive rows to sample negatives for")
    if not negative:
        raise ValueError("No negative rows to sample from")
    wanted = min(negative, positive * ratio)
    negatives = df.filter(f"{y} = 0")
    if wanted < negative:
        negatives = sample_rows(negatives, wanted, seed=seed, **sample)
    return df.filter(f"{y} = 1").unionByName(negatives)


def sampling_summary(before: DataFrame, after: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows, positives and negatives before and after sampling, as one row."""
    both = before.selectExpr("true AS old", f"{q(label)} AS y").unionByName(
        after.selectExpr("false AS old", f"{q(label)} AS y")
    )
    counts = {
        "train_rows_before": "old",
        "train_rows_after": "NOT old",
        "positive_before": "old AND y = 1",
        "positive_after": "NOT old AND y = 1",
        "negative_before": "old AND y = 0",
        "negative_after": "NOT old AND y = 0",
    }
    return both.agg(*[F.expr(f"count_if({test}) AS {name}") for name, test in counts.items()])
