"""Grid search over expanding time windows."""

from __future__ import annotations

import json
import time as clock
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from math import prod
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.sql import q
from candlewick.operators.folds import expanding_role, number_rows
from candlewick.operators.labels import LABEL
from candlewick.operators.models import score, train_model
from candlewick.operators.ranking import SCORE
from candlewick.session import stage

MAX_COMBINATIONS = 200


@dataclass(frozen=True)
class SearchResult:
    best_params: dict[str, Any]
    total_combinations: int
    total_fit_time: float
    results: DataFrame  # params, one score per split, mean, deviation, rank


def grid_points(grid: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations; names in alphabetical order, the last one varying fastest."""
    total = prod(len(values) for values in grid.values())
    if total > MAX_COMBINATIONS:
        raise ValueError(f"Grid too large: {total} combinations, at most {MAX_COMBINATIONS} are allowed")
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*[grid[name] for name in names])]


def f1(df: DataFrame, label: str = LABEL, name: str = SCORE) -> float:
    """F1 of class 1 at a cut of one half; 0 without any positive."""
    found, real = f"{q(name)} > 0.5D", f"{q(label)} = 1"
    counts = df.agg(
        F.expr(f"count_if({found} AND {real}) AS hit"),
        F.expr(f"count_if({found}) + count_if({real}) AS both"),
    ).head()
    return 2.0 * counts["hit"] / counts["both"] if counts["both"] else 0.0


def grid_search(
    df: DataFrame,
    features: Sequence[str],
    grid: Mapping[str, Sequence[Any]],
    *,
    splits: int = 3,
    params: Mapping[str, Any] | None = None,
    label: str = LABEL,
    series: Sequence[str] = ("series",),
    time: str = "datetime",
    parallelism: int = 2,
) -> SearchResult:
    """Fit every combination on every split; the highest mean F1 wins, the first of equals.

    Rows are numbered in time order and stored once; each split is a filter on that number. Fits run as
    Spark jobs, `parallelism` of them at a time.
    """
    points = grid_points(grid)
    started = clock.monotonic()
    wanted = dict.fromkeys([*features, label, time, *series])
    numbered = number_rows(df.select(*wanted), series=series, time=time)
    numbered = stage(numbered.select(*dict.fromkeys([*features, label]), "position"), "grid")
    rows = numbered.count()
    if rows < splits + 1:
        raise ValueError(f"Cannot make {splits} splits of {rows} rows")
    parts = []
    for split in range(splits):
        role = expanding_role("position", rows, splits, str(split))
        train, test = (numbered.filter(f"{role} = '{kind}'") for kind in ("train", "test"))
        classes = train.agg(F.expr(f"count(DISTINCT {q(label)})")).head()[0]
        parts.append((train, test, classes > 1))

    def evaluate(task: tuple[int, int]) -> float:
        point, split = task
        train, test, usable = parts[split]
        if not usable:  # one class only: nothing to learn
            return 0.0
        model = train_model(train, features, {**(params or {}), **points[point]}, label)
        return f1(score(test, model), label)

    tasks = [(point, split) for point in range(len(points)) for split in range(splits)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scores = list(pool.map(inheritable_thread_target(df.sparkSession)(evaluate), tasks))
    table = [scores[i * splits : (i + 1) * splits] for i in range(len(points))]
    means = [sum(row) / splits for row in table]
    order = sorted(range(len(points)), key=lambda i: -means[i])
    spark = df.sparkSession
    names = [f"split{i}_test_score" for i in range(splits)]
    results = spark.createDataFrame(
        [
            (
                json.dumps(points[i]),
                *table[i],
                means[i],
                (sum((v - means[i]) ** 2 for v in table[i]) / splits) ** 0.5,
                1 + sum(other > means[i] for other in means),
            )
            for i in range(len(points))
        ],
        "params STRING, "
        + "".join(f"{name} DOUBLE, " for name in names)
        + "mean_test_score DOUBLE, std_test_score DOUBLE, rank_test_score INT",
    )
    return SearchResult(points[order[0]], len(points), clock.monotonic() - started, results)
