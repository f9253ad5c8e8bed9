"""Precision at top k percent, per fold and per event, for all folds, events and k at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.sql import UPTO, candidate_count, over, q, safe_ratio, text
from candlewick.operators.cells import (
    MAX_ROWS,
    Cells,
    Listed,
    block_offsets,
    matched,
    measure,
    row_hash,
    score_levels,
    time_levels,
)
from candlewick.operators.events import event_names, event_rows
from candlewick.operators.labels import LABEL
from candlewick.operators.ranking import SCORE, score_order

TOP_K = (0.5, 1.0, 2.0)
PRECISION = ("k_percent", "candidate_count", "candidate_rate", "precision_at_k", "baseline")


def _each_k(top_k: Sequence[float]) -> str:
    return f"explode(array({', '.join(f'{float(k)!r}D' for k in top_k)})) AS k_percent"


def group_totals(df: DataFrame, by: Sequence[str], label: str = LABEL) -> DataFrame:
    """Rows and base rate of each group."""
    return df.groupBy(*by).agg(
        F.expr("count(1) AS rows"), F.expr(f"avg(CAST({q(label)} AS DOUBLE)) AS baseline")
    )


def precision_at_k(
    df: DataFrame,
    top_k: Sequence[float] = TOP_K,
    *,
    by: Sequence[str] = ("fold",),
    score: str = SCORE,
    label: str = LABEL,
    time: str = "datetime",
    series: Sequence[str] = ("series",),
    **split,
) -> DataFrame:
    """Share of positives among the best k percent of each group, for every group and k.

    The best rows are those that `add_rank` puts first, whatever the ties. No sort of the table: rows are counted
    per score cell (combined map-side). Cells above a cut count in full. Only the one cell per (group, k) that the
    cut runs through is ordered row by row. `df` is scanned twice, once for a few columns, so hand in a (see `stage`). NULL is a group like any other. Without any k there are no rows. Further keywords
    go to `measure`.
    """
    return _precision(df, top_k, by, score, label, time, series, split).drop("rows")


def _precision(df, top_k, by, score, label, time, series, split) -> DataFrame:
    """`precision_at_k` with the rows of each group."""
    by = list(by)
    series = [name for name in series if name not in by]
    slim = df.select(*by, score, label, time, *series)
    levels = [*score_levels(score), *time_levels(df, time)]
    # one histogram of the scores serves all groups and k; finer cells are only counted if a cut runs through a crowded one
    cells = Cells(tuple(by), tuple(levels[:1]))
    cuts, found = _cuts(slim, cells, top_k, label)
    if (found["most"] or 0) > split.get("max_rows", MAX_ROWS):
        cells = measure(slim, by, levels, **split)
        cuts, _ = _cuts(slim, cells, top_k, label)
    keys = [*by, *cells.columns]
    # equal rows are merged before they are ordered, so copies of one row cannot pile up in a task
    order = [*score_order(score, time, series), "_rest"]
    rest = row_hash(df, [*by, score, time, *series])
    tagged = cells.assign(df.selectExpr(*map(q, slim.columns), f"{rest} AS _rest"))
    cut_cells = Listed(cuts.rows.select(*keys).distinct(), cuts.few)
    merged = (
        cut_cells.matched(tagged, keys, "left_semi")
        .groupBy(*keys, score, time, *series, "_rest", label)
        .agg(F.expr("count(1) AS _n"))
        .selectExpr("*", f"sum(_n) {over(map(q, keys), order, UPTO)} AS _upto")
    )
    kept = f"greatest(0L, least(_n, _take - (_upto - _n))) * CAST({q(label)} AS BIGINT)"
    inside = (
        Listed(cuts.rows.select(*keys, "k_percent", "_take"), cuts.few)
        .matched(merged, keys)
        .groupBy(*by, "k_percent")
        .agg(F.expr(f"sum({kept}) AS _inside"))
    )
    return matched(cuts.rows, inside, [*by, "k_percent"], "left").selectExpr(
        *map(q, by),
        "k_percent",
        "candidate_count",
        "CAST(candidate_count AS DOUBLE) / CAST(_rows AS DOUBLE) AS candidate_rate",
        f"{safe_ratio('_pos_ahead + coalesce(_inside, 0L)', '_last')} AS precision_at_k",
        f"{safe_ratio('_positives', '_rows')} AS baseline",
        "_rows AS rows",
    )


def _cuts(slim: DataFrame, cells: Cells, top_k: Sequence[float], label: str) -> tuple[Listed, dict]:
    """Per group and k the cell that the cut runs through, with the sums of the cells above it; and the most rows of one."""
    by = list(cells.groups)
    keys = [*by, *cells.columns]
    blocks = cells.assign(slim).groupBy(*keys).agg(
        F.expr("count(1) AS _n"), F.expr(f"coalesce(sum(CAST({q(label)} AS BIGINT)), 0L) AS _pos")
    )
    totals = blocks.groupBy(*by).agg(F.expr("sum(_n) AS _rows"), F.expr("sum(_pos) AS _positives"))
    each_k = _each_k(top_k) if top_k else "explode(CAST(array() AS ARRAY<DOUBLE>)) AS k_percent"
    found = (
        matched(block_offsets(blocks, by, cells.columns, _pos_ahead="_pos"), totals, by)
        .selectExpr("*", each_k)
        .selectExpr("*", f"{candidate_count('_rows', 'k_percent')} AS candidate_count")
        .selectExpr("*", "least(candidate_count, _rows) AS _last")
        .filter("_ahead < _last AND _ahead + _n >= _last")
        .selectExpr("*", "_last - _ahead AS _take")
    )
    return Listed.counted(found, "cuts", most="max(_n)")


def fold_evaluation(
    df: DataFrame,
    top_k: Sequence[float] = TOP_K,
    *,
    by: Sequence[str] = ("fold",),
    expected: Sequence[str] = (),
    score: str = SCORE,
    label: str = LABEL,
    time: str = "datetime",
    series: Sequence[str] = ("series",),
    **split,
) -> DataFrame:
    """One row per fold and k: rows and baseline of the fold beside its precision at k.

    Values in `expected`, of a single grouping column, that have no rows are reported with zeros.
    """
    found = _precision(df, top_k, by, score, label, time, series, split)
    if not expected or not top_k:
        return found
    pairs = [(name, float(k)) for name in expected for k in top_k]
    wanted = df.sparkSession.createDataFrame(pairs, f"{q(by[0])} string, k_percent double")
    absent = matched(wanted, found.select(by[0]).distinct(), list(by), "left_anti")
    zeros = "0L AS candidate_count, 0.0D AS candidate_rate, 0.0D AS precision_at_k, 0.0D AS baseline, 0L AS rows"
    return found.unionByName(absent.selectExpr("*", *zeros.split(", ")))


def nest_precision(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Flat precision rows to one array of structs per group, sorted by k (one entry per k)."""
    entries = f"sort_array(collect_list(struct({', '.join(PRECISION)}))) AS precision_at_k"
    return metrics.groupBy(*by).agg(F.expr(entries))


def event_statistics(df: DataFrame, *, by: Sequence[str] = ("fold",), label: str = LABEL) -> DataFrame:
    """Frequency, rate and share of positives of each event that fired, per fold."""
    events = [
        f"struct({text(name)} AS event_name, count_if({q(name)} = 1) AS frequency, "
        f"avg(CASE WHEN {q(name)} = 1 THEN CAST({q(label)} AS DOUBLE) END) AS trade_rate)"
        for name in event_names(df)
    ]
    kind = "ARRAY<STRUCT<event_name: STRING, frequency: BIGINT, trade_rate: DOUBLE>>"
    made = f"CAST(array({', '.join(events)}) AS {kind})" if events else f"CAST(array() AS {kind})"
    totals = df.groupBy(*by).agg(F.expr("count(1) AS _rows"), F.expr(f"{made} AS _e"))
    keys = list(map(q, by))
    return (
        totals.selectExpr(*keys, "_rows", "inline(_e)")
        .filter("frequency > 0")
        .selectExpr(
            *keys, "event_name", "frequency", f"{safe_ratio('frequency', '_rows')} AS event_rate", "trade_rate"
        )
    )


def event_precision(
    df: DataFrame, top_k: Sequence[float] = TOP_K, *, by: Sequence[str] = ("fold",), **options
) -> DataFrame:
    """Precision at k inside the rows of each event: their own number, ranking and baseline."""
    return precision_at_k(event_rows(df), top_k, by=[*by, "event_name"], **options)


def event_diagnostics(
    df: DataFrame, top_k: Sequence[float] = TOP_K, *, by: Sequence[str] = ("fold",), **options
) -> DataFrame:
    """Event statistics beside the precision at k inside the event, one row per fold, event and k.

    Without event columns there are no rows.
    """
    stats = event_statistics(df, by=by, label=options.get("label", LABEL))
    if not event_names(df):
        empty = "k_percent double, candidate_count long, candidate_rate double, precision_at_k double, baseline double"
        none = df.sparkSession.createDataFrame([], empty)
        return stats.crossJoin(none).select(*by, "event_name", *PRECISION, "frequency", "event_rate", "trade_rate")
    return matched(event_precision(df, top_k, by=by, **options), stats, [*by, "event_name"])
