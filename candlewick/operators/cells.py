"""Order-preserving blocks of bounded size, and what can be computed on them.

A group (a series, a fold, an event subset) may hold most of the table, so no operator here hands a
whole group to one task. Rows are keyed by `levels`: ever finer keys, such as the time in steps of 49
days, 68 minutes, 4 seconds, ..., whose lexicographic order agrees with the sort order. A cell is a
prefix of these keys. Cells that hold more than `max_rows` rows are split by the next level, so a block
stays small however the rows are spread. What no level can split are copies of one row; they are merged
and counted instead. A group that is not crowded itself stays one block: the group is the coarsest cell.
The measured split affects balance only: every operator is exact under any split, including none at all.
NULL is a key like any other.

Levels and sort terms are SQL text over the columns of the frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.sql import (
    BEFORE,
    UPTO,
    WHOLE,
    epoch_seconds,
    over,
    q,
    qs,
    second_fraction,
)
from candlewick.operators.copies import expand_copies, merge_copies
from candlewick.session import stage_counted

MAX_ROWS = 500_000  # rows one cell may hold before it is split
BROADCAST_ROWS = 200_000  # rows of a table of cells that may be broadcast; beyond, it is shuffled
TIME_STEP = 22  # width of a first-level time cell: 2^22 seconds


def time_levels(df: DataFrame, time: str, step: int = TIME_STEP) -> list[str]:
    """Time in cells of 2^step seconds, then 1024 times finer per level; NULL comes first."""
    seconds = f"coalesce({epoch_seconds(df, time)}, {-(2**62)})"
    coarse = [f"shiftright({seconds}, {s})" for s in range(step, 0, -10)]
    return [*coarse, seconds, f"coalesce({second_fraction(df, time)}, 0L)"]


def score_levels(score: str) -> list[str]:
    """Score in [0, 1], highest first, NULL last: 4096 cells, 1024 times finer per level, then exact."""
    p = f"coalesce({q(score)}, -1.0D)"
    inside = f"greatest(0.0D, least(1.0D, {p}))"
    return [f"-CAST(floor({inside} * {2**bits}.0D) AS BIGINT)" for bits in (12, 22, 32)] + [f"-{p}"]


def hex_levels(key: str) -> list[str]:
    """Hex text, smallest first: 4096 cells by its first three digits, then three more per level."""
    digits = [f"CAST(conv(substr({q(key)}, {at}, 3), 16, 10) AS BIGINT)" for at in (1, 4, 7)]
    return [*digits, q(key)]


def sortable(df: DataFrame) -> list[str]:
    """Columns that can be compared and grouped."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def row_hash(df: DataFrame, without: Sequence[str]) -> str:
    """Hash over the other columns: separates rows that agree in all earlier sort columns."""
    rest = [name for name in sortable(df) if name not in without]
    return f"xxhash64({qs(rest)})" if rest else "0L"


def hash_levels(key: str) -> list[str]:
    """A BIGINT hash in 1024 cells, then exact."""
    return [f"shiftright({key}, 54)", key]


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name; NULL equals NULL."""
    names = [f"_key{i}" for i in range(len(keys))]
    rest = [q(c) for c in right.columns if c not in keys]
    other = right.selectExpr(*[f"{q(k)} AS {n}" for k, n in zip(keys, names)], *rest)
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & F.col(q(key)).eqNullSafe(F.col(name))
    return left.join(other, same, how).drop(*names)


@dataclass(frozen=True)
class Listed:
    """A stored table of cells, and whether it is few enough rows to broadcast."""

    rows: DataFrame
    few: bool

    @staticmethod
    def of(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> Listed:
        return Listed.counted(df, name, limit)[0]

    @staticmethod
    def counted(df: DataFrame, name: str, limit: int = BROADCAST_ROWS, **facts: str) -> tuple[Listed, dict]:
        """The list, and further aggregates over it."""
        rows, found = stage_counted(df, name, n="count(1)", **facts)
        return Listed(rows, found["n"] <= limit), found

    def matched(self, left: DataFrame, keys: Sequence[str], how: str = "inner", **more: str) -> DataFrame:
        """`matched` with `left`; `more` are further columns, name=expression."""
        right = self.rows.selectExpr("*", *[f"{e} AS {n}" for n, e in more.items()]) if more else self.rows
        return matched(left, F.broadcast(right) if self.few else right, keys, how)


@dataclass(frozen=True)
class Cells:
    """Key of every row: group columns, levels, and for each level the cells to split further.

    `copies` lists cells that stay crowded at the last level.
    """

    groups: tuple[str, ...]
    levels: tuple[str, ...] = ()
    split: tuple[Listed, ...] = ()
    copies: Listed | None = None

    @property
    def columns(self) -> list[str]:
        return [f"_c{i}" for i in range(len(self.split) + 1)] if self.levels else []

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the cell columns; a finer column stays 0 where its cell is not split."""
        if not self.levels:
            return df
        out = df.selectExpr("*", f"{self.levels[0]} AS _c0")
        for i, crowded in enumerate(self.split):
            keys = [*self.groups, *self.columns[: i + 1]]
            out = crowded.matched(out, keys, "left", _split="true").selectExpr("*", f"{self.levels[i + 1]} AS _fine")
            none = f"CAST(0 AS {out.schema['_fine'].dataType.simpleString()})"
            out = out.selectExpr("*", f"CASE WHEN _split THEN _fine ELSE {none} END AS _c{i + 1}")
            out = out.drop("_split", "_fine")
        return out.select(*df.columns, *self.columns)


def measure(
    df: DataFrame, groups: Sequence[str], levels: Sequence[str], *, max_rows: int = MAX_ROWS
) -> Cells:
    """Count rows per group, then per cell, and find the crowded ones, level by level.

    Reads only the key columns and combines counts map-side. As a rule the first pass finds no crowded group.
    At most rows / max_rows cells can be crowded; their list is a stored table, broadcast only if it is short.
    """
    groups = list(groups)
    names = [f"_c{i}" for i in range(len(levels))]
    live = df.selectExpr(*map(q, groups), *[f"{lv} AS {name}" for lv, name in zip(levels, names)])
    if not live.groupBy(*groups).count().filter(f"count > {max_rows}").take(1):
        return Cells(tuple(groups))
    split: list[Listed] = []
    for depth in range(len(levels)):
        keys = [*groups, *names[: depth + 1]]
        crowded = live.groupBy(*keys).count().filter(f"count > {max_rows}").drop("count")
        part = Listed.of(crowded, "crowded")
        if not part.rows.take(1):
            break
        if depth == len(levels) - 1:
            return Cells(tuple(groups), tuple(levels), tuple(split), part)
        split.append(part)
        live = part.matched(live, keys, "left_semi")
    return Cells(tuple(groups), tuple(levels), tuple(split))


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, str], DataFrame],
    *,
    before: int = 0,
    after: int = 0,
    series: Sequence[str] = ("series",),
    time: str = "datetime",
    tie: Sequence[str] | None = None,
    cells: Cells | None = None,
    step: int = TIME_STEP,
    **split,
) -> DataFrame:
    """Run window expressions over whole series without sending a series to one task.

    `build(df, window)` adds columns whose value at a row depends on at most the `before` rows ahead of
    it and the `after` rows following it; `window` is the text inside OVER (...) up to the frame. The
    table is shuffled once, by block. Rows far enough from the ends of their block are finished there.
    Only the few rows at block ends go on to the next coarser block, where their neighbours from the
    adjoining blocks meet them; the last step is the series itself.

    `tie` orders rows of the same time; `()` states that there are none, and by default a hash of the
    other columns does, then the columns themselves. Further keywords go to `measure`.
    """
    series = list(series)
    levels, order = time_levels(df, time, step), [q(time), *map(q, tie or ())]
    if tie is None:
        order += [row_hash(df, [*series, time]), *[q(c) for c in sortable(df) if c not in (*series, time)]]
        levels += hash_levels(order[1])
    cells = cells or measure(df, series, levels, **split)
    if cells.copies is not None and tie is None and len(sortable(df)) == len(df.columns):
        return _over_copies(df, build, before, after, series, order, cells)
    return _over_blocks(cells.assign(df), build, before, after, series, order, cells)


def _over_copies(df, build, before, after, series, order, cells: Cells) -> DataFrame:
    """`over_series` where some rows have more copies than a block may hold.

    All copies with `before` equal rows ahead and `after` behind get the same values. So the ends of
    such a run are kept in full, and one row stands for its middle.
    """
    tagged, keys = cells.assign(df), [*series, *cells.columns]
    ends = before + after
    crowded = cells.copies.matched(tagged, keys, "left_semi")
    runs = merge_copies(crowded.select(*tagged.columns)).selectExpr(
        "*", f"explode(sequence(1L, least(_times, {2 * ends + 1}L))) AS _copy"
    )
    middle = f"_copy = {ends + 1} AND _times > {2 * ends + 1}"
    runs = runs.selectExpr(
        *map(q, tagged.columns), "_copy", f"CASE WHEN {middle} THEN _times - {2 * ends} ELSE 1L END AS _times"
    )
    rest = cells.copies.matched(tagged, keys, "left_anti").selectExpr(*map(q, tagged.columns), "1L AS _copy", "1L AS _times")
    out = _over_blocks(rest.unionByName(runs), build, before, after, series, [*order, "_copy"], cells)
    names = [name for name in out.columns if name not in ("_copy", "_times")]
    again = expand_copies(out.filter("_times > 1").drop("_copy"))
    return out.filter("_times = 1").select(*names).unionByName(again.select(*names))


def _over_blocks(frame, build, before, after, series, order, cells: Cells) -> DataFrame:
    """Finish the rows inside the blocks, then those at block ends in ever coarser blocks."""
    order, reach, keys = ", ".join(order), before + after, cells.columns
    out: DataFrame | None = None
    if keys:
        frame = frame.selectExpr("*", "true AS _open")
    while True:
        by = qs([*series, *keys])
        window = f"PARTITION BY {by} ORDER BY {order}" if by else f"ORDER BY {order}"
        if not keys:
            last = build(frame, window)
            return last if out is None else out.unionByName(last.filter("_open").drop("_open"))
        frame = frame.selectExpr(
            *[c for c in frame.columns if c not in ("_row", "_left")],
            f"row_number() OVER ({window}) AS _row",
            f"count(1) OVER ({window} {WHOLE}) - row_number() OVER ({window}) AS _left",
        )
        inner = f"(_row > {before} AND _left >= {after})"
        done = build(frame, window).filter(f"_open AND {inner}").drop(*cells.columns, "_open", "_row", "_left")
        out = done if out is None else out.unionByName(done)
        kept = [c for c in frame.columns if c not in (keys[-1], "_open", "_row", "_left")]
        frame = frame.filter(f"_row <= {reach} OR _left < {reach}").selectExpr(
            *map(q, kept), f"_open AND NOT {inner} AS _open"
        )
        keys = keys[:-1]


def block_offsets(blocks: DataFrame, groups: Sequence[str], columns: Sequence[str], **sums: str) -> DataFrame:
    """Sums over the earlier blocks of the group, from a table of one row per block: `_ahead` of the
    block sizes `_n`, and further ones as new_name=column.

    Added up level by level: blocks within their parent, parents within theirs, so that no task sees all blocks
    of a large group.
    """
    wanted = {"_ahead": "_n", **sums}
    if not columns:
        return blocks.selectExpr("*", *[f"0L AS {name}" for name in wanted])
    *above, last = columns
    window = over(map(q, [*groups, *above]), [q(last)], BEFORE)
    inside = blocks.selectExpr(
        "*", *[f"coalesce(sum({column}) {window}, 0L) AS {name}" for name, column in wanted.items()]
    )
    if not above:
        return inside
    keys, depth = [*groups, *above], len(columns)
    ups = [f"_up{depth}_{i}" for i in range(len(wanted))]
    totals = {f"_sum{depth}_{i}": column for i, column in enumerate(wanted.values())}
    parents = blocks.groupBy(*keys).agg(*[F.expr(f"sum({column}) AS {name}") for name, column in totals.items()])
    parents = block_offsets(parents.withColumn("_n", F.lit(0)), groups, above, **dict(zip(ups, totals)))
    joined = matched(inside, parents.select(*keys, *ups), keys)
    return joined.selectExpr(*map(q, blocks.columns), *[f"{name} + {up} AS {name}" for name, up in zip(wanted, ups)])


def add_position(
    df: DataFrame, name: str, *, groups: Sequence[str], order: Sequence[str], cells: Cells
) -> DataFrame:
    """Append the 1-based position of each row in its group, as a global sort would number it.

    Rows are numbered inside their block; the sizes of the blocks, a small aggregate, give the offsets.
    """
    keys = [*groups, *cells.columns]
    number = f"CAST(row_number() {over(map(q, keys), order)} AS BIGINT)"
    if not cells.columns:
        return df.selectExpr("*", f"{number} AS {q(name)}")
    tagged = cells.assign(df)
    blocks = tagged.groupBy(*keys).agg(F.expr("count(1) AS _n"))
    offsets = block_offsets(blocks, groups, cells.columns).drop("_n")
    runs = None
    if cells.copies is not None and len(sortable(df)) == len(df.columns):
        upto = f"sum(_times) {over(map(q, keys), [*order, *map(q, df.columns)], UPTO)} - _times AS _before"
        merged = merge_copies(cells.copies.matched(tagged, keys, "left_semi").select(*tagged.columns))
        runs = expand_copies(merged.selectExpr("*", upto)).selectExpr(
            *map(q, tagged.columns), "_before + _copy AS _row"
        )
        tagged = cells.copies.matched(tagged, keys, "left_anti").select(*tagged.columns)
    inside = tagged.selectExpr("*", f"{number} AS _row")
    if runs is not None:
        inside = inside.unionByName(runs)
    return matched(inside, offsets, keys).selectExpr(*map(q, df.columns), f"_ahead + _row AS {q(name)}")


def first_rows(
    df: DataFrame,
    n: int,
    *,
    order: Sequence[str],
    levels: Sequence[str],
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """The first n rows of a total order, for n of any size, without sorting a large table.

    The order must decide between any two rows that differ, and all columns must be comparable.
    Counts per cell show which cell the cut falls into; while that cell is crowded, only its rows are
    counted again by the next level. Cells before the cut are kept whole, and one cell is sorted.
    """
    names = [f"_c{i}" for i in range(len(levels))]
    keyed = df.selectExpr("*", *[f"{lv} AS {name}" for lv, name in zip(levels, names)])
    ahead = F.lit(False)  # rows certainly inside
    inside = F.lit(True)  # rows of the cell the cut falls into
    left = n
    for name in names:
        counts = keyed.filter(inside).groupBy(name).agg(F.expr("count(1) AS _n"))
        cut = (
            counts.selectExpr("*", f"coalesce(sum(_n) {over([], [name], BEFORE)}, 0L) AS _ahead")
            .filter(f"_ahead < {left} AND _ahead + _n >= {left}")
            .collect()
        )
        if not cut:  # fewer rows than asked for, or none asked for
            return df.limit(0) if n <= 0 else df
        at = F.lit(cut[0][name])
        ahead = ahead | (inside & (F.col(name) < at))
        inside = inside & (F.col(name) == at)
        left -= cut[0]["_ahead"]
        if cut[0]["_n"] == left:  # the cut falls on the end of the cell
            return keyed.filter(ahead | inside).select(*df.columns)
        if cut[0]["_n"] <= max_rows:
            break
    # copies are merged before they are ordered, so they cannot pile up in a task
    merged = merge_copies(keyed.filter(inside).select(*df.columns))
    upto = f"sum(_times) {over([], order, UPTO)}"
    taken = merged.selectExpr(
        *map(q, df.columns), f"greatest(0L, least(_times, {left} - ({upto} - _times))) AS _times"
    )
    return keyed.filter(ahead).select(*df.columns).unionByName(expand_copies(taken).select(*df.columns))
