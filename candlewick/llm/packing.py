"""Packing of token sequences by minimum bin slack.

A text becomes its token ids and an end id. Only what is longer than a sequence is cut, from the end, so that just the
first piece may be short. Full pieces are sequences of their own. The rest is planned on the histogram of lengths, whose
size is bounded by the sequence length whatever the table: a bin takes the longest length left, then the combination of
lengths left that fills it best, found by subset-sum dynamic programming over a bitset with one bit per fill. The
combination is removed as often as the counts allow. Lengths are all a plan needs, so pieces are numbered within their
length, spread over salted groups, and looked up in the plan: nothing is sorted as a whole or gathered in one task.

Null texts count as empty and have the end id alone. Repeated rows are packed each; they take places in any order. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.llm.common import documents, mapped, store
from candlewick.llm.tokens import encoder, slices, vocabulary_path

LENGTH = 1024
END_ID = 2
GROUP_ROWS = 100_000


def cut(offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Texts cut from their ends: row, piece, start within the text, length of each piece."""
    sizes = np.diff(offsets)
    counts = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = sizes - (counts - 1) * length
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
    return row, piece, start, np.where(piece == 0, first[row], length)


def _pieces(path: str, length: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                rows = batch.slice(a, b - a)
                ids, offsets = encoder(path).encode(rows.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                row, piece, start, size = cut(offsets, length)
                at = offsets[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), size.tolist())]
                columns = {
                    "doc_id": rows.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
                if with_ids:
                    lists = [ids[x : x + n].astype(np.int32) for x, n in zip(at, size)]
                    columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def pieces(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return mapped(rows, _pieces(path or vocabulary_path(), length, end_id, with_ids), schema)


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that comes nearest to `room` from below."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:  # copies in powers of two
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, take = left - take, 2 * take
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> fill & 1:
            fill -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(histogram: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) so that all counts are used up and no combination exceeds `capacity`."""
    counts, found = {n: c for n, c in histogram.items() if c}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = _fullest({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        found.append((times, chosen))
    return found


def slots(bins: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, stop, copies, sequence, offset): number i of a length from first to stop goes to sequence
    + (i - first) // copies, at offset + (i - first) % copies * length."""
    rows, used, sequence = [], {}, 0
    for times, chosen in bins:
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, first + times * copies, copies, sequence, offset))
            used[length] = first + times * copies
            offset += copies * length
        sequence += times
    return rows


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`_number` from 0 within each key, without one task per key: numbered in salted groups plus the groups before."""
    groups = max(1, df.count() // GROUP_ROWS)
    salted = df.withColumn("_group", F.pmod(order[0] if order == ["_row"] else F.xxhash64(*order), F.lit(groups)))
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy(key, "_group")
        .count()
        .select(key, "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(key, "_group").orderBy(*order)) - 1
    return (
        salted.withColumn("_inside", inside)
        .join(offsets, [key, "_group"])
        .withColumn("_number", F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside", "_group")
    )


def placed(cuts: DataFrame, length: int = LENGTH) -> DataFrame:
    """`cuts` (from `pieces`, kept as a table) with sequence_id and offset."""
    spark = cuts.sparkSession
    histogram = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}  # at most `length` rows
    bins = plan(histogram, length)
    table = spark.createDataFrame(
        slots(bins), "_length long, _first long, _stop long, _copies long, _sequence long, _offset long"
    )
    own = [c for c in cuts.columns if c not in ("ids", "_row")]
    # rows that were stored with a number of their own are dealt by it, so that copies of a row spread as well
    rows = numbered(cuts, "length", ["_row"] if "_row" in cuts.columns else ["doc_id", "piece", "ids_crc32"])
    at = F.col("_number") - F.col("_first")
    fits = (F.col("length") == F.col("_length")) & (at >= 0) & (F.col("_number") < F.col("_stop"))
    # the plan's size is bounded by the number of lengths
    return rows.join(F.broadcast(table), fits).select(
        *own,
        (F.col("_sequence") + F.floor(at / F.col("_copies"))).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_copies") * F.col("length")).alias("offset"),
        *(c for c in cuts.columns if c == "ids"),
    )


def packed(df: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Pieces of all texts with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = pieces(df, doc, text, length, **options).withColumn("_row", F.monotonically_increasing_id())
    return placed(store(cuts, "pieces"), length)


def sequences(places: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from places that hold ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return places.groupBy("sequence_id").agg(joined.alias("ids"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(documents(spark, sf))
