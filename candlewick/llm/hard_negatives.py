"""Hard negatives by Kronecker-packed products.

Every anchor gets its nearest rows of the same label as positives, and for each positive the nearest rows of other labels
whose score lies in a band below the positive's. Scores are exact inner products of integer components.

A block of candidates is packed component by component: the components of its rows, biased to be non-negative, lie in
fields of one wide integer, so wide that no sum can run over into the next field. One multiplication per component of an
anchor then serves all rows of the block; the fields of the sum, less what the two biases added, are the scores:

    sum((a - la) * (c - lc)) = sum(a * c) - la * sum(c - lc) - lc * sum(a - la) - n * la * lc

Every anchor is held against every row, a stated query set against all rows. Rows are dealt into blocks by their id, so
neither a label nor a group of copies fills a block. Anchors come in waves of about WAVE, which bounds what is sent to
the tasks; a wave passes over the stored blocks twice, once for the positives (blocks are sorted by label, only the
anchor's label is packed) and once for the negatives. A task keeps the best few per anchor, so what is shuffled grows
with anchors and tasks, not with pairs. The work is the product of anchors and rows, as the contract has it.

Rows without id, label or vector, with a null or non-finite component, without any component, or whose squared length
exceeds 2 ** 62 (a score might not fit a long) take no part. Only vectors of one length are compared. An id that
occurs several times counts once, with its least label and vector. Ties go to the smaller id. Anchors without positives
and positives without negatives give no row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.llm.common import mapped, store, table

WAVE = 8192
BLOCK_ROWS = 4096
BLOCK_CELLS = 1 << 19
LARGEST = float(1 << 62)

BLOCKS = "size int, ids binary, labels binary, vectors binary"
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = POSITIVES + ", negative_id long, negative_score long"


def quantised(df: DataFrame, label: Column | str = "label", scale: float = 256.0) -> DataFrame:
    """vec_id, label, vector of integers floor(scale * x); rows that take no part are left out."""
    vector = F.transform("embedding", lambda x: F.lit(scale) * x.cast("double"))
    rows = df.select("vec_id", (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), vector.alias("v"))
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
    rows = rows.filter(F.col("norm") <= LARGEST)  # null, NaN and infinity fail as well
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x)).alias("vector"))


class Packed:
    """Rows of integers, a wide integer per component."""

    def __init__(self, values: np.ndarray, largest: int):
        """`largest` bounds the anchors' components from above and their negatives."""
        self.low = int(values.min())
        shifted = values - self.low
        bound = values.shape[1] * 2 * largest * max(1, int(shifted.max()))
        self.words = 1 if bound < 1 << 32 else 2 if bound < 1 << 64 else 4
        self.sums = shifted.sum(axis=1)
        self.rows, self.size = values.shape
        field = np.zeros((self.size, self.rows, self.words), dtype="<u4")
        halves = shifted.T.astype(np.uint64)
        field[:, :, 0] = halves & np.uint64(0xFFFFFFFF)
        if self.words > 1:
            field[:, :, 1] = halves >> np.uint64(32)
        self.columns = [int.from_bytes(column.tobytes(), "little") for column in field]

    def scores(self, anchor: Anchor) -> np.ndarray:
        total = 0
        for factor, column in zip(anchor.shifted, self.columns):
            if factor:
                total += factor * column
        raw = total.to_bytes(4 * self.rows * self.words, "little")
        if self.words == 1:
            found = np.frombuffer(raw, "<u4").astype(np.int64)
        else:  # the low 64 bits are enough: the score fits, so the corrections may wrap
            found = np.frombuffer(raw, "<i8")[:: self.words // 2].copy()
        fixed = self.low * anchor.sum + self.size * anchor.low * self.low
        with np.errstate(over="ignore"):
            found += np.int64(anchor.low) * self.sums
            found += np.uint64(fixed % (1 << 64)).astype(np.int64)
        return found


class Anchor:
    def __init__(self, key: int, label: int, vector: np.ndarray):
        self.key, self.label, self.low = key, label, int(vector.min())
        self.shifted = (vector - self.low).tolist()
        self.sum = sum(self.shifted)


class Best:
    """The first few (score, id) by falling score, then rising id."""

    def __init__(self, most: int):
        self.most = most
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.ids) == self.most:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if not len(ids):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(ids) > 64:  # first by score alone
            near = scores >= np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, ~scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one length, sorted by label and id."""
    waiting: dict[int, list] = {}

    def block(size: int) -> pa.RecordBatch:
        ids, labels, vectors = (np.concatenate(x) for x in zip(*waiting.pop(size)))
        order = np.lexsort((ids, labels))
        vectors = vectors[order]
        narrow = np.int16 if np.abs(vectors).max() < 1 << 15 else np.int64
        cells = [[size], [ids[order].tobytes()], [labels[order].tobytes()], [vectors.astype(narrow).tobytes()]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
            names=["size", "ids", "labels", "vectors"],
        )

    for batch in batches:
        vectors = batch.column("vector")
        sizes = np.asarray(vectors.value_lengths())
        flat, starts = np.asarray(vectors.flatten()), np.cumsum(sizes) - sizes
        ids, labels = (np.asarray(batch.column(c)) for c in ("vec_id", "label"))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // int(size)))
            while len(rows):
                have = sum(len(x[0]) for x in waiting.get(size, []))
                now, rows = rows[: most - have], rows[most - have :]
                matrix = flat[starts[now][:, None] + np.arange(size)]
                waiting.setdefault(int(size), []).append((ids[now], labels[now], matrix))
                if have + len(now) == most:
                    yield block(int(size))
    for size in list(waiting):
        yield block(size)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for size, ids, labels, vectors in zip(*(batch.column(c) for c in ("size", "ids", "labels", "vectors"))):
            ids, labels = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, labels))
            raw = vectors.as_buffer()
            kind = np.int16 if len(raw) == 2 * len(ids) * size.as_py() else np.int64
            yield ids, labels, np.frombuffer(raw, kind).reshape(len(ids), -1).astype(np.int64)


def _largest(anchors: list[tuple[int, int, np.ndarray]]) -> dict[int, int]:
    found: dict[int, int] = {}
    for _, _, vector in anchors:
        found[len(vector)] = max(found.get(len(vector), 1), int(np.abs(vector).max()))
    return found


def _positives(anchors: list[tuple[int, int, np.ndarray]], most: int):
    """Per task and anchor the best rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest, alike = _largest(anchors), {}
        for key, label, vector in anchors:
            alike.setdefault((len(vector), label), []).append((Anchor(key, label, vector), Best(most)))
        for ids, labels, vectors in _blocks(batches):
            cuts = np.flatnonzero(np.diff(labels, prepend=labels[0] - 1, append=labels[-1] + 1))
            for first, stop in zip(cuts[:-1], cuts[1:]):
                wanted = alike.get((vectors.shape[1], int(labels[first])))
                if wanted:
                    packed, own = Packed(vectors[first:stop], largest[vectors.shape[1]]), ids[first:stop]
                    for anchor, best in wanted:
                        others = own != anchor.key
                        best.add(packed.scores(anchor)[others], own[others])
        kept = [(a.key, b) for group in alike.values() for a, b in group if len(b.ids)]
        cells = [
            np.repeat(np.array([k for k, _ in kept], np.int64), [len(b.ids) for _, b in kept]),
            *(np.concatenate([np.zeros(0, np.int64), *(getattr(b, x) for _, b in kept)]) for x in ("ids", "scores")),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(anchors: list[tuple[int, int, np.ndarray]], positives: dict[int, list], most: int, low: int, high: int):
    """Per task, anchor and positive the best rows of other labels within the band of the positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest, wanted = _largest(anchors), {}
        for key, label, vector in anchors:
            # the band in whole scores: low * positive <= 100 * negative <= high * positive
            bands = [(i, p, -(-low * p // 100), high * p // 100, Best(most)) for i, p in positives.get(key, [])]
            if bands:
                wanted.setdefault(len(vector), []).append((Anchor(key, label, vector), bands))
        for ids, labels, vectors in _blocks(batches):
            packed = Packed(vectors, largest[vectors.shape[1]]) if vectors.shape[1] in wanted else None
            for anchor, bands in wanted.get(vectors.shape[1], []):
                scores = packed.scores(anchor)
                first, stop = np.searchsorted(labels, anchor.label), np.searchsorted(labels, anchor.label, "right")
                for _, _, least, top, best in bands:
                    if len(best.ids) == most:
                        least = max(least, int(best.scores[-1]))
                    inside = (scores >= least) & (scores <= top)
                    inside[first:stop] = False
                    best.add(scores[inside], ids[inside])
        rows = [
            (a.key, i, p, n, s)
            for group in wanted.values()
            for a, bands in group
            for i, p, _, _, b in bands
            for n, s in zip(b.ids.tolist(), b.scores.tolist())
        ]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def hard_negatives(
    rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, wave: int = WAVE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` holds vec_id, label and vector as from `quantised`; `anchor` is a condition on vec_id in SQL. `low` and `high`
    are the band in hundredths of the positive's score.
    """
    spark = rows.sparkSession
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")
    blocks = store(mapped(once, _pack, BLOCKS), "negative-blocks")
    # blocks are few and dear: each task takes some, however small their files are
    total = blocks.count()
    blocks = store(blocks.repartition(max(1, min(total, 4 * spark.sparkContext.defaultParallelism + total // 64))), "dealt")
    chosen = store(once.filter(anchor), "anchors")
    waves = -(-chosen.count() // wave)
    nearest = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = []
    for number in range(waves):
        own = chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == number).collect()
        anchors = [(r["vec_id"], r["label"], np.array(r["vector"], dtype=np.int64)) for r in own]
        near = mapped(blocks, _positives(anchors, positives), POSITIVES)
        near = near.withColumn("k", F.row_number().over(nearest)).filter(F.col("k") <= positives)
        pairs: dict[int, list] = {}
        for r in near.collect():
            pairs.setdefault(r["anchor_id"], []).append((r["positive_id"], r["positive_score"]))
        hard = mapped(blocks, _negatives(anchors, pairs, negatives, low, high), NEGATIVES)
        hard = hard.withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= negatives)
        found.append(store(hard, "hard-negatives"))
    if not found:
        return spark.createDataFrame([], NEGATIVES + ", rank int").select(*COLUMNS)
    return reduce(DataFrame.unionAll, found).select(*COLUMNS)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    return hard_negatives(quantised(table(spark, sf, "embeddings", "vec_id", "embedding", "label"), label), "vec_id % 100 = 0")


SQL = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF isfinite(CAST(x AS DOUBLE))]) = len(embedding)
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS alike,
        CAST(list_inner_product(a.vector, r.vector) AS BIGINT) AS score
    FROM whole a JOIN whole r ON a.vec_id <> r.vec_id AND len(a.vector) = len(r.vector)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
