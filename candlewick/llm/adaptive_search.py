"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to length one and rotated by a random orthogonal matrix, so that any few of their components tell as
much of a distance as any others. They are grouped into about sqrt(rows) lists by their nearest centroid and stored in
blocks, component by component. A query looks into the lists of its nearest centroids. There it adds up the distance to
all candidates of a block over one group of components after the other; after d of D components a candidate is given up if
the hypothesis that it lies nearer than the query's bound has to be rejected: if

    partial * D / d > (1 + ERROR / sqrt(d)) ** 2 * bound.

What is left after all components is measured on the original vectors in double precision.

Rotation, centroids and the number of lists to probe are fitted on a bounded sample of SAMPLE different vectors, chosen by
hash; every row is indexed. PROBED is the share of the sample's true neighbours whose list has to be among the probed
ones: where vectors fall into clusters few lists are enough, where they are spread evenly in many directions it takes more
than half of them. A query's first bound is the last of the similarities wanted among those rows of the sample that lie in
its lists. A query that finds too few is held against everything, without tests.

Equal vectors are one candidate with the smallest of their ids, which is all that can be returned of them, so a group of
copies weighs no more than a row. Lists are cut into blocks of at most BLOCK_ROWS and dealt to tasks by a range of list
and hash, so a crowded list fills many tasks. Queries come in waves of about WAVE, which bounds what is sent to tasks; a
task keeps the best few per query.

Rows with a null id, a null, empty or zero vector, or one with null or non-finite components (or whose squares exceed a
double) take no part. Vectors are compared with those of their own length. An id that occurs several times counts once,
with its least vector. Ties go to the smaller id. With fewer candidates than wanted all of those found are returned.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.llm.common import mapped, store, table

SAMPLE = 16_384
SAMPLE_BYTES = 32 << 20
MOST_LISTS = 1024
PROBED = 0.97
TRIED = 256  # of the sample, to find the number of lists to probe
ROUNDS = 8
ERROR = 2.1
BLOCK_ROWS = 4096
WAVE = 16_384
TOGETHER = 256  # queries that scan a block at once
NEVER = -1e6  # a similarity that everything exceeds, however few components are seen
SLACK = 1e-5  # of a squared distance in single precision

BLOCKS = "list int, ids binary, counts binary, vectors binary, rotated binary"
ASKED = "key long, vector binary, rotated binary, cut double, bound double"
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(df: DataFrame) -> DataFrame:
    """vec_id and embedding in its own precision, one row per id."""
    rows = df.select("vec_id", "embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = rows.filter("vec_id IS NOT NULL").filter((norm > 0) & (norm <= 1.7e308))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


class Model:
    """Rotation, centroids, number of lists to probe, and the rotated sample."""

    def __init__(self, rotation: np.ndarray, centroids: np.ndarray, probes: int, sample: np.ndarray):
        self.rotation, self.centroids, self.probes, self.sample = rotation, centroids, probes, sample

    @staticmethod
    def fit(vectors: np.ndarray, rows: int, wanted: int) -> Model:
        """From the sample; `rows` is the number of all vectors, `wanted` how many neighbours are looked for."""
        random = np.random.default_rng(11)
        size = vectors.shape[1]
        rotation = np.linalg.qr(random.normal(size=(size, size)))[0]
        sample = (unit(vectors) @ rotation).astype(np.float32)
        lists = max(1, min(MOST_LISTS, math.isqrt(rows), len(sample) // 4))
        centroids = sample[random.choice(len(sample), lists, replace=False)]
        for _ in range(ROUNDS):
            nearest = np.argmax(sample @ centroids.T, axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, sample)
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centroids = np.where(length > 0, sums / np.maximum(length, 1e-20), centroids)
        nearest = np.argmax(sample @ centroids.T, axis=1)
        tried = sample[:TRIED]
        near = tried @ sample.T
        np.fill_diagonal(near, -2.0)
        best = np.argpartition(-near, min(wanted, len(sample)) - 1, axis=1)[:, : min(wanted, len(sample))]
        order = np.argsort(np.argsort(-(tried @ centroids.T), axis=1), axis=1)
        ranks = np.take_along_axis(order, nearest[best], axis=1)
        return Model(rotation, centroids, int(np.quantile(ranks, PROBED, method="higher")) + 1, sample)

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rotation=self.rotation, centroids=self.centroids, probes=self.probes, sample=self.sample)
        return out.getvalue()

    @staticmethod
    def loaded(raw: bytes) -> Model:
        parts = np.load(io.BytesIO(raw))
        return Model(parts["rotation"], parts["centroids"], int(parts["probes"]), parts["sample"])

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return (unit(vectors) @ self.rotation).astype(np.float32)


def _fit(rows: int, wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [matrix(b.column("embedding")) for b in batches if b.num_rows]
        if not held:
            return
        model = Model.fit(np.concatenate(held), rows, wanted)
        yield pa.RecordBatch.from_arrays([pa.array([model.dumped()], pa.binary())], names=["model"])

    return run


def _assign(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            nearest = [np.zeros(0, np.int32)]
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                near = model.rotated(matrix(vectors.slice(first, BLOCK_ROWS))) @ model.centroids.T
                nearest.append(np.argmax(near, axis=1).astype(np.int32))
            columns = [pa.array(np.concatenate(nearest), pa.int32()), batch.column("turn"), batch.column("ids"), vectors]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "turn", "ids", "embedding"])

    return run


def _pack(model: Model):
    """Blocks of one list: the ids of each vector, the vectors, and the rotated ones by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            vectors = matrix(rows.column("embedding").chunk(0))
            ids = rows.column("ids").chunk(0)
            cells = [
                pa.array([rows.column("list")[0].as_py()], pa.int32()),
                *(
                    pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
                    for x in (
                        np.asarray(ids.flatten()),
                        np.asarray(ids.value_lengths()).astype(np.int32),
                        vectors,
                        model.rotated(vectors).T,
                    )
                ),
            ]
            return pa.RecordBatch.from_arrays(cells, names=["list", "ids", "counts", "vectors", "rotated"])

        for batch in batches:
            lists = np.asarray(batch.column("list"))
            cuts = np.flatnonzero(np.diff(lists, prepend=-1, append=-1)) if len(lists) else [0]
            for first, stop in zip(cuts[:-1], cuts[1:]):
                if held and held[0].column("list")[0].as_py() != lists[first]:
                    yield block()
                while first < stop:
                    have = sum(x.num_rows for x in held)
                    n = min(stop - first, BLOCK_ROWS - have)
                    held.append(batch.slice(first, n))
                    first += n
                    if have + n == BLOCK_ROWS:
                        yield block()
        if held:
            yield block()

    return run


def _ask(model: Model, wanted: int):
    """Per query the similarity of the last centroid to probe, and the bound that the sample gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.argmax(model.sample @ model.centroids.T, axis=1)  # the lists of the sample
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                vectors = matrix(part.column("embedding"))
                rotated = model.rotated(vectors)
                lists = rotated @ model.centroids.T
                cut = np.sort(lists, axis=1)[:, -min(model.probes, lists.shape[1])] - np.float32(1e-6)
                near = np.where((lists >= cut[:, None])[:, own], rotated @ model.sample.T, np.float32(NEVER))
                k = near.shape[1] - wanted
                bound = np.partition(near, k, axis=1)[:, k] if k >= 0 else np.full(len(rotated), NEVER)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array([x.tobytes() for x in vectors.astype(np.float64)], pa.binary()),
                        pa.array([x.tobytes() for x in rotated], pa.binary()),
                        pa.array(cut.astype(np.float64)),
                        pa.array(bound.astype(np.float64) - 1e-6),
                    ],
                    names=["key", "vector", "rotated", "cut", "bound"],
                )

    return run


def scan(queries: np.ndarray, columns: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test has given up; `bounds` are squared distances per query."""
    size, n = columns.shape
    step = max(16, size // 16)
    dots = np.zeros((len(queries), n), np.float32)
    own, their = np.zeros(len(queries), np.float32), np.zeros(n, np.float32)
    q = x = None  # the pairs, once they are few
    for first in range(0, size, step):
        d = min(first + step, size)
        a, b = queries[:, first:d], columns[first:d]
        own += np.einsum("ij,ij->i", a, a)
        their += np.einsum("ij,ij->j", b, b)
        limit = (1 + ERROR / math.sqrt(d)) ** 2 * bounds * d / size if d < size else bounds + SLACK
        limit = limit.astype(np.float32)
        if q is None:
            dots += a @ b
            alive = own[:, None] + their - 2 * dots <= limit[:, None]
            if d == size or 8 * np.count_nonzero(alive) < alive.size:
                q, x = np.nonzero(alive)
                dots = dots[q, x]
        else:
            for at in range(0, len(q), 1 << 16):
                part = slice(at, at + (1 << 16))
                dots[part] += np.einsum("ij,ji->i", a[q[part]], b[:, x[part]])
            alive = own[q] + their[x] - 2 * dots <= limit[q]
            q, x, dots = q[alive], x[alive], dots[alive]
    return q, x


class Nearest:
    """The best `wanted` candidates of every query: similarity, then the smaller first id."""

    def __init__(self, bounds: np.ndarray, wanted: int):
        self.wanted, self.bounds = wanted, bounds.copy()
        self.best = self.none = (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, wanted), np.int64), np.zeros(0, np.int32))
        self.new: list[tuple] = []
        self.count = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((queries, scores, ids, counts))
        self.count += len(queries)
        if self.count > max(20_000, len(self.best[0])):
            self.settle()

    def settle(self) -> None:
        queries, scores, ids, counts = (np.concatenate(x) for x in zip(self.best, *self.new))
        self.new, self.count = [], 0
        order = np.lexsort((ids[:, 0], -scores, queries))
        queries, scores, ids, counts = (x[order] for x in (queries, scores, ids, counts))
        place = np.arange(len(queries)) - np.searchsorted(queries, queries)
        last = place == self.wanted - 1
        self.bounds[queries[last]] = np.maximum(self.bounds[queries[last]], scores[last])
        keep = place < self.wanted
        self.best = tuple(x[keep] for x in (queries, scores, ids, counts))


def _search(model: Model, asked: list, wanted: int, kind: type):
    """Per task the best candidates of each query of the wave; `kind` is the precision of the stored vectors."""
    keys = np.array([r["key"] for r in asked], np.int64)
    vectors, rotated = b"".join(bytes(r["vector"]) for r in asked), b"".join(bytes(r["rotated"]) for r in asked)
    cuts, bounds = (np.array([r[c] for r in asked]) for c in ("cut", "bound"))
    centroids = model.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        originals = np.frombuffer(vectors).reshape(len(keys), -1)
        queries = np.frombuffer(rotated, np.float32).reshape(len(keys), -1)
        lengths = np.sqrt(np.einsum("ij,ij->i", originals, originals))
        nearest = Nearest(bounds, wanted)
        for batch in batches:
            for number, *cells in zip(*(batch.column(c) for c in ("list", "ids", "counts", "vectors", "rotated"))):
                flat, counts, theirs, columns = (
                    np.frombuffer(c.as_buffer(), k) for c, k in zip(cells, (np.int64, np.int32, kind, np.float32))
                )
                theirs, columns = theirs.reshape(len(counts), -1).astype(np.float64), columns.reshape(-1, len(counts))
                ids = np.zeros((len(counts), wanted), np.int64)
                ids[np.arange(wanted) < counts[:, None]] = flat
                norms = np.sqrt(np.einsum("ij,ij->i", theirs, theirs))
                probing = np.flatnonzero(queries @ centroids[number.as_py()] >= cuts)
                for first in range(0, len(probing), TOGETHER):
                    own = probing[first : first + TOGETHER]
                    q, x = scan(queries[own], columns, 2 - 2 * nearest.bounds[own])
                    q = own[q]
                    for at in range(0, len(q), 1 << 16):
                        a, b = q[at : at + (1 << 16)], x[at : at + (1 << 16)]
                        scores = np.einsum("ij,ij->i", originals[a], theirs[b]) / (lengths[a] * norms[b])
                        near = scores >= nearest.bounds[a]
                        nearest.add(a[near], scores[near], ids[b[near]], counts[b[near]])
        nearest.settle()
        q, scores, ids, counts = nearest.best
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        flat = ids[np.arange(wanted) < counts[:, None]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[q]), pa.array(scores), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["key", "score", "ids"],
        )

    return run


def _of_one_length(rows: DataFrame, query: str, most: int) -> DataFrame:
    spark, wanted = rows.sparkSession, most + 1  # the query itself is among its neighbours
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= wanted)
    vectors = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    total = rows.count()
    size = len(rows.first()["embedding"])
    precise = rows.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if precise == "float" else np.float64
    # equal vectors share a hash; a share of the hashes is enough, unless nearly all rows are copies of a few vectors
    most_fitted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    turn = F.xxhash64("embedding")
    for share in (1 + total // (8 * SAMPLE), 1):
        drawn = rows.select("embedding", turn.alias("turn")).filter(F.pmod(F.xxhash64("turn"), F.lit(share)) == 0)
        sample = drawn.distinct().orderBy("turn", "embedding").limit(most_fitted).select("embedding")
        fitted = mapped(sample.coalesce(1), _fit(total, wanted), "model binary").collect()
        if fitted:
            break
    model = Model.loaded(bytes(fitted[0]["model"]))

    schema = f"list int, turn long, ids array<long>, embedding array<{precise}>"
    assigned = store(mapped(vectors.withColumn("turn", turn), _assign(model), schema), "assigned")
    tasks = 4 * spark.sparkContext.defaultParallelism + total // (64 * BLOCK_ROWS)
    dealt = assigned.repartitionByRange(tasks, "list", "turn").sortWithinPartitions("list", "turn")
    blocks = store(mapped(dealt, _pack(model), BLOCKS), "search-blocks")

    asking = rows.filter(query)
    chosen = store(asking.groupBy("embedding").agg(F.min("vec_id").alias("key")), "queries")
    prepared = store(mapped(chosen, _ask(model, wanted), ASKED), "asked")
    waves = -(-prepared.count() // WAVE)
    found = []

    def searched(asked: list) -> DataFrame:
        near = mapped(blocks, _search(model, asked, wanted, kind), "key long, score double, ids array<long>")
        best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
        near = near.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= wanted)
        return store(near.select("key", (-F.col("score")).alias("far"), F.explode("ids").alias("vec_id")), "near")

    for wave in range(waves):
        mine = F.pmod(F.xxhash64("key"), F.lit(waves)) == wave
        asked = prepared.filter(mine).collect()
        near = searched(asked)
        whole = near.groupBy("key").count().filter(F.col("count") >= wanted).select("key")
        found.append(near.join(whole, "key", "left_semi"))
        # what found too few, by a test that went wrong or in small lists, is held against everything
        rest = prepared.filter(mine).join(whole, "key", "left_anti").withColumns({"cut": F.lit(NEVER), "bound": F.lit(NEVER)})
        short = rest.collect()
        if short:
            found.append(searched(short))
    if not found:
        return spark.createDataFrame([], RESULT)
    every = reduce(DataFrame.unionAll, found).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("far", "vec_id"))).alias("near"))
    every = every.join(chosen, "key").select("embedding", "near")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, most)
    answers = asking.join(every, "embedding").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "r"))
    return answers.select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "r.vec_id", (-F.col("r.far")).alias("score")
    )


def nearest(df: DataFrame, query: str, most: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): for the rows that meet `query`, a condition on vec_id, their `most` nearest others."""
    rows = store(usable(df), "searched")
    sizes = sorted(r["n"] for r in rows.select(F.size("embedding").alias("n")).distinct().collect())
    found = [_of_one_length(rows.filter(F.size("embedding") == n), query, most) for n in sizes]
    return reduce(DataFrame.unionAll, found) if found else df.sparkSession.createDataFrame([], RESULT)


def op11_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "embeddings", "vec_id", "embedding"), "vec_id % 50 = 0")
