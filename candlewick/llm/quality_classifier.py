"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are single words and pairs of neighbours, hashed into 2 ** BITS places, and one place for pairs of equal words; a
text's vector of counts is scaled to length one. Training takes a bounded sample of the labelled rows, TRAIN_ROWS chosen by hash, so it costs the same however
large the table is. The sample is dealt to SHARDS tasks, each follows the regularised leader over its rows, and their
weights are averaged. The L1 term keeps the weights sparse; at most 2 ** BITS numbers reach the driver and the
executors. Scoring is a sparse dot product per whole text, without a shuffle.

Null and empty texts have no features: their score is that of the bias. Labels other than 0 and 1 are left out; without
any labelled row all scores are 0.5. Equal texts score equally. Extra columns are ignored unless `keep` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import crc_mod, mapped, ship, table
from candlewick.llm.textarrays import mix, word_hashes

BITS = 18
TRAIN_ROWS = 12_000
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.005, 0.0
THRESHOLD = 0.3


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, value and text number of the features of each text, ascending by text."""
    hashes, owner, n = word_hashes(texts, lower=False)
    pair = owner[1:] == owner[:-1]
    both = mix(hashes[:-1] + np.uint64(0x9E3779B97F4A7C15) + mix(hashes[1:]))[pair]
    twice = pair & (hashes[1:] == hashes[:-1])
    same = np.full(twice.sum(), mix(np.array([1], np.uint64))[0])
    place = (np.concatenate([hashes, both, same]) >> np.uint64(64 - bits)).astype(np.int64)
    key = (np.concatenate([owner, owner[1:][pair], owner[1:][twice]]) << bits) | place
    key, count = np.unique(key, return_counts=True)
    text = key >> bits
    norm = np.sqrt(np.bincount(text, weights=count.astype(float) ** 2, minlength=n))
    return key & ((1 << bits) - 1), count / norm[text], text


def _examples(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, value, text = features(batch.column("text"), bits)
            cuts = np.searchsorted(text, np.arange(1, len(batch)))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": batch.column("shard"),
                    "turn": batch.column("turn"),
                    "label": batch.column("label"),
                    "places": pa.array([x.astype(np.int32) for x in np.split(place, cuts)], pa.list_(pa.int32())),
                    "values": pa.array([x.astype(np.float32) for x in np.split(value, cuts)], pa.list_(pa.float32())),
                }
            )

    return run


def leader(places: list, values: list, labels: np.ndarray, bits: int, epochs: int) -> np.ndarray:
    """Weights after the updates, the bias last."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i):
        w = np.sign(z[i]) * L1 - z[i]
        return np.where(np.abs(z[i]) > L1, w / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for i, x, y in zip(places, values, labels):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(len(z)))


def _train(bits: int, epochs: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("turn")
        bias = 1 << bits
        places = [np.append(x, bias).astype(np.int64) for x in rows.column("places").to_pylist()]
        values = [np.append(x, 1.0) for x in rows.column("values").to_pylist()]
        w = leader(places, values, rows.column("label").to_numpy().astype(float), bits, epochs)
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array(at, pa.int32()), "weight": pa.array(w[at], pa.float64())})

    return run


def train(examples: DataFrame, text: str, label: str, bits: int = BITS, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from a sample of at most `rows` rows with label 0 or 1; the bias is the last one."""
    ship(examples.sparkSession)
    turn = F.xxhash64(F.lit("turn"), text)
    sample = (
        examples.filter(F.col(label).isin(0, 1))
        .select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), turn.alias("turn"))
        .orderBy("turn")
        .limit(rows)
        .withColumn("shard", F.pmod("turn", F.lit(SHARDS)).cast("int"))
    )
    coded = mapped(
        sample, _examples(bits), "shard int, turn long, label int, places array<int>, values array<float>"
    )
    learnt = coded.groupBy("shard").applyInArrow(_train(bits, EPOCHS), "place int, weight double")
    weights = np.zeros((1 << bits) + 1)
    for row in learnt.groupBy("place").agg((F.sum("weight") / SHARDS).alias("weight")).collect():
        weights[row["place"]] = row["weight"]
    return weights


def _score(bits: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, value, text = features(batch.column("text"), bits)
            margin = np.bincount(text, weights=weights[place] * value, minlength=len(batch)) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(score, pa.float64())], names=[*kept.schema.names, "score"]
            )

    return run


def scored(df: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """The columns `keep` and the score of each row."""
    rows = df.select(*keep, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return mapped(rows, _score(bits, weights.astype(np.float32)), schema + ", score double")


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    # the sample is chosen before texts are read: its ids are bounded by TRAIN_ROWS
    labels = table(spark, sf, "labels", "doc_id", "quality").filter(crc_mod("doc_id", 5) != 0)
    labels = labels.filter("quality IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    examples = docs.filter("NOT held_out").join(F.broadcast(labels), "doc_id")
    weights = train(examples, "text", "quality")
    rows = scored(docs, weights, ["doc_id", "held_out"])
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
