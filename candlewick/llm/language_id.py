"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit is trained on hashed byte n-grams. A text is given the
language whose codeword loses least against the classifiers' margins, the logistic loss of each bit being its weight: an
unsure classifier counts little. For few languages the code is exhaustive, with every split of them as a bit; for more it
is the random code, among several drawn from a fixed seed, whose nearest codewords lie farthest apart.

Features are runs of one to three bytes within a text, with upper-case A-Z lowered, hashed into 2 ** BITS places; a text
is the mean of its features, so a margin is the mean weight of its n-grams and costs one look-up per byte and length.
Training takes a bounded sample, PER_LANGUAGE rows of each language chosen by hash. Scoring reads whole texts without a
shuffle.

Null texts and texts without a letter are `und` with score 0, as are all if there is nothing to learn from. `ambiguous`
marks texts whose second-best language has at least a third of the probability of the best. Equal texts get equal results. Rows without
language are not learnt from. Extra columns are ignored unless `keep` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.llm.common import crc_mod, mapped, ship, table
from candlewick.llm.textarrays import flat, lowered, parts

BITS = 15
SALTS = 64
PER_LANGUAGE = 400
EPOCHS = 6
RATE = 4.0
SCALE = 20.0  # of the mean features, so that weights stay moderate
EXHAUSTIVE = 5
LENGTHS = (1, 2, 3)


def code(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language."""
    if languages <= EXHAUSTIVE:
        bits = range(1, 1 << max(0, languages - 1))
        rows = [[1 - 2 * (b >> i & 1) for b in bits] for i in range(languages)]
        return np.array(rows, dtype=np.int8).reshape(languages, len(bits))
    length = int(np.ceil(8 * np.log2(languages)))
    random = np.random.default_rng(7)
    drawn = [random.choice(np.array([-1, 1], np.int8), (languages, length)) for _ in range(200)]

    def distance(m):
        gaps = (length - m.astype(int) @ m.T) // 2
        np.fill_diagonal(gaps, length)
        mixed = (np.abs(m.sum(axis=0)) < languages).all()  # no bit is the same for all
        return gaps.min() if mixed else -1

    return max(drawn, key=distance)


def places(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and text of each n-gram; n-grams stay within their text."""
    data = lowered(data).astype(np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found, texts = [], []
    for n in LENGTHS:
        if len(data) < n:
            continue
        runs = len(data) - n + 1
        value = np.full(runs, n, dtype=np.uint32)
        for j in range(n):
            value = value * np.uint32(0x01000193) ^ data[j : j + runs]
        value = (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        inside = owner[:runs] == owner[n - 1 :]
        found.append(value[inside])
        texts.append(owner[:runs][inside])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found]).astype(np.int64), np.concatenate([empty, *texts])


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Per text and bit: the mean weight of its n-grams, scaled, and the bias in the last row of `weights`."""
    data, offsets = flat(texts)
    bits = int(np.log2(len(weights) - 1))
    result = np.zeros((len(texts), weights.shape[1]), dtype=np.float64)
    for first, stop in parts(offsets, 1 << 20):
        own = offsets[first : stop + 1] - offsets[first]
        place, text = places(data[offsets[first] : offsets[stop]], own, bits)
        for b in range(weights.shape[1]):
            sums = np.bincount(text, weights=weights[place, b], minlength=stop - first)
            result[first:stop, b] = sums
        result[first:stop] *= SCALE / np.maximum(1, np.bincount(text, minlength=stop - first))[:, None]
    return result + weights[-1]


def _train(bits: int, codewords: np.ndarray, names: list[str]):
    """Adaptive gradient descent on the logistic loss of all bits of a group."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first, stop = key[0].as_py() * 8, min(codewords.shape[1], key[0].as_py() * 8 + 8)
        target = codewords[:, first:stop].astype(float)
        rows = rows.sort_by([("turn", "ascending"), ("lang", "ascending")])
        labels = [names.index(x) for x in rows.column("lang").to_pylist()]
        examples = []
        for text in rows.column("text").to_pylist():
            data, offsets = flat(pa.array([text]))
            place, _ = places(data, offsets, bits)
            place, count = np.unique(place, return_counts=True)
            examples.append((np.append(place, 1 << bits), np.append(SCALE * count / max(1, count.sum()), 1.0)))
        w, g2 = np.zeros(((1 << bits) + 1, stop - first)), np.full(((1 << bits) + 1, stop - first), 1e-6)
        for _ in range(EPOCHS):
            for (i, x), y in zip(examples, labels):
                m = target[y] * (x @ w[i])
                g = x[:, None] * (-target[y] / (1 + np.exp(np.clip(m, -30, 30))))
                g2[i] += g * g
                w[i] -= RATE * 0.1 * g / np.sqrt(g2[i])
        return pa.table(
            {
                "first": pa.array([first], pa.int32()),
                "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()),
            }
        )

    return run


class Model:
    def __init__(self, names: list[str], codewords: np.ndarray, weights: np.ndarray):
        self.names, self.codewords, self.weights = names, codewords, weights

    def decode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, its probability, and whether the second best comes near."""
        m = margins(texts, self.weights)
        loss = np.logaddexp(0, -m[:, None, :] * self.codewords[None]).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top, 3 * second >= top


def train(examples: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from at most `per_language` rows of each language; None without any row."""
    ship(examples.sparkSession)
    rows = examples.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("turn")
    )
    # the hash of the last text wanted of each language is found without the texts; copies count once. A language that
    # fills the table is cut down in SALTS parts first, so at most SALTS * per_language hashes meet in one task
    chosen = rows.select("lang", "turn").distinct().withColumn("salt", F.pmod("turn", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("turn"))
        chosen = chosen.withColumn("k", number).filter(F.col("k") <= per_language)
    last = {r["lang"]: r["turn"] for r in chosen.groupBy("lang").agg(F.max("turn").alias("turn")).collect()}
    names = sorted(last)
    if not names:
        return None
    cuts = examples.sparkSession.createDataFrame([(x, last[x]) for x in names], "lang string, cut long")
    sample = rows.join(F.broadcast(cuts), "lang").filter(F.col("turn") <= F.col("cut")).drop("cut")
    sample = sample.dropDuplicates(["lang", "turn"])
    # one group of eight bits per task; the sample is bounded, so each may read it whole
    codewords = code(len(names))
    groups = -(-codewords.shape[1] // 8)
    weights = np.zeros(((1 << BITS) + 1, codewords.shape[1]), dtype=np.float32)
    if groups:
        dealt = sample.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        learnt = dealt.groupBy("group").applyInArrow(_train(BITS, codewords, names), "first int, weights binary")
        for row in learnt.collect():
            part = np.frombuffer(row["weights"], np.float32).reshape(len(weights), -1)
            weights[:, row["first"] : row["first"] + part.shape[1]] = part
    return Model(names, codewords, weights)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.names, "und"])
        for batch in batches:
            best, top, unsure = model.decode(batch.column("text"))
            worded = np.array(batch.column("_worded").to_pylist(), dtype=bool)
            kept = batch.drop_columns(["text", "_worded"])
            found = {
                "lang_pred": pa.array(names[np.where(worded, best, len(names) - 1)], pa.string()),
                "score": pa.array(np.where(worded, top, 0.0), pa.float64()),
                "ambiguous": pa.array(worded & unsure, pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([*kept.columns, *found.values()], names=[*kept.schema.names, *found])

    return run


def predicted(df: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred, score and ambiguous."""
    if model is None:
        nothing = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")]
        return df.select(*keep, *nothing)
    worded = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = df.select(*keep, F.col(text).alias("text"), worded.alias("_worded"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return mapped(rows, _predict(model), schema + ", lang_pred string, score double, ambiguous boolean")


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    model = train(docs.filter("NOT held_out"))
    return predicted(docs, model, ["doc_id", "held_out"])
