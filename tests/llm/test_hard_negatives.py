import math
import random

import numpy as np
import pytest

from candlewick.llm import hard_negatives as hn
from candlewick.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, norm string"


def brute(rows, step=100):
    """The contract, row by row in Python integers."""
    kept = {}
    for key, vector, label, *_ in rows:
        if key is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in whole) > 1 << 62:
            continue
        row = ((label + 1) % 10 if key % 7 == 0 else label, whole)
        kept[key] = min(kept.get(key, row), row)
    found = []
    for key, (label, vector) in kept.items():
        if key % step:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, v)), i, l == label)
            for i, (l, v) in kept.items()
            if i != key and len(v) == len(vector)
        ]
        scored.sort()
        for p, i, _ in [x for x in scored if x[2]][:5]:
            band = [(n, j) for n, j, same in scored if not same and 80 * -p <= 100 * -n <= 100 * -p]
            found += [(key, i, k + 1, j, -p, -n) for k, (n, j) in enumerate(band[:5])]
    return sorted(found)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    label = hn.F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    return sorted(map(tuple, hn.hard_negatives(hn.quantised(df, label), "vec_id % 100 = 0", **more).collect()))


def table(seed, n, scale=1.0, labels=3, size=6):
    rng = random.Random(seed)
    rows = [(i * 20, [rng.gauss(0.3, 1) * scale for _ in range(size)], rng.randrange(labels), "x") for i in range(n)]
    rows += [(9_000 + i, rows[4][1], i % labels, None) for i in range(30)]  # a group of copies, all ties
    rows += [(None, [1.0] * size, 1, ""), (1, None, 1, ""), (2, [], 1, ""), (3, [1.0] * size, None, "")]
    rows += [(200, [1.0, math.nan] + [1.0] * (size - 2), 1, ""), (4, [None] * size, 1, ""), (5, [math.inf] * size, 1, "")]
    rows += [rows[7], rows[8], (rows[8][0], [5.0] * size, 0, "other"), (400, [2.0, 1.0], 1, ""), (401, [2.0, 1.5], 1, ""), (402, [2.0, 1.0], 2, "")]
    return rows


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e6])  # fields of 32, 64 and 128 bits
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    rows = table(1, 80, scale)
    want = brute(rows)
    assert len(want) > 40 and got(spark, rows) == want
    assert got(spark, rows, wave=2) == want


def test_wide_fields_are_used():
    for largest, words in ((300, 1), (1 << 17, 2), (1 << 30, 4)):
        rng = np.random.default_rng(2)
        values = rng.integers(-largest, largest, (50, 9))
        packed, anchor = hn.Packed(values, largest), hn.Anchor(1, 1, values[3])
        assert packed.words == words
        assert packed.scores(anchor).tolist() == [sum(int(a) * int(b) for a, b in zip(values[3], v)) for v in values]


def test_negative_scores_zero_vectors_and_one_label(spark):
    rows = [(i, [-1.0, 0.5 * i], i % 2, "") for i in range(0, 400, 50)] + [(7, [0.0, 0.0], 1, ""), (8, [0.0, 0.0], 0, "")]
    assert got(spark, rows) == brute(rows)
    alone = [(i, [1.0, i / 100], 1, "") for i in range(1, 300, 9) if i % 7] + [(100, [1.0, 1.0], 1, "")]
    assert got(spark, alone) == brute(alone) == []


def test_too_large_rows_take_no_part(spark):
    rows = table(3, 20) + [(11, [1e300] * 6, 1, ""), (12, [1e9] + [0.0] * 5, 1, "")]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    found = hn.hard_negatives(hn.quantised(df), "vec_id % 100 = 0")
    assert found.columns == hn.COLUMNS and found.collect() == []


def test_query(spark, tmp_path):
    rows = table(4, 60)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    assert dict(found.dtypes) == {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
        "positive_score": "bigint", "negative_score": "bigint",
    }
    assert sorted(map(tuple, found.collect())) == brute(rows)
