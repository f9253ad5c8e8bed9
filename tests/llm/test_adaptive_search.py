import math
import random

import numpy as np
import pytest

from candlewick.llm import adaptive_search as search
from candlewick.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, step=50, most=5):
    """All neighbours in order: query_id -> [(vec_id, cosine)]."""
    kept = {}
    for key, vector, *_ in rows:
        if key is None or not vector or any(x is None or not math.isfinite(x) for x in vector) or not 0 < sum(x * x for x in vector) < math.inf:
            continue
        kept[key] = min(kept.get(key, vector), vector)
    found = {}
    for key, vector in kept.items():
        if key % step:
            continue
        a = np.array(vector)
        scored = []
        for other, w in kept.items():
            if other != key and len(w) == len(vector):
                b = np.array(w)
                scored.append((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 12), other))
        found[key] = [(i, -s) for s, i in sorted(scored)[:most]]
    return found


def got(spark, rows, **more):
    found = {}
    for r in search.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id % 50 = 0", **more).orderBy("query_id", "rank").collect():
        place = found.setdefault(r["query_id"], [])
        assert r["rank"] == len(place) + 1
        place.append((r["vec_id"], round(r["score"], 12)))
    return found


def clustered(seed, n, size=24, clusters=12, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return [(i, (centres[i % clusters] + spread * rng.normal(size=size)).tolist(), "x") for i in range(n)]


def odd(size):
    one = [1.0] * size
    return [
        (None, one, ""), (100_000, None, ""), (100_050, [], ""), (100_100, [0.0] * size, ""), (100_150, [math.nan] + one[1:], ""),
        (100_200, [None, *one[1:]], ""), (100_250, [-math.inf, *one[1:]], ""), (100_300, [1e200] * size, ""),
    ]


def share(found, want):
    assert found.keys() == {k for k, v in want.items() if v}
    assert all(len(found[k]) == len(v) for k, v in want.items() if v)
    scores = {k: dict(v) for k, v in want.items()}
    pairs = [(k, i) for k, v in want.items() for i, _ in v]
    for k, v in found.items():
        assert [x for x in v if x[0] in scores[k]] == [x for x in want[k] if x[0] in dict(v)]  # same scores, same order
    return sum(i in dict(found.get(k, [])) for k, i in pairs) / len(pairs)


def test_recall_on_clusters_and_on_noise(spark):
    for spread in (0.4, 50.0):
        rows = clustered(1, 1500, spread=spread) + odd(24)
        assert share(got(spark, rows), brute(rows)) >= 0.9


def test_few_lists_are_probed_where_vectors_cluster():
    vectors = np.array([v for _, v, _ in clustered(2, 3000, spread=0.05)])
    near = search.Model.fit(vectors, 3000, 6)
    noise = search.Model.fit(np.random.default_rng(3).normal(size=(3000, 24)), 3000, 6)
    assert near.probes <= len(near.centroids) // 4 < noise.probes


def test_sample_smaller_than_the_table(spark, monkeypatch):
    monkeypatch.setattr(search, "SAMPLE", 300)
    rows = clustered(4, 1500)
    assert share(got(spark, rows), brute(rows)) >= 0.9


def test_copies_ties_and_repeated_rows(spark):
    """A third of the rows is one vector; ids repeat with other vectors; ties go to the smaller id."""
    rows = clustered(5, 600)
    rows += [(2_000 + i, rows[3][1], "") for i in range(300)] + [rows[10], rows[50], (50, [9.0] * 24, ""), (51, [9.0] * 24, "")]
    want = brute(rows)
    found = got(spark, rows)
    assert share(found, want) >= 0.9
    assert found[2_100] == want[2_100] == [(i, 1.0) for i in (3, 2_000, 2_001, 2_002, 2_003)]
    assert [i for i, _ in found[2_000]] == [3, 2_001, 2_002, 2_003, 2_004]


def test_several_lengths_and_fewer_candidates_than_wanted(spark):
    rows = clustered(6, 200) + [(50_000, [1.0, 0.5], ""), (50_001, [0.5, 1.0], ""), (50_050, [2.0], ""), (50_051, [-2.0, 1.0], "")]
    found, want = got(spark, rows), brute(rows)
    assert found[50_000] == want[50_000] and 50_050 not in found
    assert share(found, want) >= 0.9


def test_waves_and_other_numbers(spark, monkeypatch):
    rows = clustered(7, 700)
    once = got(spark, rows, most=2)
    monkeypatch.setattr(search, "WAVE", 3)
    assert got(spark, rows, most=2) == once
    assert {len(v) for v in once.values()} == {2}


def test_scan_gives_up_far_candidates_only():
    rng = np.random.default_rng(8)
    queries, candidates = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(40, 96)), rng.normal(size=(800, 96))))
    candidates[:40] = queries + 0.02 * rng.normal(size=(40, 96))
    true = ((queries[:, None] - candidates[None]) ** 2).sum(axis=2)
    bounds = np.full(40, 0.3)
    q, x = search.scan(queries.astype(np.float32), np.ascontiguousarray(candidates.T.astype(np.float32)), bounds)
    assert set(zip(q, x)) == set(zip(*np.nonzero(true <= 0.3)))


def test_empty_tables(spark):
    for rows in ([], odd(3), [(1, [1.0, 2.0], "")]):
        assert got(spark, rows) == {}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_query(spark, tmp_path, kind):
    rows = clustered(9, 400)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", search.F.col("embedding").cast(f"array<{kind}>"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    found = QUERIES["op11_nearest_neighbours"](spark, str(tmp_path))
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    table = {}
    for r in found.orderBy("query_id", "rank").collect():
        table.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    assert share(table, brute(rows)) >= 0.9
