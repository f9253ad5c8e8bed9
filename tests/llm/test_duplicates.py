import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import common, jaccard_join, suffix_dedup
from candlewick.llm.tokens import encoder, vocabulary_path
from texts import frame, prose, rows, words


def sets_of(pairs, size):
    found = {}
    for i, t in pairs:
        w = words(t)
        found[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    return found


def classes(pairs, size, percent):
    sets = sets_of(pairs, size)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, n=12, sizes=12):
    """Families of near copies with few and many changes, and a passage that all texts begin with."""
    rng = random.Random(seed)
    opening, pairs = prose(rng, 30, 900), []
    for _ in range(n):
        base = prose(rng, rng.randint(60, 150), 3000).split(" ")
        for _ in range(rng.randint(1, sizes)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
            pairs.append((len(pairs), (opening + " " if rng.random() < 0.5 else "") + " ".join(copy)))
    return pairs


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_jaccard_components_against_brute_force(spark, small_blocks, seed, size, percent):
    pairs = families(seed) + [(i + 1000, t) for i, t in rows(seed)]
    got = jaccard_join.joined(frame(spark, pairs), size=size, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes(pairs, size, percent)
    assert len(got) == len(pairs)


def test_jaccard_edge_cases(spark):
    df = frame(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None), (8, ""), (9, "A B C D")])
    got = Counter(tuple(r) for r in jaccard_join.joined(df.withColumn("n", jaccard_join.F.lit(1))).collect())
    assert got == Counter({(None, 2, None): 1, (5, 2, 5): 2, (7, 0, 7): 1, (8, 0, 8): 1, (9, 2, 5): 1})
    assert jaccard_join.joined(df.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "7", "8", "None"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(300, 400), 300) for _ in range(30)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        assert a == b or got[a] == got[b] == (0 if a <= 40 else 100 if a < 200 else 300)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(pairs, length):
    bodies = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    result = []
    for i, b in bodies:
        covered = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                covered[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        result.append((i, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return result


@pytest.mark.parametrize("length, gram", [(200, 12), (30, 5), (13, 12), (12, 12), (300, 12), (700, 30)])
def test_repeats_against_brute_force(spark, monkeypatch, length, gram):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2_000)
    pairs = rows(4) + [(i + 1000, t) for i, t in families(5, 6, 8)] + [(None, "abc" * 90), (2, "abc" * 70)]
    got = suffix_dedup.deduplicated(frame(spark, pairs), length=length, gram=gram).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, repeats(pairs, length)))


def test_intervals_end_in_single_offsets():
    for length in (13, 30, 200, 255):
        levels = suffix_dedup.intervals(length, 12)
        assert [(a, b) for _, a, b in levels[-1]] == [(i, i) for i in range(length - 11)]


def test_text_without_repeats(spark):
    rng = random.Random(6)
    passage, own = prose(rng, 80, 5000), [prose(rng, 40, 9000) for _ in range(3)]
    pairs = [(1, own[0] + " " + passage), (2, passage + " " + own[1]), (3, own[2]), (4, passage), (5, ""), (6, None)]
    df = frame(spark, pairs)
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert got[1]["text"].strip() in own[0] and got[2]["text"].strip() in own[1] and got[3]["text"] == own[2]
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
    assert suffix_dedup.without_repeats(df).columns == df.columns
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0


def test_an_id_with_several_texts_keeps_the_links_of_each(spark):
    """Id 1 has two texts, each with a near copy under another id: all three are linked, whichever row comes first."""
    rng = random.Random(9)
    a, b = prose(rng, 120, 4000), prose(rng, 120, 4000)
    near = [" ".join([*x.split(" ")[:-1], "changed"]) for x in (a, b)]
    pairs = [(1, a), (1, b), (2, near[0]), (3, near[1]), (4, prose(rng, 120, 4000)), (5, near[0] + " more"), (0, prose(rng, 50, 4000))]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.joined(frame(spark, pairs)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (0, 0)}


def test_blocks_give_back_the_encoders_of_earlier_stages():
    docs = pa.table({"block": pa.array([0], pa.int32()), "doc_id": [1], "text": ["one two three four"]})
    asked = jaccard_join._ask(3, 1)
    answers = jaccard_join._answer(asked(docs))
    levels = suffix_dedup.intervals()
    for step in (
        lambda: asked(docs),
        lambda: jaccard_join._prefixes(3, 1, 90)(docs, answers),
        lambda: suffix_dedup._step(0, 1, suffix_dedup.LENGTH, suffix_dedup.GRAM, levels, False, False)(docs, None),
    ):
        assert len(encoder(vocabulary_path()).encode(docs["text"].combine_chunks())[0]) == 4
        step()
        assert encoder.cache_info().currsize == 0
    assert len(encoder(vocabulary_path()).encode(docs["text"].combine_chunks())[0]) == 4
