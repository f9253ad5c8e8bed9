"""The registered queries over small tables, held against their contracts in plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import language_id, quality_classifier
from candlewick.llm.queries import QUERIES
from test_corpus_models import katz
from test_duplicates import classes
from test_tokens_and_packing import plain
from test_words_and_rules import measures
from texts import ODD, frame, prose, words

RNG = random.Random(11)
PASSAGE = prose(RNG, 90, 5000)


def corpus():
    """(doc_id, text) with copies, a near copy, a shared passage, a long text and all odd texts; some rows repeat."""
    texts = [prose(RNG, RNG.randint(20, 200), 5000) for _ in range(24)]
    near = texts[1].split(" ")
    near[3] = "changed"
    texts += [texts[0], texts[0], " ".join(near), texts[2] + " " + PASSAGE, PASSAGE + " " + texts[3]]
    texts += [" ".join(prose(RNG, 40, 5000) for _ in range(200)), *ODD]
    return [(7 * i, t) for i, t in enumerate(texts)]


PAIRS = corpus()
TEXT = dict(PAIRS)
ITEM = " ".join(TEXT[35].split(" ")[2:18])


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, PAIRS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(k % 3 > 0), 0) for k, (i, _) in enumerate(PAIRS)] + [(-1, 1, 0), (0, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, ITEM), (2, prose(RNG, 20, 9) + " not there"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    html = "<html><body><nav><a href=/>Menu</a></nav><article><h1>Head</h1><p>One &amp; long\n text of an article.</p></article></body></html>"
    pages = [(1, "u1", html), (2, "u2", None), (3, "u3", ""), (3, "u3", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def result(spark, tables, name):
    return QUERIES[name](spark, tables).collect()


def test_decontamination(spark, tables):
    got = result(spark, tables, "op1_decontamination")
    assert {(r["doc_id"], r["item_id"]) for r in got if r["containment"] == 1} == {(35, 1)}


def ids(text, end):
    return [*plain(text), end]


def test_packing(spark, tables):
    places, pieces = defaultdict(list), defaultdict(list)
    for r in result(spark, tables, "op2_packing"):
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for place in places.values():
        place.sort()
        assert [o for o, _ in place] == np.cumsum([0, *(n for _, n in place)])[:-1].tolist()
        assert sum(n for _, n in place) <= 1024
    assert pieces.keys() == TEXT.keys()
    for i, found in pieces.items():
        want = ids(TEXT[i], 2)
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found)))
        assert [r["start"] for r in found] == np.cumsum([0, *(r["length"] for r in found)])[:-1].tolist()
        assert sum(r["length"] for r in found) == len(want)
        assert all(r["length"] == 1024 for r in found[1:])
        for r in found:
            piece = np.array(want[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes())


def test_quality_classifier(spark, tables):
    got = result(spark, tables, "op3_quality_classifier")
    assert sorted(r["doc_id"] for r in got) == sorted(TEXT)
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    same = {r["score"] for r in got if TEXT[r["doc_id"]] in (None, "", " ")}
    assert len(same) == 1


def test_leader_against_plain_updates():
    rng = random.Random(5)
    q = quality_classifier
    places = [np.array(sorted(rng.sample(range(8), 3)) + [8]) for _ in range(40)]
    values = [np.array([rng.random() for _ in range(3)] + [1.0]) for _ in places]
    labels = np.array([int(0 in p) for p in places])
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= q.L1:
            return 0.0
        return -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(3):
        for place, value, label in zip(places, values, labels):
            old = {i: weight(i) for i in place}
            p = 1 / (1 + math.exp(-sum(old[i] * x for i, x in zip(place, value))))
            for i, x in zip(place, value):
                g = (p - label) * x
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
                z[i] += g - sigma * old[i]
                n[i] += g * g
    assert q.leader(places, values, labels, 3, 3) == pytest.approx([weight(i) for i in range(9)])


def test_language_id(spark, tables):
    got = result(spark, tables, "op4_language_id")
    assert sorted(r["doc_id"] for r in got) == sorted(TEXT)
    for r in got:
        text = TEXT[r["doc_id"]] or ""
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("en" if any(c.isalpha() for c in text) else "und")


def test_decoding_by_enumeration():
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "d"]
    code = language_id.code(4)
    weights = rng.normal(size=((1 << language_id.BITS) + 1, code.shape[1])).astype(np.float32)
    texts = pa.array(["some words", "autre chose ici", "x", "ganz anderes"])
    best, top, _ = language_id.Model(names, code, weights).decode(texts)
    for m, b, p in zip(language_id.margins(texts, weights), best, top):
        loss = [sum(math.log1p(math.exp(-float(x) * int(bit))) for x, bit in zip(m, row)) for row in code]
        assert b == loss.index(min(loss))
        assert p == pytest.approx(math.exp(-min(loss)) / sum(math.exp(-x) for x in loss), rel=1e-4)


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_language_sample_is_the_same_however_it_is_cut_down(spark, monkeypatch, salts):
    df = frame(spark, [(2 * i + 1, f"word {i} " + "abc"[i % 3] * 3) for i in range(60)] * 2)
    want = language_id.train(df, per_language=7).weights
    monkeypatch.setattr(language_id, "SALTS", salts)
    assert np.array_equal(language_id.train(df, per_language=7).weights, want)


def test_token_output(spark, tables):
    got = sorted(result(spark, tables, "op5_token_output"), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(TEXT)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    for r in got:
        want = ids(TEXT[r["doc_id"]], 0)
        assert r["n_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())


def test_quality_rules(spark, tables):
    got = result(spark, tables, "op6_quality_rules")
    assert sorted(r["doc_id"] for r in got) == sorted(TEXT)
    for r in got:
        n, chars, symbols, lines, repeats = measures(TEXT[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_html_extraction(spark, tables):
    got = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in result(spark, tables, "op7_html_extraction"))
    text = "Head\n\nOne & long text of an article."
    assert got == [(1, "u1", text, len(text)), (2, "u2", "", 0), (3, "u3", "", 0), (3, "u3", "", 0)]


def test_lm_scoring(spark, tables):
    tokens, ones, probability, _, _ = katz(PAIRS, lambda i: crc(i, 7) == 2)
    total, kinds = sum(ones.values()), len(ones)
    got = result(spark, tables, "op8_lm_scoring")
    assert sorted(r["doc_id"] for r in got) == sorted(TEXT)
    for r in got:
        t = tokens[r["doc_id"]]
        assert r["held_out"] == (crc(r["doc_id"], 7) == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in ones for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((ones.get(w, 0) + 1) / (total + kinds + 1)) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(probability(h, w)) for h, w in zip(["<s>", *t], t)))


def test_jaccard_join(spark, tables):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, tables, "op9_jaccard_join")}
    assert got == classes(PAIRS, 3, 90)
    assert got[7 * 24][1] == got[7 * 25][1] == 0 and all(words(TEXT[i]) or n == 0 for i, (n, _) in got.items())


def test_suffix_dedup(spark, tables):
    data = {i: (t or "").encode() for i, t in PAIRS}
    times = Counter(d[a : a + 200] for d in data.values() for a in range(len(d) - 199))
    got = result(spark, tables, "op10_suffix_dedup")
    assert sorted(r["doc_id"] for r in got) == sorted(TEXT)
    for r in got:
        d = data[r["doc_id"]]
        gone = np.zeros(len(d) + 1, bool)
        for a in range(len(d) - 199):
            if times[d[a : a + 200]] > 1:
                gone[a : a + 200] = True
        runs = int((gone[:-1] & ~gone[1:]).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(d), int(gone.sum()), runs)
        assert r["kept_sha256"] == hashlib.sha256(np.frombuffer(d, np.uint8)[~gone[:-1]].tobytes()).hexdigest()
    assert sum(r["n_removed"] for r in got) > 0
