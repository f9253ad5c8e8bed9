import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import packing, range_coder, token_files
from candlewick.llm.tokens import encoder, vocabulary_path
from texts import frame, rows

HARD = [
    "a  b", "a   b ", " x", "  x\n  y", "<|endoftext|> a<|endoftext|>b  c", "x  <|endoftext|>", "x\n b\t c", "tab\t\t x",
    "don't  ", "\n\n b", "end ", "   ", "12 34,56 $$$ x", " 　 y", "a\x85 \x85b", "a\x1c b \x1c c", "a\xa0 b", "foo\n \nbar",
]


def plain(text):
    return encoder(vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_the_library():
    texts = HARD + [t for _, t in rows()] + HARD
    ids, offsets = encoder(vocabulary_path()).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain(text), repr(text)
    assert encoder(vocabulary_path()).encode(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_plan_uses_everything_once_and_nearly_fills(n):
    rng = random.Random(n)
    lengths = [rng.randint(1, 1024) for _ in range(n)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    bins = packing.plan(counts)
    used = {}
    for times, chosen in bins:
        assert sum(k * c for k, c in chosen.items()) <= 1024 and times > 0
        for k, c in chosen.items():
            used[k] = used.get(k, 0) + times * c
    assert used == counts
    # no packing can beat total size or the pieces longer than half
    bound = max(-(-sum(lengths) // 1024), sum(x > 512 for x in lengths))
    assert sum(t for t, _ in bins) <= bound * 1.02 + 1


def check_pieces(pairs, got):
    sequences = {}
    by_doc = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in pairs:
        ids = np.array([*plain(text), 2], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == 1024 or k == 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    pairs = [*rows(), (5000, "long words here " * 2000)]
    df = frame(spark, pairs)
    check_pieces(pairs, packing.packed(df).collect())
    assert packing.packed(df.limit(0)).count() == 0
    twice = packing.packed(df.unionAll(df).withColumn("length", packing.F.lit(1))).collect()
    assert len(twice) == 2 * packing.packed(df).count()
    places = packing.placed(packing.store(packing.pieces(df, with_ids=True), "p"))
    ids = [x for r in packing.sequences(places).collect() for x in r["ids"]]
    assert len(ids) == sum(len(plain(t)) + 1 for _, t in pairs)


@pytest.mark.parametrize("size", [7, 100, 8192])
def test_range_coder_round_trip(size):
    rng = np.random.default_rng(size)
    for ids in (
        np.zeros(0, int), np.array([50256]), np.array([0, 15, 16, 17, range_coder.LARGEST_ID] * 3), np.zeros(3000, int),
        rng.integers(0, 50257, 2500), np.tile([1, 2, 3], 900), rng.zipf(1.3, 2500) % 50257,
    ):
        assert (range_coder.decode(range_coder.encode(ids, size)) == ids).all()


def test_range_coder_compresses_and_detects_damage():
    ids = np.random.default_rng(1).zipf(1.5, 20_000) % 50257
    file = bytearray(range_coder.encode(ids))
    assert len(file) < 1.5 * len(ids)
    for at in (3, 14, 40, len(file) // 2):
        bad = bytearray(file)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode(bytes(bad))
    with pytest.raises(ValueError):
        range_coder.decode(bytes(file[:-100]))
    with pytest.raises(ValueError):
        range_coder.encode([1 << 18])


def test_token_files(spark):
    pairs = [*rows(), (None, "no id"), (1, "same id again")]
    df = frame(spark, pairs).withColumn("file", packing.F.lit(0))
    files = token_files.write(df, size=3000)
    assert files.count() > 3
    got = token_files.read(files).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    want = sorted(zlib.crc32(np.array([*plain(t), 0], dtype="<u4").tobytes()) for _, t in pairs)
    assert sorted(r["ids_crc32"] for r in got) == want
    assert token_files.read(token_files.write(df.limit(0))).count() == 0
