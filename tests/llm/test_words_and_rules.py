from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import quality_rules as rules
from candlewick.llm.textarrays import Hasher, flat, shingles, word_hashes
from texts import frame, rows, words


def measures(text):
    found = words(text, lower=False)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


def test_word_hashes_and_shingles():
    texts = [t for _, t in rows()]
    hashes, owner, n = word_hashes(pa.array(texts))
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert n == len(texts) and owner.tolist() == [i for i, _ in want]
    assert len(set(hashes.tolist())) == len({w for _, w in want})
    for size in (1, 3, 5):
        _, text = shingles(hashes, owner, n, size)
        for i, t in enumerate(texts):
            w = words(t)
            grams = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
            assert (text == i).sum() == len(grams)


def test_substring_hashes():
    data, _ = flat(pa.array(["abcabcab", "abc"]))
    h = Hasher(data)(np.array([0, 3, 8, 1]), np.array([3, 6, 11, 4]))
    assert h[0] == h[1] == h[2] != h[3]


def test_measures_against_brute_force(spark):
    pairs = rows()
    got = {r["doc_id"]: r for r in rules.ledger(frame(spark, pairs)).collect()}
    for i, text in pairs:
        assert tuple(got[i][m] for m in rules.MEASURES[:5]) == measures(text), text


def test_policies_and_ablation(spark):
    ledger = rules.ledger(frame(spark, rows())).cache()
    kept = rules.verdicts(ledger, rules.BASE).collect()
    assert all(r["kept"] == (r["failed"] & 3 == 0) for r in kept)
    table = {(r["policy"], r["rule"]): r for r in rules.ablation(ledger).collect()}
    bits = [r["failed"] for r in kept]
    for policy in rules.POLICIES:
        for rule in (r for r in rules.RULES if r.name in policy.rules):
            row, bit = table[policy.name, rule.name], 1 << rule.bit
            assert row["documents"] == len(bits)
            assert row["rejected"] == sum(bool(b & bit) for b in bits)
            assert row["rejected_alone"] == sum(b & policy.mask == bit for b in bits)
            assert row["kept_without"] == sum(not b & policy.mask & ~bit for b in bits)


def test_empty_table_clashing_and_repeated(spark):
    df = frame(spark, [(1, "a b c")] * 3 + [(None, None)]).withColumn("n_words", rules.F.lit(-1))
    got = rules.ledger(df, keep=["doc_id", "n_words"]).collect()
    assert sorted(r["n_words"] for r in got) == [0, 3, 3, 3]
    assert rules.verdicts(rules.ledger(df.limit(0))).count() == 0
    assert rules.verdicts(rules.ledger(df)).filter("kept").count() == 0
    assert rules.ablation(rules.ledger(df.limit(0))).count() == 0


@pytest.mark.parametrize("text, rule", [("Word%% " * 60, "symbols"), ("NO! " * 60, "exclamations"), ("abc\n" * 60, "repeated_lines")])
def test_rules_catch(spark, text, rule):
    bit = next(1 << r.bit for r in rules.RULES if r.name == rule)
    assert rules.ledger(frame(spark, [(1, text)])).head()["failed"] & bit


def test_regular_and_long_words_have_hashes_of_their_own():
    """The word of Thue and Morse and its complement have one value under any polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    regular = ["".join("ab"[b ^ flip] for b in bits[:n]) for n in (64, 128, 256, 1024, 4096) for flip in (0, 1)]
    lengths = ["x" * n for n in [*range(1, 40), 255, 256, 257, 100_000]] + ["x" * 99_999 + "y", "\0", "\0\0", "\0" * 9]
    texts = [*regular, *lengths]
    hashes, owner, _ = word_hashes(pa.array(texts))
    assert owner.tolist() == list(range(len(texts)))
    assert len(set(hashes.tolist())) == len(texts)
    again, _, _ = word_hashes(pa.array(["some text before", " ".join(texts), None]))
    assert again[3:].tolist() == hashes.tolist()
