"""Texts for the tests: prose from a small vocabulary, copies, near copies, odd cases."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\n", "word", "two words", "a\tb\x0bc", "é", "日本 語 日本 語", "x" * 3000, "ab " * 900,
    "%%% ###", "A a A a A a", "line\nline\nline\nother", "<|endoftext|> a  b   c ",
]


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % words}" + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(seed=1, n=40):
    """(doc_id, text): prose with exact copies, near copies and shared passages, and all odd texts."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 160))
        if i % 5 == 0:
            text += " " + passage + " " + prose(rng, rng.randint(0, 30))
        if i % 7 == 3:
            text = texts[-1]
        if i % 7 == 4:
            words = texts[-1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        texts.append(text)
    texts += ODD
    return [(3 * i + 1, text) for i, text in enumerate(texts)]


def frame(spark, pairs):
    return spark.createDataFrame(
        [(i, t, "en" if i is None or i % 2 else None, "s", None if t is None else len(t)) for i, t in pairs], SCHEMA
    )


def words(text, lower=True):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)
