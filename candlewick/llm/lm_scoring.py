"""Scoring of texts by a Katz bigram model that is counted from the corpus itself.

A token is a lower-case word or the end of a text. The model's probability of a token after its context is

    d(r) * r / c(h)            if the pair was seen r times in training, c(h) times the context
    alpha(h) * p(w)            if it was not, p being the unigram model, evaluated in the same way one level down
    p(w)                       if the context was never seen

with Good-Turing discounts d for counts up to five. Below unigrams stands one unknown word with the mass they leave.
alpha(h) is what the discounts leave of a context, divided by the unigram mass of the words not seen after it: the
probabilities of all V words and the unknown one add up to one in every context. A context without discounted counts
reserves one count, c(h) + 1 becoming its denominator.

The counts live in tables partitioned by ranges of the context's hash, packed as arrays. Texts are dealt into blocks of
bounded size; a block asks every range, in one array, for the distinct pairs it holds, and the answer comes back in the
same order, so a pair crosses the network once per block instead of once per token, and not at all if its context
occurs in no other block. A range counts the training shares of
what it was asked and answers with the counts; what the discounts need (counts of counts) is added up from all answers.
Contexts with more than a thousandth of all tokens, at most a thousand, are spread over all ranges by their next word,
and their sums are gathered apart. What is moved grows with the distinct pairs of the corpus; nothing goes through the
driver.

Words are told apart by 64-bit hashes. Null or empty texts consist of their end. Rows with a null id count as training rows. Repeated
rows are counted and scored each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import blocks, documents, ship
from candlewick.llm.exchange import planes as pack
from candlewick.llm.exchange import ranges_of
from candlewick.llm.exchange import unplanes as unpack
from candlewick.llm.textarrays import mix, word_hashes

HIGHEST = 5  # counts above are taken as they are
HOT_SHARE = 1000  # a context with more than one in so many tokens is spread
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
STATS = 2 + HIGHEST + 1  # sum, types, types by count 1 .. HIGHEST + 1
FOR_ALL = 10  # added to the kind of a row that is meant for all blocks
SUMS = 2 * (1 + HIGHEST)  # per context: high counts and types by count of its pairs, then of its next words


def statistics(counts: np.ndarray) -> np.ndarray:
    """Sum, number of types, and numbers of types with count 1 to HIGHEST + 1."""
    seen = counts[counts > 0].astype(np.int64)
    by = np.bincount(np.minimum(seen, HIGHEST + 2), minlength=HIGHEST + 3)
    return np.concatenate([[seen.sum(), len(seen)], by[1 : HIGHEST + 2]]).astype(np.int64)


def discounts(stats: np.ndarray) -> np.ndarray:
    """d(0) .. d(HIGHEST); for fewer counts, or none, where the counts of counts give no valid discounts."""
    n = np.concatenate([[0], stats[2:]]).astype(float)
    for k in range(HIGHEST, 0, -1):
        if (n[1 : k + 2] <= 0).any():
            continue
        r = np.arange(1, k + 1)
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        d = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - common) / (1 - common)
        if ((d > 0) & (d <= 1)).all():
            return np.concatenate([[0], d, np.ones(HIGHEST - k)])
    return np.concatenate([[0], np.ones(HIGHEST)])


class Unigrams:
    """Probabilities by count; the unknown word, count 0, has what the others leave."""

    def __init__(self, stats: np.ndarray):
        self.total = int(stats[0])
        self.d = discounts(stats)
        low = (self.d[1:] * np.arange(1, HIGHEST + 1) * stats[2 : 2 + HIGHEST]).sum()
        high = self.total - (np.arange(1, HIGHEST + 1) * stats[2 : 2 + HIGHEST]).sum()
        left = self.total - low - high
        self.size = self.total if left > 1e-9 * max(1, self.total) else self.total + 1
        self.unknown = (self.size - low - high) / self.size

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        p = counts * self.d[np.minimum(counts, HIGHEST)] / self.size
        p = np.where(counts > HIGHEST, counts / self.size, p)
        return np.where(counts > 0, p, self.unknown)


class Tokens:
    """Tokens of a block: distinct ones as sorted hashes, and their numbers in text order."""

    def __init__(self, docs: pa.Table):
        hashes, owner, n = word_hashes(docs.column("text"))
        self.held = np.array(docs.column("held_out").to_pylist(), dtype=bool)
        ends = np.cumsum(np.bincount(owner, minlength=n))
        self.offsets = np.concatenate([[0], ends + np.arange(1, n + 1)])
        self.words, ids = np.unique(np.insert(hashes, ends, END), return_inverse=True)
        self.ids = ids.astype(np.int64)
        self.owner = np.repeat(np.arange(n), np.diff(self.offsets))
        self.trained = ~self.held[self.owner]
        self.counts = np.bincount(self.ids[self.trained], minlength=len(self.words))

    def pairs(self):
        """Distinct (context, next) as numbers of words, the begin being the last; counts; and the pair of each token."""
        n = len(self.words)
        context = np.concatenate([[n], self.ids[:-1]])
        context[self.offsets[:-1][self.offsets[:-1] < len(self.ids)]] = n
        keys, inverse = np.unique(context * (n + 1) + self.ids, return_inverse=True)
        counts = np.bincount(inverse[self.trained], minlength=len(keys))
        return keys // (n + 1), keys % (n + 1), counts, inverse, context

    def add(self, values: np.ndarray) -> np.ndarray:
        """Sums of the tokens' values by text."""
        return np.add.reduceat(values, self.offsets[:-1]) if len(values) else np.zeros(0)


ASK = "block int, range int, words binary, counts binary"
ANSWER = "block int, range int, kind int, counts binary, stats binary, sums binary, names binary"


def _cuts(of: np.ndarray) -> list[tuple[int, int, int]]:
    """Range, begin and end of the runs of equal ranges."""
    at = _begins(of)
    return list(zip(of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(of)]))


def _ask_words(ranges: int):
    def run(docs: pa.Table) -> pa.Table:
        t = Tokens(docs)
        cuts = _cuts(ranges_of(t.words, ranges))
        counts = t.counts.astype(np.uint32)
        return pa.table(
            {
                "block": pa.array([docs.column("block")[0].as_py()] * len(cuts), pa.int32()),
                "range": pa.array([i for i, _, _ in cuts], pa.int32()),
                "words": pa.array([pack(np.diff(t.words[a:b], prepend=np.uint64(0))) for _, a, b in cuts], pa.binary()),
                "counts": pa.array([pack(counts[a:b]) for _, a, b in cuts], pa.binary()),
            }
        )

    return run


NO_SUMS = np.zeros((SUMS, 0), np.int64)


def _answers(
    table: pa.Table, kind: int, counts: list[bytes], sums: list[bytes], names: list[bytes],
    stats: np.ndarray, hot: np.ndarray = np.zeros(0, np.uint64), hot_sums: np.ndarray = NO_SUMS,
) -> pa.Table:
    """The answers to the blocks, and one row for all of them: statistics, and names and sums of spread contexts."""
    n = len(table)
    return pa.table(
        {
            "block": pa.array([*table.column("block").to_pylist(), -1], pa.int32()),
            "range": pa.array([*table.column("range").to_pylist(), table.column("range")[0].as_py()], pa.int32()),
            "kind": pa.array([kind] * n + [kind + FOR_ALL], pa.int32()),
            "counts": pa.array([*counts, hot.tobytes()], pa.binary()),
            "stats": pa.array([b""] * n + [stats.tobytes()], pa.binary()),
            "sums": pa.array([*sums, hot_sums.astype(np.int64).tobytes()], pa.binary()),
            "names": pa.array([*names, b""], pa.binary()),
        }
    )


def _for_all(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, and names and sums of the spread contexts, added up over the rows for all blocks."""
    rows = [i for i, k in enumerate(answers.column("kind").to_pylist()) if k == kind + FOR_ALL]
    get = lambda c, kind: [np.frombuffer(answers.column(c)[i].as_py(), kind) for i in rows]
    stats = np.sum([np.zeros(STATS, np.int64), *get("stats", np.int64)], axis=0)
    names = np.concatenate([np.zeros(0, np.uint64), *get("counts", np.uint64)])
    sums = np.concatenate([NO_SUMS, *(x.reshape(SUMS, -1) for x in get("sums", np.int64))], axis=1)
    distinct, inverse = np.unique(names, return_inverse=True)
    total = np.zeros((SUMS, len(distinct)), np.int64)
    np.add.at(total, (slice(None), inverse), sums)
    return stats, distinct, total


def _add_up(table: pa.Table) -> pa.Table:
    kind = table.column("kind")[0].as_py() - FOR_ALL
    return _answers(table.slice(0, 1), kind, [b""], [b""], [b""], *_for_all(table, kind)).slice(1)


def _dealt_to_all(answers: DataFrame, blocks: int) -> DataFrame:
    """The rows for all blocks added up, at most HOT_SHARE contexts and the begin, one for each block. No task sees more
    rows than the square root of the number of blocks."""
    hops = math.isqrt(blocks - 1) + 1 if blocks > 1 else 1
    parts = answers.filter("block < 0").withColumn("range", F.pmod("range", F.lit(hops)))
    whole = parts.groupBy("range").applyInArrow(_add_up, ANSWER).groupBy("kind").applyInArrow(_add_up, ANSWER)
    groups = whole.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(hops - 1)))).repartition("range")
    block = F.explode(F.sequence(F.col("range"), F.lit(blocks - 1), F.lit(hops)))
    return groups.withColumn("block", block).select(answers.columns)


def wide(counts: np.ndarray) -> type:
    """Counts over the corpus outgrow 32 bits; as long as they do not, they need no more."""
    return np.uint64 if counts.size and counts.max() >= 1 << 32 else np.uint32


def counts_out(counts: np.ndarray) -> bytes:
    """Counts, row by row if they have several, behind a byte with their width."""
    kind = wide(counts)
    return bytes([np.dtype(kind).itemsize]) + pack(counts.reshape(-1).astype(kind))


def counts_in(raw: bytes) -> np.ndarray:
    """All counts in a row."""
    if not raw:
        return np.zeros(0, np.uint32)
    return unpack(raw[1:], np.uint32 if raw[0] == 4 else np.uint64)


def _answer_words(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        """The training counts of all blocks; in `sums` a bit for each word that occurs in the asking block alone; short
        names, small for frequent words, that stand for the hashes from now on."""
        asked = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("words")]
        counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("counts")])
        distinct, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        blocks_with = np.bincount(inverse, minlength=len(distinct))  # a block asks for a word once
        names = np.empty(len(distinct), np.uint64)
        names[np.lexsort((distinct, -total))] = np.arange(len(distinct), dtype=np.uint64)
        names = names * np.uint64(ranges) + np.uint64(table.column("range")[0].as_py())
        cuts = np.cumsum([0, *map(len, asked)])
        back, alone = total[inverse], blocks_with[inverse] == 1
        pieces = list(zip(cuts, cuts[1:]))
        return _answers(
            table, 1, [counts_out(back[a:b]) for a, b in pieces], [np.packbits(alone[a:b]).tobytes() for a, b in pieces],
            [pack(names[inverse[a:b]]) for a, b in pieces], statistics(total),
        )

    return run


def _rows(answers: pa.Table, kind: int) -> list[int]:
    """Rows of the kind by range."""
    kinds, ranges = answers.column("kind").to_pylist(), answers.column("range").to_pylist()
    return sorted((i for i, k in enumerate(kinds) if k == kind), key=lambda i: ranges[i])


def _word_counts(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training counts and names of the block's words, which of them occur in this block alone, and the statistics."""
    rows = _rows(answers, 1)
    stats, _, _ = _for_all(answers, 1)
    counts = [counts_in(answers.column("counts")[i].as_py()) for i in rows]
    names = [unpack(answers.column("names")[i].as_py(), np.uint64) for i in rows]
    bits = [np.frombuffer(answers.column("sums")[i].as_py(), np.uint8) for i in rows]
    alone = [np.unpackbits(b, count=len(c)).astype(bool) for b, c in zip(bits, counts)]
    return np.concatenate(counts).astype(np.int64), np.concatenate(names), np.concatenate(alone), stats


def _dealt(names, context: np.ndarray, word: np.ndarray, counts: np.ndarray, alone: np.ndarray, total: int, ranges: int):
    """Names of the contexts; the range of each pair; whether its context is spread; which pairs are asked for, by range,
    spread ones last, then context; which are not.

    A context that occurs in no other block is followed nowhere else: its counts are known here.
    """
    contexts = np.append(names, BEGIN)
    own = np.append(alone, False)[context]
    hot = np.append(counts * HOT_SHARE > total, True)
    spread = hot[context]
    keys = mix(contexts)[context]
    of = ranges_of(np.where(spread, mix(keys + mix(names)[word]), keys), ranges)
    asked = np.flatnonzero(~own)
    return contexts, of, spread, asked[np.argsort((of * 2 + spread)[asked], kind="stable")], np.flatnonzero(own)


def _begins(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


ASK_PAIRS = (
    "block int, range int, contexts binary, runs binary, next binary, next_counts binary, pairs binary, unspread int, "
    "known binary"
)


def _none(schema: str, key: pa.DataType = pa.int64()) -> pa.Table:
    """No rows of a schema; what is meant for all blocks also comes to those that hold no text."""
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([], types.get(kind, key)) for name, kind in columns})


def _ask_pairs(ranges: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return _none(ASK_PAIRS)
        t = Tokens(docs)
        counts, names, alone, stats = _word_counts(answers)
        context, word, pairs, _, _ = t.pairs()
        contexts, of, spread, order, own = _dealt(names, context, word, counts, alone, int(stats[0]), ranges)
        known = statistics(pairs[own]).tobytes()
        context, word, pairs, of, spread = (x[order] for x in (context, word, pairs, of, spread))
        cuts = _cuts(of) or [(0, 0, 0)]  # what is known goes out in any case
        columns = {c: [] for c in ("contexts", "runs", "next", "next_counts", "pairs", "unspread")}
        for _, a, b in cuts:
            at = _begins(context[a:b])
            columns["contexts"].append(pack(contexts[context[a:b][at]]))
            columns["runs"].append(pack(np.diff(np.append(at, b - a)).astype(np.uint32)))
            columns["next"].append(pack(names[word[a:b]]))
            columns["next_counts"].append(counts_out(counts[word[a:b]]))
            columns["pairs"].append(pack(pairs[a:b].astype(np.uint32)))
            columns["unspread"].append(int((~spread[a:b][at]).sum()))
        block = docs.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(cuts), pa.int32()),
                "range": pa.array([i for i, _, _ in cuts], pa.int32()),
                **{c: pa.array(columns[c], pa.int32() if c == "unspread" else pa.binary()) for c in columns},
                "known": pa.array([known] + [b""] * (len(cuts) - 1), pa.binary()),
            }
        )

    return run


def _context_sums(pairs: np.ndarray, following: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per context: counts above HIGHEST, types by count 1 .. HIGHEST of its pairs; the same of the words after it."""
    sums = np.zeros((SUMS, len(begins)), dtype=np.int64)
    seen = pairs > 0
    for half, counts in enumerate((pairs, following)):
        for r in range(HIGHEST + 1):
            value = np.where(counts > HIGHEST, counts, 0) if r == 0 else (counts == r)
            sums[half * (HIGHEST + 1) + r] = np.add.reduceat(value * seen, begins)
    return sums


def _answer_pairs(table: pa.Table) -> pa.Table:
    get = lambda c, kind: [unpack(x.as_py(), kind) for x in table.column(c)]
    contexts = get("contexts", np.uint64)
    runs = get("runs", np.uint32)
    following = np.concatenate(get("next", np.uint64))
    known = [np.frombuffer(x.as_py(), np.int64) for x in table.column("known")]
    known = np.sum([np.zeros(STATS, np.int64), *(x for x in known if len(x))], axis=0)
    unspread = table.column("unspread").to_pylist()
    sizes = [int(r.sum()) for r in runs]
    if not len(following):
        nothing = [b""] * len(table)
        return _answers(table, 2, nothing, nothing, nothing, known)
    context = np.repeat(np.concatenate(contexts), np.concatenate(runs))
    order = np.lexsort((following, context))
    context, following = context[order], following[order]
    pairs = np.concatenate(get("pairs", np.uint32))[order].astype(np.int64)
    counts = np.concatenate([counts_in(x.as_py()) for x in table.column("next_counts")])[order].astype(np.int64)
    new_context = np.zeros(len(context), dtype=bool)
    new_context[_begins(context)] = True
    new = new_context.copy()
    new[1:] |= following[1:] != following[:-1]
    firsts = np.flatnonzero(new)
    total = np.add.reduceat(pairs, firsts)
    back = np.empty(len(order), dtype=wide(total))
    back[order] = total[np.cumsum(new) - 1]
    begins = np.flatnonzero(new_context[firsts])
    sums = _context_sums(total, counts[firsts], begins)
    names = context[firsts][begins]
    cuts = np.cumsum([0, *sizes])
    own = [sums[:, np.searchsorted(names, c[:u])] for c, u in zip(contexts, unspread)]
    # sums of spread contexts go out once per range, named
    hot = np.unique(np.concatenate([c[u:] for c, u in zip(contexts, unspread)]))
    return _answers(
        table, 2, [counts_out(back[a:b]) for a, b in zip(cuts, cuts[1:])], [counts_out(s) for s in own],
        [b""] * len(table), statistics(total) + known, hot, sums[:, np.searchsorted(names, hot)],
    )


RESULT = (
    "doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def backoff(sums: np.ndarray, d: np.ndarray, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and alpha of contexts given their sums, one column each; alpha is NaN for unseen contexts."""
    r = np.arange(1, HIGHEST + 1)[:, None]
    low, high = sums[1 : HIGHEST + 1], sums[0]
    times = (r * low).sum(axis=0) + high
    kept = (d[1:, None] * r * low).sum(axis=0) + high
    size = np.where(times - kept > 1e-9 * times, times, times + 1).astype(float)
    word_low, word_high = sums[HIGHEST + 2 :], sums[HIGHEST + 1]
    seen = (unigrams.d[1:, None] * r * word_low).sum(axis=0) + word_high
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = (1 - kept / size) / (1 - seen / unigrams.size)
    return size, np.where(times > 0, alpha, np.nan)


def _score(ranges: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return _none(RESULT, docs.column("doc_id").type)
        t = Tokens(docs)
        counts, names, alone, stats = _word_counts(answers)
        unigrams = Unigrams(stats)
        context, word, pairs, inverse, _ = t.pairs()
        contexts, of, spread, order, own = _dealt(names, context, word, counts, alone, int(stats[0]), ranges)
        rows = _rows(answers, 2)
        pair_stats, hot, hot_sums = _for_all(answers, 2)
        d = discounts(pair_stats)
        seen = pairs.astype(np.int64)
        seen[order] = np.concatenate([np.zeros(0, np.uint32), *(counts_in(answers.column("counts")[i].as_py()) for i in rows)])
        # sums by context: unspread ones come in the order of the asking, spread ones by name
        sums = np.zeros((SUMS, len(contexts)), dtype=np.int64)
        if len(own):
            begins = _begins(context[own])
            sums[:, context[own][begins]] = _context_sums(pairs[own], counts[word[own]], begins)
        asked = context[order[~spread[order]]]
        asked = asked[_begins(asked)]
        at = 0
        for i in rows:
            own_sums = counts_in(answers.column("sums")[i].as_py()).reshape(SUMS, -1)
            n = own_sums.shape[1]
            sums[:, asked[at : at + n]] = own_sums
            at += n
        wanted = np.unique(context[order[spread[order]]])
        sums[:, wanted] = hot_sums[:, np.searchsorted(hot, contexts[wanted])]
        size, alpha = backoff(sums, d, unigrams)
        p = unigrams(counts)[word]
        backed = np.where(np.isnan(alpha[context]), p, alpha[context] * p)
        direct = seen * np.where(seen > HIGHEST, 1.0, d[np.minimum(seen, HIGHEST)]) / size[context]
        with np.errstate(divide="ignore"):
            logs = np.log10(np.where(seen > 0, direct, backed))
        known = counts[t.ids] > 0
        base = np.log10((counts + 1) / (stats[0] + stats[1] + 1))[t.ids]
        n = len(t.held)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": pa.array(t.held, pa.bool_()),
                "n_tokens": pa.array(np.diff(t.offsets), pa.int64()),
                "n_known": pa.array(t.add(known.astype(np.int64)), pa.int64()),
                "train_tokens": pa.array([int(stats[0])] * n, pa.int64()),
                "base_score": pa.array(t.add(base), pa.float64()),
                "score": pa.array(t.add(logs[inverse]), pa.float64()),
            }
        )

    return run


def scored(df: DataFrame, held_out: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts where the SQL
    condition `held_out` is true are not learnt from."""
    ship(df.sparkSession)
    flagged = df.withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    n = blocks(flagged, text=text)
    block = F.pmod(F.xxhash64(doc, text), F.lit(n)).cast("int")
    docs = flagged.select(block.alias("block"), F.col(doc).alias("doc_id"), F.col(text).alias("text"), "held_out")
    words = docs.groupBy("block").applyInArrow(_ask_words(n), ASK)
    words = words.groupBy("range").applyInArrow(_answer_words(n), ANSWER)
    words = words.filter("block >= 0").unionAll(_dealt_to_all(words, n))
    pairs = docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_ask_pairs(n), ASK_PAIRS)
    pairs = pairs.groupBy("range").applyInArrow(_answer_pairs, ANSWER)
    answers = words.unionAll(pairs.filter("block >= 0")).unionAll(_dealt_to_all(pairs, n))
    schema = RESULT.format(kind=df.schema[doc].dataType.simpleString())
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(n), schema)


def op8_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return scored(documents(spark, sf), "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
