"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts somewhere else.

A difference cover lets suffixes be compared through a sample: two equal strings have sampled positions at the same
offset, so names of the sampled strings decide about all others. Here the sample is defined by content instead of by
residues, since only strings of LENGTH bytes matter: the anchors, positions whose GRAM bytes have the smallest hash in a
string of LENGTH bytes. Every such string holds an anchor, and equal strings hold it at the same offset d.

1. Sampled strings get names. Offsets d are taken in intervals; for an interval, an anchor has the name of its core, the
   bytes that all strings of these offsets share, and of its hull, the bytes that they cover together.
2. Names are counted over the corpus. If no other anchor has the same core, none of the strings repeats. If one has the
   same hull, all of them do. Where both hold in part, recursion: the interval is split, with new names, down to single
   offsets, where core and hull are the string itself. An anchor whose hull repeats still asks on as long as others share
   its core alone, so that they meet it.
3. The remaining suffixes, those between anchors, are merged in by their distance to the anchor: an anchor's largest and
   smallest repeated offset give the bytes it covers, and the union over the anchors of a text is what is removed.

Only names travel, packed per block and range of names (see `exchange`); no string leaves its block, and no group of
equal strings is ever gathered, however many there are. Names are 64-bit hashes of whole strings.

Null and empty texts have no bytes. Texts shorter than LENGTH are kept whole. Repeated rows repeat each other's strings.
Rows with a null key are handled like others. Columns in `keep` pass through. An empty table gives no rows. A cut can
fall inside a character: the rest of that character is dropped from the text, but counted in the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import blocks, documents, ship
from candlewick.llm.exchange import ANSWER, ASK, Asked, answer_or_pass, planes, unplanes
from candlewick.llm.textarrays import Hasher, flat, mix, parts, trimmed
from candlewick.llm.tokens import release, spread

LENGTH = 200
GRAM = 12
BLOCK_BYTES = 2 << 20  # the anchors of a block and what they ask take a multiple of its text
SLICE_BYTES = (1 << 18) - 4096  # text that is hashed at once, or one text
BLOCKS_A_RANGE = 4  # of a range of names
AT_ONCE = 1 << 19  # asked intervals that are named at once
SPLITS = (2, 5, 5, 5)  # parts of an interval of offsets, level by level, down to single ones

_CORE, _HULL = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def intervals(length: int = LENGTH, gram: int = GRAM, splits=SPLITS) -> list[list[tuple[int, int, int]]]:
    """Per level: (parent, first, last) offset of each interval; the last level holds single offsets."""
    levels = [[(-1, 0, length - gram)]]
    for split in splits:
        if single(levels[-1]):
            break
        level = []
        for parent, (_, a, b) in enumerate(levels[-1]):
            cuts = [a + (b - a + 1) * i // min(split, b - a + 1) for i in range(min(split, b - a + 1) + 1)]
            level += [(parent, x, y - 1) for x, y in zip(cuts, cuts[1:])]
        levels.append(level)
    while not single(levels[-1]):
        levels.append(
            [(p, x, x) for p, (_, a, b) in enumerate(levels[-1]) for x in range(a, b + 1)]
        )
    return levels[1:] or levels


def single(level: list[tuple[int, int, int]]) -> bool:
    """Whether the level holds single offsets only, whose core and hull are one string."""
    return all(a == b for _, a, b in level)


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum, or maximum, of each run of `width` values."""
    pick, w = (np.minimum if least else np.maximum), 1
    while 2 * w <= width:
        x = pick(x[:-w], x[w:])
        w *= 2
    return pick(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


class Block:
    """The texts of a block in a fixed order, and hashes of their substrings."""

    def __init__(self, docs: pa.Table):
        self.docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.data, self.offsets = flat(self.docs.column("text"))
        self.ranges = parts(self.offsets, SLICE_BYTES)
        self.cuts = np.array([self.offsets[a] for a, _ in self.ranges] + [len(self.data)])

    def bounds(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.searchsorted(self.offsets, at, "right") - 1
        return self.offsets[owner], self.offsets[owner + 1]

    def hashes(self, at: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Hashes of the bytes from `before` ahead of each ascending position `at` to `after` it, within one text."""
        found = [np.zeros(len(at), np.uint64) for _ in spans]
        edges = np.searchsorted(at, self.cuts)
        for i in range(len(self.ranges)):
            a, b = edges[i], edges[i + 1]
            if a == b:
                continue
            first = self.cuts[i]
            hasher = Hasher(self.data[first : self.cuts[i + 1]])
            own = at[a:b] - first
            for out, (before, after) in zip(found, spans):
                out[a:b] = hasher(own - before[a:b], own + after[a:b])
        return found

    def anchors(self, length: int, gram: int) -> np.ndarray:
        """Positions whose `gram` bytes hash lowest in some string of `length` bytes."""
        found, width = [np.zeros(0, np.int64)], length - gram + 1
        for first, stop in self.ranges:
            base = self.offsets[first]
            own = self.offsets[first : stop + 1] - base
            n = own[-1]
            if n < length:
                continue
            grams = np.arange(n - gram + 1)
            value = Hasher(self.data[base : base + n])(grams, grams + gram)
            lowest = _slide(value, width, True)
            end = np.repeat(own[1:], np.diff(own))[: len(lowest)]
            lowest[grams[: len(lowest)] + length > end] = 0  # strings stay within their text
            pad = np.zeros(width - 1, np.uint64)
            reach = _slide(np.concatenate([pad, lowest, pad]), width, False)
            found.append(np.flatnonzero((reach == value) & (value > 0)) + base)
        return np.concatenate(found)


class Search:
    """What a block still asks: anchors with an interval each, and the offsets known to repeat per anchor."""

    def __init__(self, anchors, index, interval, least, most):
        self.anchors, self.index, self.interval, self.least, self.most = anchors, index, interval, least, most

    @staticmethod
    def kinds(length: int) -> tuple[type, ...]:
        """Types of the fields: offsets up to `length`, and fewer intervals than offsets."""
        small = np.uint8 if length < 256 else np.uint16 if length < 65536 else np.uint32
        return np.uint32, np.uint32, small, small, small

    def pack(self, length: int) -> tuple[bytes, bytes]:
        """least > most where nothing repeats."""
        # what ascends goes as differences, whose leading bytes are mostly zero
        rising = [planes(np.diff(f.astype(np.uint32), prepend=np.uint32(0))) for f in (self.anchors, self.index)]
        small = self.kinds(length)[-1]
        rest = [f.astype(small).tobytes() for f in (self.interval, self.least, self.most)]
        sizes = np.array([len(self.anchors), len(self.index)], np.uint32)
        return sizes.tobytes(), b"".join([*rising, *rest])

    @classmethod
    def unpack(cls, sizes: bytes, raw: bytes, length: int) -> Search:
        n, m = np.frombuffer(sizes, np.uint32)
        fields, at = [], 0
        for count, kind in zip((n, m, m, n, n), cls.kinds(length)):
            step = int(count) * np.dtype(kind).itemsize
            part = raw[at : at + step]
            fields.append(np.cumsum(unplanes(part, kind), dtype=kind) if len(fields) < 2 else np.frombuffer(part, kind).copy())
            at += step
        fields[0] = fields[0].astype(np.int64)
        return cls(*fields)


def _names(block: Block, s: Search, level: list, length: int):
    """Names of core and hull of each asked interval, and the first and last offset that its text has room for."""
    small = np.int16 if length < 1 << 15 else np.int32
    table = np.array(level, np.int32)
    begin, end = block.bounds(s.anchors)
    least = np.maximum(0, length - (end - s.anchors)).astype(small)  # offsets that the text has room for
    most = np.minimum(length, s.anchors - begin).astype(small)
    room = np.maximum(table[s.interval, 1], least[s.index]) <= np.minimum(table[s.interval, 2], most[s.index])
    s.index, s.interval = s.index[room], s.interval[room]
    n, alone = len(s.index), single(level)
    core = np.empty(n, np.uint64)
    hull = core if alone else np.empty(n, np.uint64)
    low, high = np.empty(n, small), np.empty(n, small)
    for at in range(0, n, AT_ONCE):
        part = slice(at, at + AT_ONCE)
        index = s.index[part]
        first, last = table[s.interval[part], 1], table[s.interval[part], 2]
        low[part], high[part] = np.maximum(first, least[index]), np.minimum(last, most[index])
        spans = [(first, length - last)]
        if not alone:
            spans.append((high[part].astype(np.int32), length - low[part].astype(np.int32)))
        found = block.hashes(s.anchors[index], spans)
        core[part] = mix(found[0] + (_CORE + (first.astype(np.uint64) << np.uint64(8)) + last.astype(np.uint64)))
        if not alone:
            edges = (low[part].astype(np.uint64) << np.uint64(8)) + high[part].astype(np.uint64)
            hull[part] = mix(found[1] + (_HULL + edges))
    return core, hull, low, high


def _step(depth: int, ranges: int, length: int, gram: int, levels: list, finish: bool, with_text: bool):
    """Takes in the answers to level depth - 1 and asks level `depth`, or gives the results."""

    @trimmed
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        release()
        block = Block(docs)
        if depth == 0:
            anchors = block.anchors(length, gram)
            n, k = len(anchors), len(levels[0])
            search = Search(
                anchors, np.repeat(np.arange(n), k), np.tile(np.arange(k), n), np.full(n, length), np.zeros(n, np.int64)
            )
        else:
            state = next(i for i, r in enumerate(back.column("range").to_pylist()) if r < 0)
            search = Search.unpack(back.column("mask")[state].as_py(), back.column("more")[state].as_py(), length)
            core, hull, low, high = _names(block, search, levels[depth - 1], length)
            alone = single(levels[depth - 1])
            asked = Asked(core if alone else np.concatenate([core, hull]), ranges)
            totals = asked.totals(back)
            cores = totals[np.searchsorted(asked.names, core)]
            hulls = cores if alone else totals[np.searchsorted(asked.names, hull)]
            hit = hulls > 1
            np.minimum.at(search.least, search.index[hit], low[hit].astype(search.least.dtype))
            np.maximum.at(search.most, search.index[hit], high[hit].astype(search.most.dtype))
            if finish:
                return _result(block, search, length, with_text)
            # go on where some share the core but not the hull
            on = cores > hulls
            children = [[i for i, (p, _, _) in enumerate(levels[depth]) if p == q] for q in range(len(levels[depth - 1]))]
            many = np.array([len(c) for c in children], np.int32)[search.interval[on]]
            firsts = np.array([c[0] for c in children], np.int32)[search.interval[on]]
            search.index = np.repeat(search.index[on], many)
            search.interval = spread(firsts, many).astype(np.int16 if length < 1 << 15 else np.int32)
            del core, hull, low, high, asked, totals, cores, hulls, hit, on
        core, hull, _, _ = _names(block, search, levels[depth], length)
        asked = Asked(core if single(levels[depth]) else np.concatenate([core, hull]), ranges)
        number = docs.column("block")[0].as_py()
        rows = asked.rows(number)
        sizes, raw = search.pack(length)
        state = {"block": [number], "range": [-1 - number], "names": [sizes], "counts": [raw]}
        return pa.concat_tables([rows, pa.table(state, schema=rows.schema)])

    return run


def _result(block: Block, s: Search, length: int, with_text: bool) -> pa.Table:
    hit = s.least <= s.most
    at, least, most = s.anchors[hit], s.least[hit].astype(np.int64), s.most[hit].astype(np.int64)
    edge = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edge, at - most, 1)
    np.add.at(edge, at + length - least, -1)
    covered = np.cumsum(edge[:-1]) > 0
    starts = covered.copy()
    starts[1:] &= ~covered[:-1]
    inner = block.offsets[:-1][np.diff(block.offsets) > 0]
    starts[inner] = covered[inner]  # a run ends with its text
    begins = np.flatnonzero(starts)
    stops = covered.copy()
    stops[:-1] &= ~covered[1:]
    last = block.offsets[1:][np.diff(block.offsets) > 0] - 1
    stops[last] = covered[last]
    ends = np.flatnonzero(stops) + 1
    cut = np.searchsorted(begins, block.offsets)
    removed = np.concatenate([[0], np.cumsum(covered)])
    kept, digests, spans = [], [], []
    for i, (a, b) in enumerate(zip(block.offsets, block.offsets[1:])):
        rest = block.data[a:b][~covered[a:b]].tobytes()
        digests.append(hashlib.sha256(rest).hexdigest())
        if with_text:
            kept.append(rest.decode("utf-8", "ignore"))
            spans.append([(int(x - a), int(y - a)) for x, y in zip(begins[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]])])
    columns = {c: block.docs.column(c) for c in block.docs.column_names if c not in ("block", "text")}
    columns |= {
        "n_bytes": pa.array(np.diff(block.offsets), pa.int64()),
        "n_removed": pa.array(np.diff(removed[block.offsets]), pa.int64()),
        "n_spans": pa.array(np.diff(cut), pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
    }
    if with_text:
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        columns["kept_text"] = pa.array(kept, pa.string())
        columns["spans"] = pa.array([[{"begin": x, "end": y} for x, y in s] for s in spans], pa.list_(span))
    return pa.table(columns)


def deduplicated(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    length: int = LENGTH,
    gram: int = GRAM,
    with_text: bool = False,
) -> DataFrame:
    """doc_id, `keep`, n_bytes, n_removed, n_spans, kept_sha256, and if asked for kept_text and the removed spans."""
    spark = df.sparkSession
    ship(spark)
    n = blocks(df, text=text, size=BLOCK_BYTES)
    block = F.pmod(F.xxhash64(doc, text), F.lit(n)).cast("int")
    others = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    docs = df.select(block.alias("block"), F.col(doc).alias("doc_id"), F.col(text).alias("text"), *others)
    levels = intervals(length, gram)
    ranges = max(1, n // BLOCKS_A_RANGE)
    first = _step(0, ranges, length, gram, levels, False, False)
    rows = docs.groupBy("block").applyInArrow(lambda table: first(table, None), ASK)
    for depth in range(1, len(levels) + 1):
        back = rows.groupBy("range").applyInArrow(answer_or_pass, ANSWER).groupBy("block")
        finish = depth == len(levels)
        schema = ASK
        if finish:
            own = [f"doc_id {df.schema[doc].dataType.simpleString()}"]
            own += [f"keep_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
            own += ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"]
            own += ["kept_text string, spans array<struct<begin: long, end: long>>"] * with_text
            schema = ", ".join(own)
        rows = docs.groupBy("block").cogroup(back).applyInArrow(
            _step(depth, ranges, length, gram, levels, finish, with_text), schema
        )
    for i, c in enumerate(keep):
        rows = rows.withColumnRenamed(f"keep_{i}", c)
    return rows.withColumnRenamed("doc_id", doc)


def without_repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The rows of `df` with what repeats cut out of the text, and its length in `chars` if there is such a column. Rows
    of which nothing but white space is left go, unless nothing was cut from them."""
    others = tuple(c for c in df.columns if c not in (doc, text))
    rows = deduplicated(df, doc, text, others, with_text=True).filter(
        (F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    )
    columns = {text: F.col("kept_text"), chars: F.length("kept_text").cast("long")}
    return rows.select(*(columns.get(c, F.col(c)).alias(c) for c in df.columns))


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicated(documents(spark, sf))
