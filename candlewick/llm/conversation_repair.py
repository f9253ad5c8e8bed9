"""Repair of the structure of conversations at least cost.

A conversation is its rows by turn (nulls first, then by role and text). Every row may be kept, given another role or
deleted, and messages without text may be inserted, so that the initials of the roles read `(s?(ua)+)?`. Blank and
repeated rows have to go. The cheapest list of edits is wanted and, among equally cheap ones, the one whose initials (D, I,
K, R) come first in ASCII.

Weights are scalar big integers: the high digits carry the cost, the WIDTH low octal digits the letters of the edits from
the left, with zeros behind the last. Of two such numbers the smaller is the cheaper, then the one with the smaller text,
a text before its own continuations. So the shortest path through the DAG of (row, state of the roles) is found by `min`
over ordinary integers, from the last row to the first.

A conversation of any length is cut into pieces of at most PIECE rows. For a piece the weights from each state before it
to each state behind it are a small matrix; paths between the same two states and of the same cost are never one the
beginning of the other (every letter but I takes a row, and an I costs), so their order does not depend on what follows
and matrices can be multiplied in any order, with `min` for the sum. Rows are range-partitioned by conversation, turn,
role and the head of the text, so one conversation may fill many tasks; only its matrices, and the texts that one SHA-256
has to read in order, come together, streamed piece by piece.

Whether a row was seen earlier is told by the least turn of each (conversation, role, text), found by a grouping over
128-bit digests and sorted in front of the rows. Equal rows are merged with a count before anything is sorted.

Null roles and texts count as one space, null turns come first, a null conv_id is a conversation of its own, an unknown
role can be replaced or deleted but not kept. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import mapped, store, table

PIECE = 2048
PIECE_BYTES = 4 << 20
HEAD = 256  # characters of a text that take part in the partitioning
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = str.maketrans("1234", "DIKR")
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED = 5
# states of the roles so far: none, after s, after u, after a
STATES = range(4)
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FILL = "uuau"  # the only role that may be filled in at a state
NAMES = {"u": "user", "a": "assistant"}
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
MESSAGES = "conv_id long, place long, role string, text string"


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str  # "", b(lank), d(uplicate) or t(runcated)


class Node(NamedTuple):
    """The weights of a stretch of rows, from state to state, with `width` letters; None where there is no path."""

    width: int
    weights: list[list[int | None]]
    middle: list[list[int | None]] | None = None  # the state between the two parts
    parts: tuple[Node, Node] | None = None


def fault(text: str, seen: bool) -> str:
    solid = text.rstrip(BLANK)
    return "b" if not solid else "d" if seen else "" if solid[-1] in ".!?" else "t"


def edits(row: Row) -> list[list[tuple[int, int, int]]]:
    """Per state: (cost, letter, next state) of what can be done with the row."""
    found = [[(COSTS[DELETE], DELETE, e)] for e in STATES]
    if row.fault in ("", "t"):
        more = TRUNCATED if row.fault else 0
        for e in STATES:
            kept = NEXT.get(row.role[:1], (None,) * 4)[e]
            if kept is not None:
                found[e].append((COSTS[KEEP] + more, KEEP, kept))
            found[e].append((COSTS[REROLE] + more, REROLE, NEXT[FILL[e]][e]))
    return found


def passed(rows: list[Row], ends: list[int | None], width: int) -> list[int | None]:
    """Least weight per state before the rows, given that per state behind them."""
    bits = 3 * width
    high, low, first = -1 << bits, (1 << bits) - 1, bits - 3
    weigh = {(c, k): (c << bits) + (k << first) for c in range(7) for k in range(1, 5)}
    inserted = weigh[COSTS[INSERT], INSERT]
    best, options = ends, {}
    for row in reversed(rows):
        moved = [None if v is None else (v & high) + ((v & low) >> 3) for v in best]
        kind = (row.role[:1], row.fault)
        if kind not in options:
            options[kind] = [[(weigh[c, k], f) for c, k, f in choices] for choices in edits(row)]
        best = [min((w + moved[f] for w, f in choices if moved[f] is not None), default=None) for choices in options[kind]]
        # one message filled in before the row is enough: two lead back to where they began
        filled = [best[NEXT[FILL[e]][e]] for e in STATES]
        best = [
            v if x is None else min(y for y in (v, inserted + (x & high) + ((x & low) >> 3)) if y is not None)
            for v, x in zip(best, filled)
        ]
    return best


def endings(width: int) -> list[int | None]:
    """Weight of ending in each state; a started pair is filled up."""
    bits = 3 * width
    first, second = INSERT << bits - 3, INSERT << bits - 6
    return [0, (2 * COSTS[INSERT] << bits) + first + second, (COSTS[INSERT] << bits) + first, 0]


def matrix(rows: list[Row]) -> Node:
    width = max(1, 2 * len(rows))  # a letter and an insertion for each row
    columns = [passed(rows, [0 if e == f else None for e in STATES], width) for f in STATES]
    return Node(width, [list(x) for x in zip(*columns)])


def joined(left: int, left_width: int, right: int, right_width: int) -> int:
    """Costs added, letters one behind the other, over the width of both."""
    bits, more = 3 * left_width, 3 * right_width
    letters, behind = left & (1 << bits) - 1, right & (1 << more) - 1
    padding = ((letters & -letters).bit_length() - 1) // 3 if letters else left_width
    cost = (left >> bits) + (right >> more)
    return (cost << bits + more) + (letters << more) + (behind << 3 * padding)


def product(a: Node, b: Node) -> Node:
    weights, middle = [], []
    for e in STATES:
        row = []
        for f in STATES:
            both = [(a.weights[e][g], b.weights[g][f], g) for g in STATES]
            row.append(min(((joined(x, a.width, y, b.width), g) for x, y, g in both if None not in (x, y)), default=(None, None)))
        weights.append([v for v, _ in row])
        middle.append([g for _, g in row])
    return Node(a.width + b.width, weights, middle, (a, b))


def composed(pieces: Iterable[Node]) -> Node:
    """The product of all, by halves, so that wide numbers are multiplied seldom."""
    level = list(pieces)
    while len(level) > 1:
        pairs = [product(a, b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[2 * len(pairs) :]
    return level[0]


def letters(weight: int, width: int) -> str:
    return format(weight & (1 << 3 * width) - 1, f"0{width}o").rstrip("0").translate(LETTERS) if width else ""


def audits(node: Node, e: int, f: int) -> Iterator[str]:
    """The letters of each piece on the way from e to f."""
    waiting = [(node, e, f)]
    while waiting:
        node, e, f = waiting.pop()
        if node.parts is None:
            yield letters(node.weights[e][f], node.width)
        else:
            g = node.middle[e][f]
            waiting += [(node.parts[1], g, f), (node.parts[0], e, g)]


def repaired(rows: Iterable[Row], audit: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """Role and text of each message after the edits."""
    rows = iter(rows)
    for letter in audit:
        fill = FILL[state]
        if letter == "I":
            yield NAMES[fill], ""
        else:
            row = next(rows)
            if letter == "D":
                continue
            fill = row.role[:1] if letter == "K" else fill
            yield (row.role if letter == "K" else NAMES[fill]), row.text
        state = NEXT[fill][state]


def end_state(audit: str, rows: list[Row], state: int) -> int:
    for role, _ in repaired(rows, audit, state):
        state = NEXT[role[:1]][state]
    return state


class Counts:
    """What is counted of the rows of a piece, and of pieces in their order."""

    def __init__(self, rows: list[Row] = ()):
        turns = [r.turn for r in rows if r.turn is not None]
        self.turns = sum(1 for _ in groupby(turns))
        self.first, self.last = (turns[0], turns[-1]) if turns else (None, None)
        initials = [r.role[:1] for r in rows]
        self.initials = [initials[0], initials[-1]] if rows else []
        self.illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        self.blank, self.duplicate, self.truncated = (sum(r.fault == f for r in rows) for f in "bdt")

    def add(self, other: Counts) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.initials and other.initials:
            self.illegal += self.initials[1] + other.initials[0] not in ("su", "ua", "au")
        if other.initials:
            self.initials = [(self.initials or other.initials)[0], other.initials[1]]
        if other.first is not None:
            self.turns -= self.last == other.first
            self.first, self.last = other.first if self.first is None else self.first, other.last

    def values(self) -> list[int]:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


Messages = Iterable[tuple[str, str]]


def as_summary(conv: int | None, counts: Counts, cost: int, audit: str, messages: Messages) -> Iterator[tuple]:
    digest = hashlib.sha256()
    for i, (role, text) in enumerate(messages):
        digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
    yield (conv, *counts.values(), cost, audit, digest.hexdigest())


def as_messages(conv: int | None, counts: Counts, cost: int, audit: str, messages: Messages) -> Iterator[tuple]:
    for i, (role, text) in enumerate(messages):
        yield conv, i, role, text


def _streamed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _out(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by number and by characters of their last cell."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most or size >= PIECE_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(stream: Iterator[tuple]) -> Iterator[tuple[int | None, Row | None]]:
    """Conversation and row, one for each copy; None for what was dropped."""
    place, firsts = None, set()
    for conv, turn, role, head, text, digest, copies in stream:
        if text is None:  # a mark: the row with this digest is the first of its kind
            if place != (conv, turn, role, head):
                place, firsts = (conv, turn, role, head), set()
            firsts.add(digest)
            continue
        if not copies:
            yield conv, None
        first = place == (conv, turn, role, head) and digest in firsts
        for i in range(copies):
            yield conv, Row(turn, role, text, fault(text, i > 0 or not first))


def _pieces(rows: Iterable[tuple[int | None, Row | None]]) -> Iterator[list[Row]]:
    """The rows of one conversation, at least one piece."""
    held, size, some = [], 0, False
    for _, row in rows:
        if row is not None:
            held.append(row)
            size += len(row.text)
        if len(held) >= PIECE or size >= PIECE_BYTES:
            yield held
            held, size, some = [], 0, True
    if held or not some:
        yield held


# besides the columns of the result, what a piece needs
PART = "p_kind long, p_known boolean, p_turn long, p_role string, p_head string, p_piece long, p_body string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in schema.split(", "))])


def _first(schema: str, build: Callable):
    """Conversations that lie within the partition, finished; of the first and last one, and of long ones, the pieces.

    A piece is two rows: turns, initials and faults of its rows (p_kind 0), and its rows (p_kind 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "head", "text", "digest", "copies"]

        def found() -> Iterator[tuple]:
            waiting = None  # a conversation in one piece, until it is seen not to be the last
            stream = groupby(_rows(_streamed(batches, names)), key=lambda x: x[0])
            for index, (conv, group) in enumerate(stream):
                if waiting:
                    yield from whole(*waiting)
                waiting, number, rows = None, 0, None
                for piece in _pieces(group):
                    if rows is not None:
                        yield from part(conv, rows, number)
                        number += 1
                    rows = piece
                if index and not number:
                    waiting = conv, rows
                else:
                    yield from part(conv, rows, number)
            if waiting:
                yield from part(*waiting, 0)

        yield from _out(found(), _arrow(f"{schema}, {PART}"))

    empty = (None,) * schema.count(",")

    def part(conv: int | None, rows: list[Row], number: int) -> Iterator[tuple]:
        key = (rows[0].turn is not None, rows[0].turn, rows[0].role, rows[0].text[:HEAD]) if rows else (False, None, "", "")
        yield conv, *empty, 0, *key, number, json.dumps([(r.turn, r.role[:1], "", r.fault) for r in rows])
        yield conv, *empty, 1, *key, number, json.dumps(rows)

    def whole(conv: int | None, rows: list[Row]) -> Iterator[tuple]:
        width = 2 * len(rows) + 2
        weight = passed(rows, endings(width), width)[0]
        audit = letters(weight, width)
        for row in build(conv, Counts(rows), weight >> 3 * width, audit, repaired(rows, audit)):
            yield *row, *(None,) * (PART.count(",") + 1)

    return run


def _second(schema: str, build: Callable):
    """Conversations in pieces: matrices first, then the rows streamed through the edits chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            stream = _streamed(batches, ["conv_id", "p_kind", "p_body"])
            for conv, group in groupby(stream, key=lambda x: x[0]):
                kinds = groupby(group, key=lambda x: x[1])
                counts, nodes = Counts(), []
                for _, _, body in next(kinds)[1]:
                    rows = [Row(*r) for r in json.loads(body)]
                    counts.add(Counts(rows))
                    nodes.append(matrix(rows))
                ends = [[None if e != f else v for f, v in enumerate(endings(2))] for e in STATES]
                whole = composed([*nodes, Node(2, ends)])
                end = min((v, f) for f, v in enumerate(whole.weights[0]) if v is not None)[1]
                weight = whole.weights[0][end]
                chosen = audits(whole, 0, end)
                texts = ([Row(*r) for r in json.loads(body)] for _, _, body in next(kinds)[1])
                audit = letters(weight, whole.width)
                yield from build(conv, counts, weight >> 3 * whole.width, audit, edited(chosen, texts))

        yield from _out(found(), _arrow(schema))

    def edited(chosen: Iterator[str], texts: Iterator[list[Row]]) -> Messages:
        state = 0
        for rows in texts:
            audit = next(chosen)
            yield from repaired(rows, audit, state)
            state = end_state(audit, rows, state)
        yield from repaired([], next(chosen), state)

    return run


def prepared(df: DataFrame) -> DataFrame:
    """Nulls as one space, every row once."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text, F.lit(1).cast("long").alias("copies"))


def repair(rows: DataFrame, messages: bool = False) -> DataFrame:
    """One row per conversation: counts, cost, audit and SHA-256 of the repaired text; or the repaired messages by place.

    `rows` holds conv_id, turn, role, text and copies, how often the row stands there in succession; 0 keeps only the
    conversation.
    """
    head = F.substring("text", 1, HEAD).alias("head")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest")
    # the first turn of each kind of row, nulls first; the texts stay where they are
    known = rows.filter("copies > 0").select("conv_id", "turn", "role", head, digest)
    firsts = known.groupBy("conv_id", "role", "head", "digest").agg(
        F.when(F.max(F.col("turn").isNull()), F.lit(None)).otherwise(F.min("turn")).alias("turn")
    )
    marks = firsts.select("conv_id", "turn", "role", "head", F.lit(None).cast("string").alias("text"), "digest", F.lit(0).cast("long").alias("copies"))
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    merged = merged.select("conv_id", "turn", "role", head, "text", digest, "copies")
    key = ["conv_id", "turn", "role", "head"]
    dealt = merged.unionByName(marks).repartitionByRange(*key).sortWithinPartitions(*key, "text")
    schema, build = (MESSAGES, as_messages) if messages else (SUMMARY, as_summary)
    found = store(mapped(dealt, _first(schema, build), f"{schema}, {PART}"), "conversations")
    pieces = found.filter("p_kind IS NOT NULL").repartition("conv_id")
    pieces = pieces.sortWithinPartitions("conv_id", "p_kind", "p_known", "p_turn", "p_role", "p_head", "p_piece")
    late = mapped(pieces, _second(schema, build), schema)
    return found.filter("p_kind IS NULL").select(late.columns).unionByName(late)


def damaged(df: DataFrame) -> DataFrame:
    """The damage that the query repairs, told by a checksum of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = prepared(df).withColumn("n", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("n") <= 1, "").when(F.col("n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("n") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("n") == 0, 0).when(F.col("n") == 3, F.lit(2) * F.col("copies")).otherwise(F.col("copies")).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair(damaged(table(spark, sf, "conversations", "conv_id", "turn", "role", "text")))
