"""Context-mixing range coder for token ids.

Ids are coded in blocks of BLOCK_IDS. A block starts with an empty model and carries its length and a checksum, so each
is decoded on its own. All blocks of a file are coded side by side, one NumPy lane per block.

The model predicts the next id from the last two (order 2), from the last one (order 1), and by how often ids of a class
came in this block (order 0). The two contexts hold an id and a confidence each; the hit rates seen at these confidences
are mixed in the logistic domain with weights that learn from every id. The range is split between the order-2 id, the
order-1 id and the rest; within the rest the id's class is coded by its adaptive frequency and what remains of the id by
equal shares. Everything is integer arithmetic, so any machine decodes what another has written.

File layout, little-endian: "CWTK", version (u32), ids per block (u32), number of blocks (u32); per block the number of
ids, bytes and the crc32 of the ids as u32 (three u32); then the coded blocks in order, as big-endian 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 8192
MAGIC, VERSION = b"CWTK", 1
SLOTS = 4096  # places of a context table
CLASSES = 128  # ids below 16 are their own class; above, the leading bit and the three after it
LARGEST_ID = (1 << 18) - 1
REBUILD = 64  # ids between two looks at the order-0 counts
TOP, LEAST = np.uint64(1 << 48), np.uint64(1 << 32)
U = np.uint64


def _squash_table() -> np.ndarray:
    x = np.arange(-2047, 2048) / 256
    return np.clip((4096 / (1 + np.exp(-x))).round().astype(np.int64), 1, 4095)


SQUASH = _squash_table()  # 12-bit probability of a logit in 1/256
STRETCH = np.searchsorted(SQUASH, np.arange(4096)).clip(0, 4094) - 2047  # its inverse


def classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, number of bits left, and these bits."""
    lead = np.frexp(ids.astype(np.float64))[1] - 1
    bits = np.where(ids < 16, 0, lead - 3)
    found = np.where(ids < 16, ids, 16 + (lead - 4) * 8 + ((ids >> np.maximum(bits, 0)) & 7))
    return found, bits, ids & ((1 << bits) - 1)


class Lanes:
    """Model and coder state of all blocks of a file."""

    def __init__(self, n: int):
        self.at = np.arange(n)
        self.low, self.range = np.zeros(n, U), np.full(n, 2**64 - 1, U)
        self.ids = [np.zeros(n * SLOTS, np.int32) for _ in range(2)]  # order 1, order 2
        self.trust = [np.zeros(n * SLOTS, np.int8) for _ in range(2)]
        self.rates = [np.full(n * 32, 1 << 13, np.int64), np.full(n * 16, 1 << 14, np.int64)]
        self.weights = [np.full(n * 2, w, np.int64) for w in (20_000, 45_000)]
        self.counts = np.ones((n, CLASSES), np.int64)
        self.sums = np.zeros((n, CLASSES + 1), np.int64)
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self, k: int, step: int) -> None:
        """Shares of the order-2 and the order-1 id, of 65536, for the first k lanes."""
        if step % REBUILD == 0:
            full = self.counts.sum(axis=1) > 1 << 15
            self.counts[full] = (self.counts[full] + 1) >> 1
            np.cumsum(self.counts, axis=1, out=self.sums[:, 1:])
        at = self.at[:k]
        last, before = self.last[:k], self.before[:k]
        self.slot1 = at * SLOTS + ((last * 40503 >> 4) & (SLOTS - 1))
        self.slot2 = at * SLOTS + (((before * 62089911 + last * 40503) >> 7) & (SLOTS - 1))
        self.id1, self.id2 = self.ids[0][self.slot1], self.ids[1][self.slot2]
        self.same = self.id1 == self.id2
        self.rate1 = at * 32 + self.same * 16 + self.trust[0][self.slot1]
        self.rate2 = at * 16 + self.trust[1][self.slot2]
        self.q1, self.q2 = self.rates[0][self.rate1], self.rates[1][self.rate2]
        self.x1, self.x2 = STRETCH[self.q1 >> 4], STRETCH[self.q2 >> 4]
        self.set = at * 2 + self.same
        self.w1, self.w2 = self.weights[0][self.set], self.weights[1][self.set]
        logit = (self.w1 * self.x1 + self.w2 * self.x2) >> 16
        self.p = SQUASH[np.clip(logit, -2047, 2047) + 2047]
        self.first = self.p << 4
        rest = 65536 - self.first
        self.second = np.where(self.same, 0, np.clip(rest * self.q1 >> 16, 1, rest - 1))

    def learn(self, k: int, ids: np.ndarray) -> None:
        hit1, hit2 = ids == self.id1, ids == self.id2
        self.rates[0][self.rate1] = np.clip(self.q1 + ((hit1 * 65535 - self.q1) >> 5), 64, 65472)
        self.rates[1][self.rate2] = np.clip(self.q2 + ((hit2 * 65535 - self.q2) >> 5), 64, 65472)
        error = ((hit2 << 12) - self.p) * 6
        self.weights[0][self.set] = self.w1 + ((self.x1 * error + 512) >> 10)
        self.weights[1][self.set] = self.w2 + ((self.x2 * error + 512) >> 10)
        for order, slot, known, hit in ((0, self.slot1, self.id1, hit1), (1, self.slot2, self.id2, hit2)):
            trust = self.trust[order][slot]
            self.ids[order][slot] = np.where(hit | (trust > 1), known, ids)
            self.trust[order][slot] = np.where(hit, np.minimum(trust + 1, 15), trust >> 1)
        self.before[:k] = self.last[:k]
        self.last[:k] = ids

    def settled(self, lanes: np.ndarray) -> np.ndarray:
        """The lanes whose leading 16 bits can move out; a range that is too small is cut at the next boundary."""
        low, size = self.low[lanes], self.range[lanes]
        done = (low ^ (low + (size - U(1)))) < TOP
        tight = ~done & (size < LEAST)
        if tight.any():
            cut = lanes[tight]
            self.range[cut] = (~self.low[cut] + U(1)) & (LEAST - U(1))
            done |= tight
        return lanes[done]

    def shift(self, lanes: np.ndarray) -> None:
        self.low[lanes] <<= U(16)
        self.range[lanes] <<= U(16)


def _lengths(total: int, size: int) -> np.ndarray:
    n = -(-total // size)
    lengths = np.full(n, size)
    if n:
        lengths[-1] = total - (n - 1) * size
    return lengths


def encode(ids: np.ndarray, size: int = BLOCK_IDS) -> bytes:
    """The ids as a file."""
    ids = np.asarray(ids, dtype=np.int64)
    if len(ids) and not 0 <= ids.min() <= ids.max() <= LARGEST_ID:
        raise ValueError(f"ids must lie in 0 .. {LARGEST_ID}")
    lengths = _lengths(len(ids), size)
    n = len(lengths)
    head = struct.pack("<4sIII", MAGIC, VERSION, size, n)
    if not n:
        return head
    rows = np.zeros((n, size), np.int64)
    rows.reshape(-1)[: len(ids)] = ids
    steps = np.ascontiguousarray(rows.T)
    s = Lanes(n)
    out = np.zeros((n, 3 * size + 8), np.uint16)
    used = np.zeros(n, np.int64)

    def flush(lanes: np.ndarray) -> None:
        lanes = s.settled(lanes)
        while len(lanes):
            out[lanes, used[lanes]] = (s.low[lanes] >> U(48)).astype(np.uint16)
            used[lanes] += 1
            s.shift(lanes)
            lanes = s.settled(lanes)

    for t in range(lengths[0]):
        k = n if t < lengths[-1] else n - 1
        s.predict(k, t)
        x = steps[t, :k]
        second = (x == s.id1) & ~s.same
        first = x == s.id2
        second &= ~first
        below = np.where(first, 0, np.where(second, s.first, s.first + s.second)).astype(U)
        share = np.where(first, s.first, np.where(second, s.second, 65536 - s.first - s.second)).astype(U)
        part = s.range[:k] >> U(16)
        s.low[:k] += part * below
        s.range[:k] = part * share
        flush(s.at[:k])
        lanes = np.flatnonzero(~(first | second))
        if len(lanes):
            kind, bits, value = classes(x[lanes])
            a, b = s.sums[lanes, kind], s.sums[lanes, kind + 1]
            part = s.range[lanes] // s.sums[lanes, -1].astype(U)
            rest = part * (b - a).astype(U) >> bits.astype(U)
            s.low[lanes] += part * a.astype(U) + rest * value.astype(U)
            s.range[lanes] = rest
            s.counts[lanes, kind] += 24
            flush(lanes)
        s.learn(k, x)
    for shift in (48, 32, 16, 0):
        out[s.at, used] = ((s.low >> U(shift)) & U(0xFFFF)).astype(np.uint16)
        used += 1
    bodies = [out[i, : used[i]].astype(">u2").tobytes() for i in range(n)]
    sums = [zlib.crc32(rows[i, : lengths[i]].astype("<u4").tobytes()) for i in range(n)]
    table = np.array([lengths, [len(b) for b in bodies], sums], dtype="<u4").T
    return head + table.tobytes() + b"".join(bodies)


def decode(file: bytes) -> np.ndarray:
    """The ids of a file; raises ValueError if it is damaged."""
    if len(file) < 16 or file[:4] != MAGIC:
        raise ValueError("not a token file")
    _, version, size, n = struct.unpack_from("<4sIII", file)
    if version != VERSION or len(file) < 16 + 12 * n:
        raise ValueError("unknown version or truncated token file")
    if not n:
        return np.zeros(0, np.uint32)
    table = np.frombuffer(file, "<u4", 3 * n, 16).reshape(n, 3).astype(np.int64)
    lengths, sizes = table[:, 0], table[:, 1]
    starts = 16 + 12 * n + np.cumsum(sizes) - sizes
    if starts[-1] + sizes[-1] != len(file):
        raise ValueError("truncated token file")
    words = np.zeros((n, sizes.max() // 2 + 8), np.uint16)
    for i in range(n):
        words[i, : sizes[i] // 2] = np.frombuffer(file, ">u2", sizes[i] // 2, starts[i])
    s = Lanes(n)
    code, used = np.zeros(n, U), np.full(n, 4)
    for j in range(4):
        code = code << U(16) | words[:, j].astype(U)
    steps = np.zeros((size, n), np.int64)

    def fill(lanes: np.ndarray) -> None:
        lanes = s.settled(lanes)
        while len(lanes):
            more = words[lanes, np.minimum(used[lanes], words.shape[1] - 1)].astype(U)
            code[lanes] = code[lanes] << U(16) | more
            used[lanes] += 1
            s.shift(lanes)
            lanes = s.settled(lanes)

    for t in range(lengths.max()):
        k = n if t < lengths[-1] else n - 1
        s.predict(k, t)
        part = s.range[:k] >> U(16)
        seen = np.minimum((code[:k] - s.low[:k]) // np.maximum(part, U(1)), U(65535)).astype(np.int64)
        first = seen < s.first
        second = ~first & (seen < s.first + s.second)
        x = np.where(first, s.id2, s.id1).astype(np.int64)
        below = np.where(first, 0, np.where(second, s.first, s.first + s.second)).astype(U)
        share = np.where(first, s.first, np.where(second, s.second, 65536 - s.first - s.second)).astype(U)
        s.low[:k] += part * below
        s.range[:k] = part * share
        fill(s.at[:k])
        lanes = np.flatnonzero(~(first | second))
        if len(lanes):
            total = s.sums[lanes, -1]
            part = s.range[lanes] // total.astype(U)
            seen = np.minimum(((code[lanes] - s.low[lanes]) // np.maximum(part, U(1))).astype(np.int64), total - 1)
            kind = np.zeros(len(lanes), np.int64)
            for half in (64, 32, 16, 8, 4, 2, 1):
                kind += half * (s.sums[lanes, kind + half] <= seen)
            bits = np.where(kind < 16, 0, (kind - 16) // 8 + 1)
            a, b = s.sums[lanes, kind], s.sums[lanes, kind + 1]
            rest = part * (b - a).astype(U) >> bits.astype(U)
            value = (code[lanes] - s.low[lanes] - part * a.astype(U)) // np.maximum(rest, U(1))
            value = np.minimum(value.astype(np.int64), (1 << bits) - 1)
            s.low[lanes] += part * a.astype(U) + rest * value.astype(U)
            s.range[lanes] = rest
            s.counts[lanes, kind] += 24
            x[lanes] = np.where(kind < 16, kind, ((8 + (kind - 16) % 8) << bits) + value)
            fill(lanes)
        s.learn(k, x)
        steps[t, :k] = x
    rows = np.ascontiguousarray(steps.T)
    for i in range(n):
        if zlib.crc32(rows[i, : lengths[i]].astype("<u4").tobytes()) != table[i, 2]:
            raise ValueError(f"block {i} of a token file is damaged")
    return rows.reshape(-1)[: int(lengths.sum())].astype(np.uint32)
