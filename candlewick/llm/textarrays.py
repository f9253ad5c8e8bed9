"""Words and hashes of many texts at once, as NumPy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable
from functools import lru_cache, wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
# Words of more bytes are hashed one by one.
LONG_WORD = 256


def trim() -> None:
    """Hand freed memory back to the system: workers outlive tasks and stages, and what they keep is taken from others."""
    pa.default_memory_pool().release_unused()
    # only glibc keeps what was freed and has this call
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if give_back is not None:
        give_back(0)


def trimmed(function: Callable) -> Callable:
    """`function` of one group of rows, or of one of each side, after which the worker is trimmed."""

    def one(table):
        try:
            return function(table)
        finally:
            trim()

    def both(left, right):
        try:
            return function(left, right)
        finally:
            trim()

    # Spark looks at the number of arguments
    return wraps(function)(one if function.__code__.co_argcount == 1 else both)



def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row and the offsets of the texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):  # no chunk at all
            texts = pa.array([], texts.type)
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, 9, 10, 11, 12, 13]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    value = mix(np.arange(1, 257, dtype=np.uint64))  # a value per byte, so that runs of bytes do not cancel out
    return blank, lower, value


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)

    def powers(x: int) -> np.ndarray:
        found = np.array([1], dtype=np.uint64)
        while len(found) < n:
            step = np.uint64(pow(x, len(found), 1 << 64))
            found = np.concatenate([found, found * step])
        return found[:n]

    return powers(base), powers(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of any substrings of `data`, each in constant time: a polynomial modulo 2**64 under a bijection.

    Certain regular strings of some hundred bytes or more collide whatever the base; `span_hashes` has no such pairs.
    """

    def __init__(self, data: np.ndarray):
        _, _, value = _tables()
        size = 1 << max(18, int(len(data) + 1).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(value[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[begins]) * self.inverse[begins] + (ends - begins).astype(np.uint64))


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of substrings of `data`, eight bytes after eight; those of one length up to eight bytes are all different."""
    left = (ends - begins).astype(np.int64)
    found = mix(left.astype(np.uint64) * _ODD)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each position on
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        found[i] = int.from_bytes(blake2b(data[begins[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    on = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    at, left = begins[on], left[on]
    while len(on):
        found[on] = mix(found[on] ^ (eight[at] & masks[np.minimum(left, 8)]))
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    return found


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word `[^\\x20\\x09-\\x0D]+` and the text that it stands in."""
    blank, _, _ = _tables()
    solid = ~blank[data]
    first = np.zeros(len(data), dtype=bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:]
    stops = solid
    stops[:-1] &= ~solid[1:] | first[1:]
    begins, ends = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return begins, ends, np.searchsorted(offsets, begins, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    return _tables()[1][data]


def parts(offsets: np.ndarray, limit: int = (1 << 20) - 4096) -> list[tuple[int, int]]:
    """Text ranges of at most `limit` bytes, or of one text."""
    found, first = [], 0
    while first < len(offsets) - 1:
        stop = max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1)
        found.append((first, stop))
        first = stop
    return found


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and text number of every word, and the number of texts."""
    data, offsets = flat(texts)
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, stop in parts(offsets):
        piece = data[offsets[first] : offsets[stop]]
        begins, ends, owner = words(piece, offsets[first : stop + 1] - offsets[first])
        hashes.append(span_hashes(lowered(piece) if lower else piece, begins, ends))
        owners.append(owner + first)
    return np.concatenate(hashes), np.concatenate(owners), len(offsets) - 1


def shingles(hashes: np.ndarray, owner: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of `size` words, distinct within a text and ascending by text and hash.

    A text with fewer words has its whole sequence as one shingle, a text without words none.
    """
    counts = np.bincount(owner, minlength=texts)
    firsts = np.cumsum(counts) - counts
    runs = len(hashes) - size + 1
    found, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if runs > 0:
        whole = owner[:runs] == owner[size - 1 :]
        found = np.full(runs, _ODD)
        for j in range(size):
            found = mix(found + hashes[j : j + runs])
        found, text = found[whole], owner[:runs][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        value = np.full(len(short), _ODD)
        for j in range(size - 1):
            more = counts[short] > j
            value[more] = mix(value[more] + hashes[firsts[short[more]] + j])
        value = mix(value + counts[short].astype(np.uint64))
        found, text = np.concatenate([found, value]), np.concatenate([text, short])
    order = np.argsort(found, kind="stable")
    found, text = found[order], text[order]
    order = np.argsort(text.astype(np.uint16) if texts < 65536 else text, kind="stable")
    found, text = found[order], text[order]
    if len(found):
        keep = np.ones(len(found), dtype=bool)
        keep[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        found, text = found[keep], text[keep]
    return found, text
