"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

Texts repeat their words, so a batch is split at spaces, each distinct piece is encoded once, and the ids of a text are
the ids of its pieces in a row. A space that follows a non-blank, or precedes one, always starts a token of the byte
level pattern, so the ids equal those of the whole text; texts with a space between blanks or with a special token are
encoded as a whole. Null texts count as empty.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from candlewick.llm.textarrays import trim

# white space of any kind around a space, or the name of a special token
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_WHOLE = _BLANK + " (" + _BLANK + "|$)"
_PLAIN = r"^[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+$"
SLICE_BYTES = 4 << 20  # the arrays of a slice take some twenty times its text
# Bytes of distinct words and their ids that an encoder keeps for later texts; beyond, it starts anew.
CACHE_BYTES = 64 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    found, first, base = [], 0, 0
    while first < len(ends):
        stop = max(int(np.searchsorted(ends, base + limit, "right")), first + 1)
        found.append((first, stop))
        first, base = stop, ends[stop - 1]
    return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def release() -> None:
    """Give back what encoders of an earlier stage still hold in this worker: workers outlive stages and queries, and two
    of them with a vocabulary and its words take some 250 MB of an executor that the stages after have no use for."""
    if not encoder.cache_info().currsize:
        return
    encoder.cache_clear()
    trim()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts_with_space = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.starts_with_space[[i for t, i in tokens.items() if t.startswith("Ġ")]] = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_WHOLE, *(pc_escape(t) for t in special)])
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.begins, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Begins in `self.ids` and lengths of distinct words, each with a space before it."""
        words = words.cast(pa.string())
        if self.known.nbytes + self.ids.nbytes + self.begins.nbytes + self.lengths.nbytes > CACHE_BYTES:
            self._forget()
        index = pc.index_in(words, value_set=self.known)
        fresh = words.filter(pc.is_null(index))
        if len(fresh):
            ids, lengths = self._words(fresh)
            ends = len(self.ids) + np.cumsum(lengths)
            self.begins = np.concatenate([self.begins, ends - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        at = np.array(pc.fill_null(index, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at[pc.is_null(index).to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        return self.begins[at], self.lengths[at]

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct word with a space before it: all ids in a row, and the length of each."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        lengths, parts = np.zeros(len(words), dtype=np.int64), [None] * len(words)
        order, ids = [], []
        index = np.flatnonzero(plain)
        for at in range(0, len(index), 20_000):
            chunk = index[at : at + 20_000]
            line = " " + " ".join(words.take(pa.array(chunk)).to_pylist())
            got = np.array(self.tokenizer.encode(line, add_special_tokens=False).ids, dtype=np.uint32)
            firsts = np.flatnonzero(self.starts_with_space[got])
            lengths[chunk] = np.diff(np.append(firsts, len(got)))
            ids.append(got)
            order.append(chunk)
        index = np.flatnonzero(~plain)
        parts = self._each([" " + w for w in words.take(pa.array(index)).to_pylist()])
        lengths[index] = [len(p) for p in parts]
        order.append(index)
        order, ids = np.concatenate(order), np.concatenate([*ids, *parts, np.zeros(0, np.uint32)])
        # from the order of encoding to that of the words
        ends = np.cumsum(lengths[order])
        begins = np.empty(len(words), dtype=np.int64)
        begins[order] = ends - lengths[order]
        return ids[spread(begins, lengths)], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) and the offsets of the texts in them."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        pieces = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py())
        firsts = split.offsets.to_numpy().astype(np.int64)
        firsts = firsts - firsts[0]
        coded = pieces.dictionary_encode()
        begins, lengths = self._lookup(coded.dictionary)
        ids = self.ids
        # the first piece of a text has no space before it; a text encoded as a whole has this piece alone
        heads = pc.if_else(pa.array(whole), texts, pieces.take(pa.array(firsts[:-1])))
        heads = heads.dictionary_encode()
        parts = self._each(heads.dictionary.to_pylist())
        begins = np.concatenate([begins, len(ids) + np.cumsum([0, *map(len, parts)])[:-1]])
        words = coded.indices.to_numpy().astype(np.int64)
        words[firsts[:-1]] = len(lengths) + heads.indices.to_numpy()
        lengths = np.concatenate([lengths, np.array([len(p) for p in parts], dtype=np.int64)])
        ids = np.concatenate([ids, *parts])
        each = lengths[words]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids[spread(begins[words], each)], ends[firsts]


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each range, all ranges in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(total)


def pc_escape(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)
