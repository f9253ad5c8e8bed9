"""Counting of 64-bit names over all blocks of a table, packed: arrays instead of rows.

A block asks with its distinct names, one row per range of names; a range adds up what all blocks ask and answers in the
same order. So a name crosses the network once per block, and one that is frequent everywhere weighs no more than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from candlewick.llm.textarrays import trimmed

ASK = "block int, range int, names binary, counts binary"
ANSWER = "block int, range int, mask binary, more binary"


def ranges_of(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class Asked:
    """The distinct names of a block, ascending, their counts, and the bounds of the ranges in them."""

    def __init__(self, names: np.ndarray, ranges: int):
        self.names, self.counts = np.unique(names, return_counts=True)
        self.ranges = ranges
        self.bounds = np.searchsorted(ranges_of(self.names, ranges), np.arange(ranges + 1))

    def rows(self, block: int) -> pa.Table:
        cuts = list(zip(self.bounds[:-1], self.bounds[1:]))
        counts = self.counts.astype(np.uint32)
        return pa.table(
            {
                "block": pa.array([block] * self.ranges, pa.int32()),
                "range": pa.array(range(self.ranges), pa.int32()),
                # ascending names as differences: within a range their leading bytes are mostly zero
                "names": pa.array([planes(np.diff(self.names[a:b], prepend=np.uint64(0))) for a, b in cuts], pa.binary()),
                "counts": pa.array([planes(counts[a:b]) for a, b in cuts], pa.binary()),
            }
        )

    def totals(self, answers: pa.Table) -> np.ndarray:
        """The count of each name over all blocks, from the rows that came back."""
        found = np.ones(len(self.names), dtype=np.int64)
        for i, mask, more in zip(*(answers.column(c).to_pylist() for c in ("range", "mask", "more"))):
            if i >= 0:
                a, b = self.bounds[i], self.bounds[i + 1]
                hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
                found[a:b][hit] = unplanes(more, np.uint32)
        return found


@trimmed
def answer(table: pa.Table) -> pa.Table:
    """Per block, the counts over all blocks of the names it asked for: a bit where above one, then those."""
    names = [np.cumsum(unplanes(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("names")]
    counts = np.concatenate([unplanes(x.as_py(), np.uint32) for x in table.column("counts")])
    values, inverse = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.uint32)[inverse]
    masks, more, at = [], [], 0
    for name in names:
        own = total[at : at + len(name)]
        at += len(name)
        masks.append(np.packbits(own > 1).tobytes())
        more.append(planes(own[own > 1]))
    return pa.table(
        {
            "block": table.column("block"),
            "range": table.column("range"),
            "mask": pa.array(masks, pa.binary()),
            "more": pa.array(more, pa.binary()),
        }
    )


def answer_or_pass(table: pa.Table) -> pa.Table:
    """`answer`; a negative range is the state of one block, which comes back as it is."""
    if table.column("range")[0].as_py() >= 0:
        return answer(table)
    return table.rename_columns(["block", "range", "mask", "more"])


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal significance together, so that high zero bytes compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)
