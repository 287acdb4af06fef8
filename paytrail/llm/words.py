"""Words of whole texts as 64-bit hashes, one vectorised pass per Arrow batch.

A word's hash is a polynomial over random 64-bit values of its bytes, mixed at the end. Two different words meet with a chance of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paytrail.llm.memory import AT_END

SLICE_BYTES = 1 << 20

_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C17 | 3
_Q = np.uint64(0xD1342543DE82EF95)
_POWERS: list[np.ndarray] = []
AT_END.append(_POWERS.clear)

#: Bytes that words consist of: all but white space.
GRAPHIC = np.ones(256, bool)
GRAPHIC[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that words consist of: digits, letters, and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_LOWERED = _BYTE[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_P, pow(_P, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[:] = out if size <= 4 * SLICE_BYTES else []
        return out
    return _POWERS


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the offsets between them. Null is the empty text."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(col) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` bytes of text each; a longer text makes a piece of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    at = 0
    while at < len(size):
        ends = np.cumsum(size[at:])
        n = max(1, int(np.searchsorted(ends, most, "right")))
        yield batch.slice(at, n)
        at += n


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Full pieces of all rows, up to ``most`` bytes of text each, whatever the size of the batches; a longer text makes a piece of its own."""
    held, room = [], most
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        at = 0
        while at < len(size):
            n = max(int(np.searchsorted(np.cumsum(size[at:]), room, "right")), not held)
            if n:
                held.append(batch.slice(at, n))
                room -= int(size[at : at + n].sum())
                at += n
            if at < len(size):
                yield pa.concat_batches(held)
                held, room = [], most
    if held:
        yield pa.concat_batches(held)


@dataclass
class Words:
    """``doc``: index of the text each word is in; ``start``/``end``: its bytes; ``bounds``: first word of each text, and the end."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray
    total: np.ndarray
    inverse: np.ndarray

    def prefix(self, k: int) -> np.ndarray:
        """Hashes of the first ``k`` bytes of the words that are longer; 0 for the others. Different from any whole word's hash."""
        long = self.end - self.start > k
        out = np.zeros(len(self.start), np.uint64)
        at = self.start[long]
        out[long] = mix((self.total[at + k] - self.total[at]) * self.inverse[at] + np.uint64(k << 56 | 1))
        return out


def words(col: pa.Array, letters: np.ndarray = GRAPHIC, fold: bool = True) -> Words:
    """``letters``: the bytes that words consist of; ``fold``: A-Z count as a-z."""
    data, offsets = utf8(col)
    n = len(data)
    inside = letters.take(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(np.multiply((_LOWERED if fold else _BYTE).take(data), power[:n]), out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start])
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(hashed, doc, start, end, bounds, offsets, total, inverse)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, and the bounds by text. A text of fewer words is one shingle; one without words has none."""
    count = np.diff(w.bounds)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(len(count)), made)
    at = np.arange(bounds[-1]) - bounds[doc] + w.bounds[doc]
    size = np.minimum(count, width)[doc]
    out = size.astype(np.uint64)
    for k in range(width):
        inside = size > k
        out = out * _Q
        out[inside] += w.hash[at[inside] + k]
    return mix(out), bounds
