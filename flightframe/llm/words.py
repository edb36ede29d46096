"""Words of many texts at once: numpy over the bytes of an Arrow column.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Words and shingles are 64-bit hashes, equal in every process; work areas are bounded by
``PIECE`` bytes plus the longest word, whatever the size of a batch.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_BASE = U(0x5851F42D4C957F2D)
_UNDO = U(pow(0x5851F42D4C957F2D, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value scattered over all 64 bits, one to one."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = mixed(np.arange(1, 257, dtype=U) * _STEP)
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _UNDO)):
            factors = np.full(max(n, PIECE), base, U)
            factors[0] = U(1)
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS[0], _POWERS[1]


class Words(NamedTuple):
    """Words of the texts of a column, in order. ``first[d]:first[d + 1]`` are those of text d;
    ``start`` and ``end`` are byte places in ``data``, ``text[d]`` the place where text d begins."""

    data: np.ndarray
    text: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each text begins, the end included; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(column: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE) -> Words:
    """``lower`` turns A-Z to a-z; ``gaps`` marks the bytes between words."""
    data, text = text_bytes(column)
    inside = ~gaps[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = text[(text > 0) & (text < len(data))]  # a word ends where its text ends
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, text)
    return Words(data, text, first, start, end, _hashes(data, start, end, lower))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(start), U)
    done = 0
    while done < len(start):
        low = start[done]
        upto = max(done + 1, int(np.searchsorted(end, low + PIECE, "right")))
        high = end[upto - 1]
        up, down = _powers(high - low)
        piece = data[low:high]
        sums = np.zeros(high - low + 1, U)
        np.cumsum(_BYTE[LOWER[piece] if lower else piece] * up[: high - low], out=sums[1:])
        a, b = start[done:upto] - low, end[done:upto] - low
        out[done:upto] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U) * _STEP
        done = upto
    return mixed(out)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours; runs reach over the ends of texts, the caller picks."""
    n = max(0, len(hashes) - k + 1)
    acc = np.zeros(n, U)
    for j in range(k):
        acc *= _BASE
        acc += hashes[j : j + n]
    return mixed(acc + U(k))


class Shingles(NamedTuple):
    first: np.ndarray
    hash: np.ndarray


def shingles_of(words: Words, k: int = 5) -> Shingles:
    """All runs of k words of each text, in order and with repeats; a text of fewer words gives its
    whole sequence as one, a text without words gives none."""
    counts = np.diff(words.first)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(first[-1], U)
    long = counts >= k
    if long.any():
        owner = np.repeat(np.arange(len(counts)), per * long)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(per * long) - per * long, per * long)
        out[first[owner] + place] = runs(words.hash, k)[words.first[owner] + place]
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            at = words.first[short][:, None] + np.arange(size)
            acc = np.zeros(len(short), U)
            for j in range(size):
                acc = acc * _BASE + words.hash[at[:, j]]
            out[first[short]] = mixed(acc + U(size))
    return Shingles(first, out)


def sets_of(shingles: Shingles) -> Shingles:
    """The distinct shingles of each text, sorted."""
    parts, sizes = [], [0]
    for a, b in zip(shingles.first[:-1], shingles.first[1:]):
        own = np.sort(shingles.hash[a:b])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        sizes.append(len(own))
    return Shingles(np.cumsum(sizes), np.concatenate(parts) if parts else np.zeros(0, U))


def hash_of_text(text: str, lower: bool = False, gaps: np.ndarray = SPACE) -> np.ndarray:
    return words_of(pa.array([text], pa.string()), lower, gaps).hash


def pieces(batches, column: int = 1, size: int = 4 << 20):
    """Batches cut so that none holds more than ``size`` bytes of text, one longer text excepted."""
    for batch in batches:
        lengths = np.diff(text_bytes(batch.column(column))[1])
        begin = 0
        while begin < len(batch):
            total = np.cumsum(lengths[begin:])
            n = max(1, int(np.searchsorted(total, size, "right")))
            yield batch.slice(begin, n)
            begin += n
