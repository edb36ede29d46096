"""Work on distinct pieces of text once per Python worker."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa


class Lexicon:
    """Results of ``work``, which gets a list of distinct pieces and returns as many results.

    Results stay for later batches in two generations: beyond ``most`` pieces, or ``size`` characters of them, the
    younger one grows old, and what is not met again before the next turn is forgotten and worked out anew.
    """

    def __init__(self, work: Callable[[list[str]], list[Any]], most: int = 250_000, size: int = 16_000_000) -> None:
        self.work, self.most, self.size, self.held, self.known, self.old = work, most, size, 0, {}, {}

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, list[Any]]:
        """The place of each piece's result, and the results of the distinct pieces of this call."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.most or self.held > self.size:
            self.known, self.old, self.held = {}, self.known, 0
        known, old = self.known, self.old
        missing = [p for p in distinct if p not in known]
        known.update({p: old[p] for p in missing if p in old})
        new = [p for p in missing if p not in known]
        known.update(zip(new, self.work(new)))
        self.held += sum(map(len, missing))
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [known[p] for p in distinct]


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of ragged rows one behind the other: ``lengths[i]`` places from ``first[i]`` on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)


def ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: row i holds ``values[bounds[i]:bounds[i + 1]]``."""
    places = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(values))])
