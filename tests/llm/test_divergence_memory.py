"""A task's work areas while terms are counted."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flightframe.llm import divergence as D


def test_counting_terms_needs_little_memory():
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (600_000, 6), dtype=np.uint8)
    letters[:, 5], letters[:, :2] = 32, 97
    texts = [letters[i : i + 1000].tobytes().decode() for i in range(0, len(letters), 1000)]
    batch = pa.RecordBatch.from_pydict({"modality": ["a"] * 600, "video": ["v", "w"] * 300, "xml": texts})
    list(D._terms([batch.slice(0, 1)]))
    tracemalloc.start()
    try:
        n = sum(pc.sum(out["n"]).as_py() for out in D._terms([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 600_000 and peak < 14 * letters.size, peak / letters.size
