"""Boxes of many frames worked out side by side, in one pass over each frame."""

import numpy as np
import pytest

from flightframe.operators import regions as G

rng = np.random.default_rng(9)
COLUMNS = "f long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double, peak double"


def test_frames_of_like_size_are_grouped_together(monkeypatch):
    """Rows of boxes, clusters, lone boxes and frames of more boxes than are compared side by side: as frame by frame."""
    sizes = np.array([1, 2, 3, 7, 3, 40, 90, 0, 1, 5] * 6)
    n = int(sizes.sum())
    x1, y1 = rng.uniform(0, 60, n), rng.uniform(0, 60, n)
    sides = [x1, y1, x1 + rng.uniform(1, 6, n), y1 + rng.uniform(1, 6, n)]
    starts = np.cumsum(sizes) - sizes
    for gap in (0.0, 2.0, 5.0):
        alone = np.concatenate([G._chained(*[s[a : a + k] for s in sides], gap) for a, k in zip(starts, sizes) if k])
        assert (G._chained_frames(sides, sizes, gap) == alone).all()
    # Small frames never take a pass of their own.
    monkeypatch.setattr(G, "_chained", None)
    small = sizes <= G._ALIKE
    kept = np.repeat(small, sizes)
    assert len(G._chained_frames([s[kept] for s in sides], sizes[small], 2.0)) == kept.sum()


def _frames(n: int) -> tuple[list, list]:
    boxes, second = [], []
    for f in range(n):
        for i in range(int(rng.integers(1, 12))):
            x, y = rng.integers(0, 80, 2).tolist()
            boxes.append((f, i, float(x), float(y), float(x + rng.integers(5, 40)), float(y + rng.integers(5, 40)), float(rng.random()), float(rng.random())))
        for _ in range(f % 4):
            x, y = rng.integers(0, 80, 2).tolist()
            second.append((f, float(x), float(y), float(x + 30), float(y + 30)))
    return boxes, second


def test_agreement_is_the_same_in_one_pass_and_in_rounds(spark):
    """Frames with none to three second boxes, and a box that comes twice."""
    boxes, second = _frames(60)
    one, two = spark.createDataFrame([*boxes, boxes[0]], COLUMNS), spark.createDataFrame(second, "f long, x1 double, y1 double, x2 double, y2 double")
    told = lambda rows: sorted(tuple(r) for r in G.agree_and_merge(one, two, ["f"], rows=rows).collect())
    assert told(1000) == told(0) == told(5)
    merged = [r for r in told(1000) if r[-1]]
    assert 20 < len(merged) < 60


def test_agreement_of_small_frames_takes_three_shuffles(spark):
    boxes, second = _frames(20)
    one, two = spark.createDataFrame(boxes, COLUMNS), spark.createDataFrame(second, "f long, x1 double, y1 double, x2 double, y2 double")
    out = G.agree_and_merge(one, two.hint("merge"), ["f"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 3, plan
