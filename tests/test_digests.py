"""Digests in numpy, and the hypotheses that are drawn by them."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from flightframe.functions.digests import Digests
from flightframe.operators import motion_fit as MF
from flightframe.policies import CameraModel, MotionFitPolicy


def test_digests_are_those_of_each_text():
    draw = random.Random(3)
    for names, most in ((["", "7", "1234567890123", "ü" * 20, "x" * 50], 250), (["y" * 51, "z" * 90], 250), (["a", "bc"], 20_000)):
        digests = Digests(pa.array(["first", *names, "last"]).slice(1, len(names)), b":", most)
        row, number = (np.array([draw.randrange(n) for _ in range(3000)]) for n in (len(names), most + 1))
        found = [hashlib.md5(f"{names[i]}:{n}".encode()).hexdigest() for i, n in zip(row, number)]
        for got, low in zip(digests.numbers(row, number), (0, 13)):
            assert got.tolist() == [int(f[low : low + 13], 16) for f in found]


def test_models_in_numpy_are_those_of_columns(spark):
    """Listed pairs draw and solve in numpy, large ones in columns: the same hypotheses and models to the last digit, also for
    long names, tracks that come twice, and tracks without a name."""
    draw = random.Random(5)
    rows = []
    for pair in range(12):
        for n in range(draw.randrange(12, 70)):
            name = None if n == 3 else "long" * 14 + str(n) if pair == 2 else str(n * 10**pair)
            x, y = draw.uniform(0, 500), draw.uniform(0, 400)
            rows += [(pair, name, x, y, x + draw.uniform(-3, 3), y + draw.uniform(-3, 3))] * (2 if n == 5 else 1)
    tracks = spark.createDataFrame(rows, "pair long, track_id string, x0 double, y0 double, x1 double, y1 double")
    sizes = tracks.groupBy("pair").count().withColumnRenamed("count", "tracked")
    camera, policy = CameraModel(cx=250.0, cy=200.0), MotionFitPolicy()
    told = lambda models: sorted(tuple(r) for r in models.selectExpr("pair", "inline(_m)").collect())
    listed = MF._triples(tracks, ["pair"], "track_id", policy, camera)
    got, want = told(listed), told(MF._triples_of_large(tracks, sizes, ["pair"], "track_id", policy, camera))
    assert len(got) > 1500 and got == want
    assert "md5" not in listed._jdf.queryExecution().executedPlan().toString()
