"""Forms for large groups give what the plain forms give."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flightframe.functions.boxes import Box
from flightframe.operators.overlap import _celled, _level, join_meeting_boxes
from flightframe.operators.references import active_references
from flightframe.plans.intervals import IntervalIndex
from flightframe.plans.percentiles import grouped_percentiles
from flightframe.plans.scans import axis_of, ranged_axis, scan

rng = np.random.default_rng(7)


def test_percentiles_of_large_groups(spark):
    # One group holds most rows; values repeat and are skewed.
    data = pd.DataFrame({"g": np.where(rng.random(3000) < 0.8, 1, rng.integers(2, 6, 3000)), "v": np.round(rng.lognormal(0, 3, 3000), 2)})
    df = spark.createDataFrame(data)
    probs = [0.05, 0.25, 0.5, 0.9, 0.95]
    for limit in (40, 1_000_000):
        got = {r["g"]: r["v"] for r in grouped_percentiles(df, ["g"], {"v": F.col("v")}, probs, limit).collect()}
        for g, part in data.groupby("g"):
            np.testing.assert_allclose(got[g], np.percentile(part.v, np.array(probs) * 100), rtol=1e-12)
        counted = df.groupBy("g", "v").count()
        again = {r["g"]: r["v"] for r in grouped_percentiles(counted, ["g"], {"v": F.col("v")}, probs, limit, F.col("count")).collect()}
        assert all(np.allclose(again[g], got[g], rtol=1e-12) for g in got)


@pytest.mark.parametrize("limit", [7, 10_000])
def test_scan_over_chunks(spark, limit):
    data = pd.DataFrame({"s": np.where(np.arange(200) % 5 == 0, 2, 1), "seq": np.arange(200) * 3, "v": rng.integers(0, 9, 200)})
    data["mark"] = np.where(data.v == 4, data.seq, np.nan)
    cut, axis = axis_of(spark.createDataFrame(data), ["s"], "seq", limit)
    assert axis.chunked == (limit == 7)
    mark = F.when(F.col("v") == 4, F.col("seq"))
    got = scan(cut, axis, before={"b": mark}, upto={"u": mark}, sums={"t": F.col("v")}).toPandas().sort_values(["s", "seq"])
    for s, part in data.groupby("s"):
        mine = got[got.s == s]
        assert (mine.t.values == part.v.cumsum().values).all()
        np.testing.assert_array_equal(mine.u.astype(float).values, part.mark.ffill().values)
        np.testing.assert_array_equal(mine.b.astype(float).values, part.mark.ffill().shift().values)


def test_ranged_axis_numbers_in_order(spark):
    names = [f"n{i:04d}" for i in rng.permutation(150)]
    ordered, axis = ranged_axis(spark.createDataFrame(pd.DataFrame({"n": names})), [], ["n"])
    got = scan(ordered, axis, sums={"i": F.lit(1)}).select("n", "i").toPandas().sort_values("i")
    assert list(got.n) == sorted(names)


def test_chunks_go_by_rank(spark):
    """A far value, dense stretches and groups of unlike sizes: no chunk is above twice the limit, and chunks are in order."""
    far = [(1, i) for i in range(1999)] + [(1, 10**15)]
    steep = [(2, int(1.02**i) + i) for i in range(1200)]
    small = [(3, i) for i in range(50)]
    cut, axis = axis_of(spark.createDataFrame(far + steep + small, "s long, seq long").repartition(5), ["s"], "seq", 100)
    got = cut.toPandas().sort_values(["s", "seq"])
    assert axis.chunked and len(got) == len(far) + len(steep) + len(small)
    sizes = got.groupby(["s", "_chunk"]).size()
    assert sizes.max() <= 200 and sizes.loc[1].size >= 15 and sizes.loc[3].size == 1
    assert (got.groupby("s")._chunk.diff().dropna() >= 0).all()


def test_ranges_cut_intervals_once(spark):
    """Every point meets every interval that holds it once, with open ends, single points and far bounds."""
    top = 1 << 40
    windows = [(None, None), (None, 7), (3, None), (0, 0), (5, 4), (-9, -2), (-1, 12), (17, 1000), (top - 3, top + 5), (None, -(1 << 61)), (1 << 61, None)]
    windows += [tuple(sorted(rng.integers(-20, 60, 2).tolist())) for _ in range(60)]
    points = [None, *range(-25, 70), top - 4, top, top + 6, (1 << 61) - 1, -(1 << 61)]
    left = spark.createDataFrame([(i % 2, p) for i, p in enumerate(points)], "session int, at long")
    right = spark.createDataFrame([(i % 2, i, *w) for i, w in enumerate(windows)], "session int, w int, a long, b long")
    index = IntervalIndex(right, ["session"], "a", "b")
    got = Counter((r.session, r.at, r.w) for r in index.holding(left, "at").collect())
    placed = lambda v: max(-(1 << 61), min(v, (1 << 61) - 1))
    holds = lambda p, a, b: (a is None and b is None) or (p is not None and (a is None or p >= placed(a)) and (b is None or p <= placed(b)))
    wanted = Counter((i % 2, p, j) for i, p in enumerate(points) for j, (a, b) in enumerate(windows) if i % 2 == j % 2 and holds(p, a, b))
    assert got == wanted and index.rows.groupBy("w").count().agg(F.max("count")).first()[0] <= 2 * 62


def test_windows_of_a_hot_session_are_looked_up(spark):
    """A million windows of one session: the frames meet only those in force, and the plan compares no windows in a loop."""
    windows = spark.range(1_000_000).select(
        F.lit(1).alias("session"), F.col("id").alias("object_id"), (F.col("id") * 3).alias("active_from"), (F.col("id") * 3 + F.col("id") % 7).alias("active_until"))
    frames = spark.range(2000).select(F.lit(1).alias("session"), (F.col("id") * 1499).alias("frame_index"))
    found = active_references(frames, windows)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_i_node" in plan
    wanted = sum(1 for f in range(0, 2000 * 1499, 1499) for i in range(max(0, f // 3 - 3), f // 3 + 1) if i < 1_000_000 and 3 * i <= f <= 3 * i + i % 7)
    assert found.count() == wanted > 2000


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_meeting_boxes_in_large_frames(spark, how):
    def boxes(n, p):
        x, y = rng.random(n) * 900, rng.random(n) * 500
        return pd.DataFrame({"f": np.where(np.arange(n) % 4 == 0, 2, 1), f"{p}i": np.arange(n), f"{p}x1": x, f"{p}y1": y, f"{p}x2": x + rng.random(n) * 90, f"{p}y2": y + rng.random(n) * 90})

    a, b = spark.createDataFrame(boxes(90, "a")), spark.createDataFrame(boxes(40, "b"))
    box = lambda p: Box(*[F.col(f"{p}{n}") for n in ("x1", "y1", "x2", "y2")])
    run = lambda rows: join_meeting_boxes(a, b, ["f"], box("a"), box("b"), how=how, salt_by=["ai"], rows=rows).toPandas()
    key = ["f", "ai"] + ([] if how == "left_anti" else ["bi"])
    plain, spread = run(10_000)[key], run(5)[key]
    tidy = lambda d: sorted(map(tuple, d.fillna(-1).astype(int).values))
    assert len(plain) > 0 and tidy(plain) == tidy(spread)


def test_a_huge_box_in_a_large_frame_has_few_cells(spark):
    """Boxes over millions of pixels, points and endless ones: each lies in four cells a level, and pairs come once."""
    n = 400
    x, y = rng.random(n) * 3e6, rng.random(n) * 3e6
    wide = np.where(np.arange(n) % 40 == 0, 2.5e6, rng.random(n) * 200)
    a = pd.DataFrame({"f": 1, "ai": np.arange(n), "ax1": x, "ay1": y, "ax2": x + wide, "ay2": y + wide})
    a.loc[0, ["ax1", "ay1", "ax2", "ay2"]] = [-np.inf, -np.inf, np.inf, np.inf]
    x, y = rng.random(n) * 3e6, rng.random(n) * 3e6
    b = pd.DataFrame({"f": 1, "bi": np.arange(n), "bx1": x, "by1": y, "bx2": x + np.arange(n) % 3 * 1e5, "by2": y + np.arange(n) % 2 * 1e6})
    box = lambda p: Box(*[F.col(f"{p}{n}") for n in ("x1", "y1", "x2", "y2")])
    left, right = spark.createDataFrame(a), spark.createDataFrame(b)
    got = join_meeting_boxes(left, right, ["f"], box("a"), box("b"), salt_by=["ai"], rows=50).select("ai", "bi").toPandas()
    cross = a.merge(b, on="f")
    meet = cross[(cross.ax1 <= cross.bx2) & (cross.bx1 <= cross.ax2) & (cross.ay1 <= cross.by2) & (cross.by1 <= cross.ay2)]
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, meet[["ai", "bi"]].values)) and len(meet) > n
    levels = list(range(46))
    cells = _celled(left.withColumn("_la", _level(box("a"), 64.0)), box("a"), "_la", levels, 64.0).groupBy("ai", "_l").count()
    assert cells.agg(F.max("count")).first()[0] <= 4


def test_open_windows_are_few_ranges_and_not_broadcast(spark):
    """A window without an end has as many ranges as the bounds that occur ask for, and the index is not sent whole."""
    windows = spark.range(3000).select(
        (F.col("id") % 5).alias("session"), F.col("id").alias("object_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("active_from"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 50 + 8).alias("active_until"))
    index = IntervalIndex(windows, ["session"], "active_from", "active_until")
    assert len(index.levels) <= 8 and index.rows.groupBy("object_id").count().agg(F.max("count")).first()[0] <= 12
    frames = spark.range(-3, 70).select(F.explode(F.expr("sequence(0L, 4L)")).alias("session"), F.when(F.col("id") < 69, F.col("id")).alias("frame_index"))
    found = active_references(frames, windows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    holds = F.expr("(active_from is null and active_until is null) or (frame_index is not null and frame_index >= coalesce(active_from, -99) and frame_index <= coalesce(active_until, 99))")
    assert found.count() == frames.join(windows, "session").where(holds).count() > 1000
