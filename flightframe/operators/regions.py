"""Candidate boxes from similarity grids, and merging of candidate boxes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.boxes import Box, box
from flightframe.operators.greedy import keep_best
from flightframe.operators.overlap import join_meeting_boxes
from flightframe.plans.groups import hot_groups, split_hot
from flightframe.plans.settle import settle
from flightframe.policies import LIMITS

_SIDES = ("x1", "y1", "x2", "y2")
# Fixed values of the candidate rules.
MIN_SIDE, MIN_SHARE, MAX_SHARE, MIN_CONFIDENCE, PAD = 8, 0.0005, 0.35, 0.35, 10
ENSEMBLE_PEAK, ENSEMBLE_MIN_SHARE, ENSEMBLE_MAX_SHARE, ENSEMBLE_PAD = 1.4, 0.0001, 0.50, 25


def _shared(a, b) -> tuple[Column, Column, Column]:
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    size = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return width * height, size(a), size(b)


def nms(
    boxes: DataFrame, keys: Sequence[str], item: str = "box_id", iou_above: float = 0.30,
    contain_above: float | None = None, rows: int | None = None,
) -> DataFrame:
    """By falling confidence, keep a box unless it overlaps a kept one too much."""
    keys = list(keys)

    def clash(a, b) -> Column:
        inter, size_a, size_b = _shared(a, b)
        hit = inter / (size_a + size_b - inter) > iou_above
        if contain_above is not None:
            hit = hit | (inter / F.least(size_a, size_b) > contain_above)
        return (inter > 0) & hit

    def clashes(large: DataFrame) -> DataFrame:
        one = large.select(*keys, F.col(item).alias("a"), *[F.col(s).alias(f"a_{s}") for s in _SIDES])
        two = large.select(*keys, F.col(item).alias("b"), *[F.col(s).alias(f"b_{s}") for s in _SIDES])
        pairs = join_meeting_boxes(one, two, keys, box("a_"), box("b_"), salt_by=["a"])
        named = lambda p: {s: F.col(f"{p}_{s}") for s in _SIDES}
        return pairs.where((F.col("a") != F.col("b")) & clash(named("a"), named("b"))).select(*keys, "a", "b")

    kept = keep_best(boxes, keys, item, -F.col("conf"), clash, list(_SIDES), clashes, rows)
    return boxes.join(kept, [*keys, item], "left_semi")


def _chained(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, gap: float) -> np.ndarray:
    """The place of the first box of each box's group, in one small frame."""
    group = np.arange(len(x1))
    while True:
        heads, own = np.unique(group, return_inverse=True)
        hull = [np.full(len(heads), s) for s in (np.inf, np.inf, -np.inf, -np.inf)]
        for side, values, pick in zip(hull, (x1, y1, x2, y2), (np.minimum, np.minimum, np.maximum, np.maximum)):
            pick.at(side, own, values)
        apart = lambda low, high: (low[:, None] - gap > high[None, :]) | (low[None, :] > high[:, None] + gap)
        near = ~(apart(hull[0], hull[2]) | apart(hull[1], hull[3]))
        first = np.where(near, heads[None, :], len(x1)).min(axis=1)
        if (first == heads).all():
            return group
        to = np.arange(len(x1))
        to[heads] = first
        while (to[to] != to).any():
            to = to[to]
        group = to[heads[own]]


#: Frames of up to this many boxes are grouped side by side, about this many comparisons at a time.
_ALIKE, _COMPARED = 64, 1 << 18


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _chained_frames(sides: Sequence[np.ndarray], sizes: np.ndarray, gap: float) -> np.ndarray:
    """``_chained`` of many frames, whose boxes follow each other: those with as many boxes are compared together."""
    starts, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.int32)
    for n in np.unique(sizes[sizes > 1]):
        frames = starts[sizes == n]
        if n > _ALIKE:
            for at in frames:
                out[at : at + n] = _chained(*[side[at : at + n] for side in sides], gap)
            continue
        step = max(1, _COMPARED // int(n * n))
        for part in (frames[i : i + step] for i in range(0, len(frames), step)):
            place = part[:, None] + np.arange(n)
            out[place] = _chained_alike(*[side[place] for side in sides], gap)
    return out


def _chained_alike(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, gap: float) -> np.ndarray:
    """One row per frame. A box takes the lowest place that a box of a group near its own points to, until none is lower;
    groups only grow, and the first box of a group always points to itself."""
    place = np.tile(np.arange(x1.shape[1]), (len(x1), 1))
    left = np.arange(len(x1))
    while len(left):
        now = place[left]
        same = now[:, :, None] == now[:, None, :]
        low = [np.where(same, side[left][:, None, :], np.inf).min(2) for side in (x1, y1)]
        high = [np.where(same, side[left][:, None, :], -np.inf).max(2) for side in (x2, y2)]
        apart = lambda low, high: (low[:, :, None] - gap > high[:, None, :]) | (low[:, None, :] > high[:, :, None] + gap)
        near = ~(apart(low[0], high[0]) | apart(low[1], high[1])) | same
        first = np.where(near, now[:, None, :], x1.shape[1]).min(2)
        first = np.take_along_axis(first, first, 1)
        place[left] = first
        left = left[(first != now).any(1)]
    return place


def chain_merge(boxes: DataFrame, keys: Sequence[str], item: str = "box_id", gap: float = 90.0, rows: int | None = None) -> DataFrame:
    """Merge boxes within ``gap`` of each other until all are apart; confidence is the largest.

    Growing boxes only come nearer to others, so the outcome does not depend on the order. Frames of up to ``rows``
    boxes are grouped in one pass. In larger ones each box points to the lowest-numbered near one, pointers
    are doubled up to their ends, and what meets there becomes one box; rounds end when no boxes are near.
    """
    keys, rows = list(keys), LIMITS.fold_rows if rows is None else rows
    current = settle(boxes.select(*keys, F.col(item).cast("long").alias("id"), *_SIDES, "conf"))
    hot = hot_groups(current, keys, rows)
    small, large = (current, None) if hot is None else split_hot(current, hot, keys)
    entry = F.struct("id", *[F.col(s).cast("double").alias(s) for s in _SIDES], "conf")
    lists = small.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_g"))

    @F.arrow_udf("array<int>")
    def first(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
        sizes = x1.value_lengths().to_numpy()
        to = _chained_frames([_flat(side) for side in (x1, y1, x2, y2)], sizes, gap)
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), to)

    placed = lists.withColumn("_to", first(*[F.col(f"_g.{s}") for s in _SIDES]))
    each = placed.select(*keys, F.explode(F.transform("_g", lambda b, i: F.struct(F.col("_g")[F.col("_to")[i]]["id"].alias("to"), b.alias("b")))).alias("_e"))
    hull = lambda of: [F.min(f"{of}x1").alias("x1"), F.min(f"{of}y1").alias("y1"), F.max(f"{of}x2").alias("x2"), F.max(f"{of}y2").alias("y2"), F.max(f"{of}conf").alias("conf")]
    out = each.select(*keys, F.col("_e.to").alias("id"), "_e.b.*").drop("_e").toDF(*keys, "id", "_own", *_SIDES, "conf").groupBy(*keys, "id").agg(*hull(""))
    if large is not None:
        out = out.unionByName(_chained_rounds(settle(large), keys, gap, hull))
    return out.withColumnRenamed("id", item)


def _chained_rounds(current: DataFrame, keys: list[str], gap: float, hull) -> DataFrame:
    while True:
        one = current.select(*keys, F.col("id").alias("a"), *[F.col(s).alias(f"a_{s}") for s in _SIDES])
        two = current.select(*keys, F.col("id").alias("b"), *[F.col(s).alias(f"b_{s}") for s in _SIDES])
        grown = Box(F.col("a_x1") - gap, F.col("a_y1") - gap, F.col("a_x2") + gap, F.col("a_y2") + gap)
        near = join_meeting_boxes(one, two, keys, grown, box("b_"), salt_by=["a"]).where(F.col("b") < F.col("a"))
        lower = settle(near.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("to")))
        if lower.isEmpty():
            return current
        current = settle(
            current.join(_pointed(lower, keys), [*keys, "id"], "left").groupBy(*keys, F.coalesce("to", "id").alias("_to")).agg(*hull("")).withColumnRenamed("_to", "id"))


def _pointed(lower: DataFrame, keys: list[str]) -> DataFrame:
    """Pointers (``id`` to ``to``, always downwards) moved on to their ends, each round twice as far."""
    while True:
        ahead = lower.select(*keys, F.col("id").alias("to"), F.col("to").alias("_next"))
        moved = settle(lower.join(ahead, [*keys, "to"], "left"))
        if moved.where("_next is not null").isEmpty():
            return lower
        lower = moved.select(*keys, "id", F.coalesce("_next", "to").alias("to"))


_LEFT, _AGREED, _TAKEN = 0, 1, 2


def _agreement(boxes: Sequence[np.ndarray], sizes: np.ndarray, second: Sequence[np.ndarray], others: np.ndarray, share: float) -> np.ndarray:
    """What becomes of each box of many frames: left, agreeing with a second detector's, or taken in by the region."""
    x1, y1, x2, y2 = boxes
    frame, state = np.repeat(np.arange(len(sizes)), sizes), np.full(len(x1), _LEFT, np.int32)
    # Every box with every second box of its frame.
    pairs = others[frame]
    one = np.repeat(np.arange(len(x1)), pairs)
    two = np.arange(len(one)) - np.repeat(np.cumsum(pairs) - pairs, pairs) + np.repeat((np.cumsum(others) - others)[frame], pairs)
    s1, t1, s2, t2 = (side[two] for side in second)
    inside = lambda x, y, b: (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])
    middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    own, theirs = [side[one] for side in boxes], (s1, t1, s2, t2)
    agree = inside(*middle(theirs), own) | inside(*middle(own), theirs)
    state[one[agree]] = _AGREED
    region = [np.full(len(sizes), s) for s in (np.inf, np.inf, -np.inf, -np.inf)]

    def grow(at: np.ndarray, sides) -> None:
        for whole, side, pick in zip(region, sides, (np.minimum, np.minimum, np.maximum, np.maximum)):
            pick.at(whole, at, side)

    grow(frame[one[agree]], [side[agree] for side in own])
    grow(frame[one[agree]], [side[agree] for side in theirs])
    started = np.zeros(len(sizes), bool)
    started[frame[one[agree]]] = True
    rest = np.flatnonzero((state == _LEFT) & started[frame])
    while len(rest):
        (a1, b1, a2, b2), (r1, q1, r2, q2) = ([side[rest] for side in boxes], [side[frame[rest]] for side in region])
        width, height = np.minimum(a2, r2) - np.maximum(a1, r1), np.minimum(b2, q2) - np.maximum(b1, q1)
        size = (a2 - a1) * (b2 - b1)
        covered = (width > 0) & (height > 0) & (np.divide(width * height, size, out=np.zeros_like(size), where=size != 0) >= share)
        taken = rest[covered]
        if not len(taken):
            break
        state[taken] = _TAKEN
        grow(frame[taken], [side[taken] for side in boxes])
        rest = rest[~covered]
    return state


def agree_and_merge(
    candidates: DataFrame, second: DataFrame, keys: Sequence[str], item: str = "box_id", share: float = 0.30, rows: int | None = None,
) -> DataFrame:
    """Where one box of a second detector agrees with candidates (a centre lies in the other box),
    merge those, then take in further candidates that the merged region covers by ``share``.

    The region (with the second detector's box) decides what is taken in; only candidates shape
    the output box. Regions only grow, so taking in all that qualify per round is the same. Frames of up to
    ``rows`` boxes of either side are worked out in one pass; larger ones in rounds of joins.
    """
    keys, rows = list(keys), LIMITS.fold_rows if rows is None else rows
    boxes = settle(candidates.select(*keys, item, *_SIDES, "conf", "peak"))
    other = second.select(*keys, *_SIDES)
    hot = [found.select(*keys) for side in (boxes, other) if (found := hot_groups(side, keys, rows)) is not None]
    if not hot:
        return _agreed_frames(boxes, other, keys, item, share)
    marks = settle(hot[0].unionByName(hot[-1]).distinct())
    (small, large), (small_other, large_other) = split_hot(boxes, marks, keys), split_hot(other, marks, keys)
    return _agreed_frames(small, small_other, keys, item, share).unionByName(_agreed_rounds(settle(large), large_other, keys, item, share))


def _agreed_frames(boxes: DataFrame, second: DataFrame, keys: list[str], item: str, share: float) -> DataFrame:
    side = [F.col(s).cast("double").alias(s) for s in _SIDES]
    lists = boxes.groupBy(*keys).agg(F.collect_list(F.struct(F.col(item).alias("i"), *_SIDES, "conf", "peak")).alias("_g"))
    lists = lists.join(second.groupBy(*keys).agg(F.collect_list(F.struct(*side)).alias("_s")), keys, "left")

    @F.arrow_udf("array<int>")
    def state(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, s1: pa.Array, t1: pa.Array, s2: pa.Array, t2: pa.Array) -> pa.Array:
        sizes, others = (side.value_lengths().fill_null(0).to_numpy() for side in (x1, s1))
        found = _agreement([_flat(side) for side in (x1, y1, x2, y2)], sizes, [_flat(side) for side in (s1, t1, s2, t2)], others, share)
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), found)

    each = lists.withColumn("_state", state(*[F.col(f"{g}.{s}").cast("array<double>") for g in ("_g", "_s") for s in _SIDES]))
    each = each.select(*keys, F.posexplode(F.arrays_zip("_g", "_state")).alias("_n", "_e")).select(*keys, "_n", "_e._state", "_e._g.*")
    first = lambda c: F.when(F.col("_state") != _TAKEN, F.col(c))
    out = each.groupBy(*keys, F.when(F.col("_state") == _LEFT, F.col("_n")).alias("_own")).agg(
        F.min(first("i")).alias(item), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.max("conf").alias("conf"), F.max(first("peak")).alias("peak"))
    return out.select(*keys, item, *_SIDES, "conf", "peak", F.col("_own").isNull().alias("merged"))


def _agreed_rounds(boxes: DataFrame, second: DataFrame, keys: list[str], item: str, share: float) -> DataFrame:
    other = second.select(*keys, *[F.col(s).alias(f"s_{s}") for s in _SIDES])
    inside = lambda x, y, b: x.between(b.x1, b.x2) & y.between(b.y1, b.y2)
    own, theirs = box(), box("s_")
    agree = inside(*theirs.center, own) | inside(*own.center, theirs)
    agreed = settle(boxes.join(other, keys).where(agree).select(*keys, item, *_SIDES, "conf", "peak", *[f"s_{s}" for s in _SIDES]))
    hull = lambda p="": [
        F.min(f"{p}x1").alias(f"{p}x1"), F.min(f"{p}y1").alias(f"{p}y1"), F.max(f"{p}x2").alias(f"{p}x2"), F.max(f"{p}y2").alias(f"{p}y2"),
    ]
    merged = settle(
        agreed.groupBy(*keys).agg(F.min(item).alias(item), *hull(), F.max("conf").alias("conf"), F.max("peak").alias("peak"), *hull("s_"))
    )
    merged = settle(merged.withColumns({
        "s_x1": F.least("s_x1", "x1"), "s_y1": F.least("s_y1", "y1"), "s_x2": F.greatest("s_x2", "x2"), "s_y2": F.greatest("s_y2", "y2"),
    }))
    rest = settle(boxes.join(agreed.select(*keys, item), [*keys, item], "left_anti"))
    while True:
        area_of = merged.select(*keys, *[f"s_{s}" for s in _SIDES])
        width = F.least("x2", "s_x2") - F.greatest("x1", "s_x1")
        height = F.least("y2", "s_y2") - F.greatest("y1", "s_y1")
        covered = (width > 0) & (height > 0) & (width * height / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) >= share)
        taken = settle(rest.join(area_of, keys).where(covered).select(*keys, item, *_SIDES, "conf"))
        if taken.isEmpty():
            break
        added = taken.groupBy(*keys).agg(*[c.alias(f"t_{n}") for c, n in zip(
            (F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")), _SIDES)], F.max("conf").alias("t_conf"))
        grow = {}
        for low in ("x1", "y1"):
            grow[low], grow[f"s_{low}"] = F.least(low, f"t_{low}"), F.least(f"s_{low}", f"t_{low}")
        for high in ("x2", "y2"):
            grow[high], grow[f"s_{high}"] = F.greatest(high, f"t_{high}"), F.greatest(f"s_{high}", f"t_{high}")
        merged = settle(
            merged.join(added, keys, "left").withColumns({**grow, "conf": F.greatest("conf", "t_conf")})
            .drop(*[f"t_{s}" for s in _SIDES], "t_conf")
        )
        rest = settle(rest.join(taken.select(*keys, item), [*keys, item], "left_anti"))
    columns = [*keys, item, *_SIDES, "conf", "peak"]
    return merged.select(*columns, F.lit(True).alias("merged")).unionByName(rest.select(*columns, F.lit(False).alias("merged")))


def marked_patches(sims: DataFrame, keys: Sequence[str], sigma: float = 2.0) -> DataFrame:
    """Patches at or above mean + sigma standard deviations of their grid."""
    stats = sims.groupBy(*keys).agg(F.avg("sim").alias("sim_mean"), F.stddev_pop("sim").alias("sim_std"))
    return sims.join(stats, list(keys)).withColumn("marked", F.col("sim") >= F.col("sim_mean") + sigma * F.col("sim_std"))


def _labels(marked: np.ndarray) -> np.ndarray:
    """Number the 8-connected areas of a small grid, 0 for unmarked."""
    labels = np.where(marked, np.arange(1, marked.size + 1).reshape(marked.shape), 0)
    while True:
        padded = np.pad(labels, 1)
        near = [padded[1 + r : 1 + r + labels.shape[0], 1 + c : 1 + c + labels.shape[1]] for r in (-1, 0, 1) for c in (-1, 0, 1)]
        grown = np.where(marked, np.max(near, axis=0), 0)
        if (grown == labels).all():
            return labels
        labels = grown


def patch_regions(
    sims: DataFrame, keys: Sequence[str], grid_w: int, grid_h: int, frame_w: int, frame_h: int,
    sigma: float = 2.0, min_conf: float = MIN_CONFIDENCE, pad: int = PAD,
) -> DataFrame:
    """Boxes of connected areas of marked patches. A group is one picture's grid, at most
    ``grid_w * grid_h`` patches; mean and deviation are those of the patches present. Positions
    outside the grid have no place in it; of a repeated position the highest ``sim`` counts."""
    keys = list(keys)
    marked = marked_patches(_placed(sims, keys, ["sim"], grid_w * grid_h), keys, sigma).where("marked")
    found = _area_boxes(marked.withColumn("score", F.col("sim")), keys, grid_w, grid_h, frame_w, frame_h)
    kept = found.where((F.col("size") >= MIN_SHARE * frame_w * frame_h) & (F.col("size") <= MAX_SHARE * frame_w * frame_h))
    return _numbered(kept.where(F.col("peak") >= min_conf).withColumn("conf", F.col("peak")), keys, frame_w, frame_h, pad)


def ensemble_regions(
    sims: DataFrame, keys: Sequence[str], grid_w: int, grid_h: int, frame_w: int, frame_h: int,
    pad: int = ENSEMBLE_PAD,
) -> DataFrame:
    """The two-picture form: standardised sums of ``sim`` and ``sim_grad``, areas that reach near
    the peak, confidence as the area's energy. Scores are those of the patches present."""
    from pyspark.sql import Window

    keys = list(keys)
    grid = Window.partitionBy(*keys)
    unit = lambda c: (F.col(c) - F.avg(c).over(grid)) / (F.stddev_pop(c).over(grid) + 1e-6)
    scored = _placed(sims, keys, ["sim", "sim_grad"], grid_w * grid_h).withColumn("_sum", unit("sim") + unit("sim_grad"))
    scored = scored.withColumn("score", unit("_sum")).withColumn("_top", F.max("score").over(grid))
    grown = scored.where((F.col("_top") >= ENSEMBLE_PEAK) & (F.col("score") >= F.greatest(F.lit(1.2), F.col("_top") * 0.70)))
    found = _area_boxes(grown, keys, grid_w, grid_h, frame_w, frame_h)
    frame = frame_w * frame_h
    near_peak = F.col("peak") >= F.max("peak").over(grid) - 0.30
    kept = found.withColumn("_near", near_peak).where("_near").drop("_near")
    kept = kept.where((F.col("size") >= ENSEMBLE_MIN_SHARE * frame) & (F.col("size") <= ENSEMBLE_MAX_SHARE * frame))
    return _numbered(kept.withColumn("conf", F.col("energy")), keys, frame_w, frame_h, pad)


def strong_regions(kept: DataFrame, keys: Sequence[str], share: float = 0.50, k: int = 5) -> DataFrame:
    """Candidates with at least half the energy of the best one, at most five."""
    from pyspark.sql import Window

    best = kept.groupBy(*keys).agg(F.max("conf").alias("_best"))
    first = Window.partitionBy(*keys).orderBy(F.desc("conf"), F.asc("box_id"))
    good = kept.join(best, list(keys)).where(F.col("conf") >= F.col("_best") * share).drop("_best")
    return good.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")


def _placed(sims: DataFrame, keys: list[str], layers: list[str], cells: int) -> DataFrame:
    """One row per place of each grid."""
    best = F.max(F.struct(*[F.col(c).cast("double").alias(c) for c in layers])).alias("_v")
    return sims.where(F.col("patch").between(0, cells - 1)).groupBy(*keys, "patch").agg(best).select(*keys, "patch", "_v.*")


def _area_boxes(marked: DataFrame, keys: list[str], grid_w: int, grid_h: int, frame_w: int, frame_h: int) -> DataFrame:
    """Pixel box, ``size``, ``energy`` (sum of ``score``) and ``peak`` of each 8-connected area of marked
    patches. Only the numbering of areas needs a picture's marked patches together, at most the grid's places."""
    lists = marked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("patch", "score"))).alias("_g"))

    @F.pandas_udf("array<int>")
    def area(places: pd.Series) -> pd.Series:
        out = []
        for place in places:
            grid = np.zeros(grid_w * grid_h, bool)
            grid[np.asarray(place, dtype=int)] = True
            out.append(_labels(grid.reshape(grid_h, grid_w)).reshape(-1)[np.asarray(place, dtype=int)])
        return pd.Series(out)

    each = lists.withColumn("_a", area("_g.patch")).select(*keys, F.explode(F.arrays_zip("_g", "_a")).alias("_z"))
    row, column = F.floor(F.col("_z._g.patch") / grid_w), F.col("_z._g.patch") % grid_w
    areas = each.groupBy(*keys, F.col("_z._a").alias("_area")).agg(
        F.floor(F.min(column) * frame_w / grid_w).cast("double").alias("x1"), F.floor(F.min(row) * frame_h / grid_h).cast("double").alias("y1"),
        F.floor((F.max(column) + 1) * frame_w / grid_w).cast("double").alias("x2"), F.floor((F.max(row) + 1) * frame_h / grid_h).cast("double").alias("y2"),
        F.sum("_z._g.score").alias("energy"), F.max("_z._g.score").alias("peak"))
    return areas.withColumn("size", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))


def _numbered(found: DataFrame, keys: list[str], frame_w: int, frame_h: int, pad: int) -> DataFrame:
    """Areas wide and high enough, padded within the frame, numbered by falling confidence."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc("conf"), F.asc("_area"))
    wide = found.where(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= MIN_SIDE)
    return wide.select(
        *keys, (F.row_number().over(order) - 1).cast("long").alias("box_id"),
        F.greatest(F.lit(0.0), F.col("x1") - pad).alias("x1"), F.greatest(F.lit(0.0), F.col("y1") - pad).alias("y1"),
        F.least(F.lit(float(frame_w)), F.col("x2") + pad).alias("x2"), F.least(F.lit(float(frame_h)), F.col("y2") + pad).alias("y2"), "conf", "peak")
