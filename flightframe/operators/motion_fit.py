"""Planar camera motion from point tracks: shift and turn that most tracks agree on.

Hypotheses are drawn by hash, a fixed number per pair; each is fitted from three tracks, all
tracks of the pair vote by a combined count, and the winner is refitted on its voters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from flightframe.functions.digests import AT_ONCE, Digests
from flightframe.functions.numbers import count_if
from flightframe.plans.settle import settle
from flightframe.policies import LIMITS, CameraModel, MotionFitPolicy

#: Places of tracks within a pair that are kept beside 52 bits of a hash in one whole number.
_PLACES = 1 << 11
#: Hypotheses whose tracks a helper holds at once.
_HELD = 400_000
_POINT = ("x0", "y0", "x1", "y1")
_MODEL = ("tx", "ty", "yaw")


def usable_tracks(tracks: DataFrame, policy: MotionFitPolicy = MotionFitPolicy()) -> DataFrame:
    """Tracks found both ways, inside the picture, that return to where they started."""
    inside = F.lit(True)
    for p in ("0", "1", "b"):
        x, y = F.col(f"x{p}"), F.col(f"y{p}")
        inside = inside & ~F.isnan(x) & ~F.isnan(y) & (x >= 0) & (x < F.col("width")) & (y >= 0) & (y < F.col("height"))
    back = F.hypot(F.col("xb") - F.col("x0"), F.col("yb") - F.col("y0")) <= policy.fb_error_px
    return tracks.where(F.coalesce(F.col("ok") & inside & back, F.lit(False)))


def _terms(camera: CameraModel, at: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """What one track adds to the normal equations for displacement = -shift + turn * (v, -u)."""
    u, v = at("x0") - camera.cx, at("y0") - camera.cy
    dx, dy = at("x1") - at("x0"), at("y1") - at("y0")
    return {"n": F.lit(1.0), "u": u, "v": v, "dx": dx, "dy": dy, "r": u * u + v * v, "m": v * dx - u * dy}


def _sums(camera: CameraModel, weight: Column | None = None) -> list[Column]:
    """Grouped sums of the normal equations."""
    terms = _terms(camera)
    if weight is not None:
        terms = {name: F.when(weight, value) for name, value in terms.items()}
    return [F.coalesce(F.sum(value), F.lit(0.0)).alias(f"s_{name}") for name, value in terms.items()]


def _solution() -> dict[str, Column]:
    """Shift and turn that minimise the squared residuals, from the sums."""
    n, u, v, dx, dy, r, m = (F.col(f"s_{c}") for c in ("n", "u", "v", "dx", "dy", "r", "m"))
    n = F.when(n > 0, n)
    # -tx*n + yaw*v = dx ; -ty*n - yaw*u = dy ; eliminated into one equation for yaw.
    spread = r - (u * u + v * v) / n
    yaw = (m - (v * dx - u * dy) / n) / F.when(spread > 1e-9, spread)
    return {"yaw": yaw, "tx": (yaw * v - dx) / n, "ty": (-yaw * u - dy) / n}


def _errors(camera: CameraModel) -> tuple[Column, Column]:
    u, v = F.col("x0") - camera.cx, F.col("y0") - camera.cy
    ex = -F.col("tx") + F.col("yaw") * v - (F.col("x1") - F.col("x0"))
    ey = -F.col("ty") - F.col("yaw") * u - (F.col("y1") - F.col("y0"))
    return ex, ey


def _residual(camera: CameraModel) -> Column:
    return F.hypot(*_errors(camera))


def _agrees(camera: CameraModel, limit: float) -> Column:
    """The residual is within ``limit``; most that are not are told by one side, without a root."""
    ex, ey = _errors(camera)
    return (F.abs(ex) <= limit) & (F.abs(ey) <= limit) & (F.hypot(ex, ey) <= limit)


def refit(tracks: DataFrame, keys: Sequence[str], inlier: Column, camera: CameraModel = CameraModel()) -> DataFrame:
    """Least-squares motion per pair on the given inliers, one combined aggregate."""
    fitted = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("tracked"), *_sums(camera, inlier))
    return fitted.select(*keys, "tracked", *[c.alias(n) for n, c in _solution().items()])


def _digest(text: str, number: Column) -> Column:
    return F.md5(F.concat(F.col(text), number.cast("string")))


def _number(digest: Column, place: int) -> Column:
    """A number below 2^52 from 13 hexadecimal digits of an MD5, so draws are the same anywhere."""
    return F.conv(F.substring(digest, place, 13), 16, 10).cast("long")


def _entered(tracks: DataFrame, track: str, draws: Column) -> DataFrame:
    """``tracks`` (with the number ``tracked`` of their pair) in the hypotheses ``_h`` they enter, with a digest for each.

    A track enters as many hypotheses as give each about twelve to choose from; their number never
    depends on the tracks, so small pairs are tried as often as large ones."""
    share = F.greatest(F.lit(1), F.ceil(F.lit(12.0) * draws / F.col("tracked"))).cast("int")
    # What the digests have in common is written once per track.
    written = tracks.withColumns({"_e": F.concat(F.col(track).cast("string"), F.lit(":")), "_f": F.concat(F.col(track).cast("string"), F.lit("@"))})
    drawn = written.withColumn("_i", F.explode(F.sequence(F.lit(1), share))).withColumn("_h", _number(_digest("_e", F.col("_i")), 1) % draws.cast("long"))
    return drawn.withColumn("_d", _digest("_f", F.col("_h")))


def _triples(good: DataFrame, keys: list[str], track: str, policy: MotionFitPolicy, camera: CameraModel = CameraModel()) -> DataFrame:
    """The models ``_m`` by the three tracks of each hypothesis, of pairs with at most ``_PLACES`` tracks. A pair's tracks are
    numbered in a list, and a hash and a place make one number, so what a task keeps of a hypothesis are three numbers.
    Digests and fits go in numpy, many at once."""
    point = F.struct(F.col(track).alias("t"), *[F.col(c).cast("double").alias(c) for c in _POINT])
    # Dealt by pair, so that one shuffle is enough to tell rows that come twice, and to list the others.
    once = good.repartition(*keys).groupBy(*keys, point.alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    listed = once.groupBy(*keys).agg(F.sum("_n").alias("tracked"), F.sort_array(F.collect_list("_l")).alias("_l")).where(F.col("tracked") >= policy.min_features)
    named = listed.select(*keys, "tracked", F.transform("_l", lambda one: one["t"].cast("string")).alias("_s"), *[F.col(f"_l.{c}").alias(f"_{c}") for c in _POINT])
    draws = policy.hypotheses

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = max(1, _HELD // draws)
        for batch in batches:
            for low in range(0, batch.num_rows, pairs):
                part = batch.slice(low, pairs)
                places = _drawn(part.column("_s"), part.column("tracked").to_numpy(), draws)
                models = _solved(places, {c: part.column(f"_{c}") for c in _POINT}, draws, camera)
                kept = part.select(keys)
                yield pa.RecordBatch.from_arrays([*kept.columns, models], [*kept.schema.names, "_m"])

    model = StructType([StructField("_h", LongType()), *[StructField(n, DoubleType()) for n in _MODEL]])
    return named.mapInArrow(fitted, StructType([*[good.schema[k] for k in keys], StructField("_m", ArrayType(model))]))


def _drawn(texts: pa.ListArray, tracked: np.ndarray, draws: int) -> tuple[np.ndarray, ...]:
    """The hypotheses of three different tracks, numbered through all pairs, and their tracks as places in the pair's list
    ``texts``: what ``_entered`` gives, and of each hypothesis the least by one number of a digest, the least by another, and
    the largest by the first."""
    ends = texts.offsets.to_numpy()
    sizes, names = np.diff(ends), texts.values.slice(ends[0], ends[-1] - ends[0])
    pair = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(pair)) - np.repeat(ends[:-1] - ends[0], sizes)
    share = np.maximum(1, np.ceil(12.0 * draws / tracked)).astype(np.int64)[pair]
    # A track without a name has no digest.
    share[names.is_null().to_numpy(zero_copy_only=False)] = 0
    first, last = (np.full(len(sizes) * draws, v, np.int64) for v in (np.iinfo(np.int64).max, -1))
    other = first.copy()
    entries = Digests(names, b":", int(share.max(initial=0))), Digests(names, b"@", draws)
    upto = np.cumsum(share)
    low = 0
    while low < len(pair):
        # Tracks with about so many entries as fit a processor's own memory.
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - share[low] + AT_ONCE, "right")))
        row = np.repeat(np.arange(low, high), share[low:high])
        turn = np.arange(len(row)) - (upto - share)[row] + upto[low] - share[low] + 1
        h = entries[0].numbers(row, turn)[0] % draws
        at, (a, b) = pair[row] * draws + h, entries[1].numbers(row, h)
        np.minimum.at(first, at, a * _PLACES + place[row])
        np.maximum.at(last, at, a * _PLACES + place[row])
        np.minimum.at(other, at, b * _PLACES + place[row])
        low = high
    a, b, c = (v % _PLACES for v in (first, other, last))
    whole = np.flatnonzero((last >= 0) & (a != b) & (b != c) & (a != c))
    return whole, a[whole], b[whole], c[whole]


def _solved(places: tuple[np.ndarray, ...], lists: dict[str, pa.ListArray], draws: int, camera: CameraModel) -> pa.ListArray:
    """The models of drawn hypotheses by pair: ``_terms``, their sums and ``_solution``, in the same order of operations."""
    whole, *drawn = places
    starts = lists["x0"].offsets.to_numpy()
    points = {c: listed.values.to_numpy() for c, listed in lists.items()}
    s = {}
    for at in drawn:
        x0, y0, x1, y1 = (points[c][starts[whole // draws] + at] for c in _POINT)
        u, v, dx, dy = x0 - camera.cx, y0 - camera.cy, x1 - x0, y1 - y0
        for name, value in {"u": u, "v": v, "dx": dx, "dy": dy, "r": u * u + v * v, "m": v * dx - u * dy}.items():
            s[name] = s[name] + value if name in s else value
    spread = s["r"] - (s["u"] * s["u"] + s["v"] * s["v"]) / 3.0
    fit = spread > 1e-9
    whole, spread, s = whole[fit], spread[fit], {name: value[fit] for name, value in s.items()}
    yaw = (s["m"] - (s["v"] * s["dx"] - s["u"] * s["dy"]) / 3.0) / spread
    tx, ty = (yaw * s["v"] - s["dx"]) / 3.0, (-yaw * s["u"] - s["dy"]) / 3.0
    ends = np.searchsorted(whole, np.arange(len(starts)) * draws)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in (whole % draws, tx, ty, yaw)], ["_h", *_MODEL]))


def _triples_of_large(good: DataFrame, enough: DataFrame, keys: list[str], track: str, policy: MotionFitPolicy, camera: CameraModel = CameraModel()) -> DataFrame:
    """The same for pairs of any size: a combined top-3 whose entries hold the tracks."""
    entered = _entered(good.join(enough, keys), track, F.lit(policy.hypotheses))
    # Digits of one length sort as their numbers do.
    entered = entered.withColumn("_o", F.substring("_d", 1, 13)).withColumn("_p", F.substring("_d", 14, 13))
    point = F.struct("_o", F.col(track).alias("t"), *_POINT)
    third = entered.groupBy(*keys, "_h").agg(
        F.min(point).alias("a"), F.max(point).alias("c"), F.min_by(point, F.struct("_p", F.col(track))).alias("b"))
    third = third.where((F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))
    of = [_terms(camera, lambda c, n=n: F.col(f"{n}.{c}")) for n in "abc"]
    sums = third.select(*keys, "_h", *[(of[0][n] + of[1][n] + of[2][n]).alias(f"s_{n}") for n in of[0]])
    models = settle(sums.select(*keys, "_h", *[c.alias(n) for n, c in _solution().items()]).where(F.col("yaw").isNotNull()))
    return models.groupBy(*keys).agg(F.collect_list(F.struct("_h", *_MODEL)).alias("_m"))


def planar_motion_fit(
    tracks: DataFrame, keys: Sequence[str] = ("pair",), camera: CameraModel = CameraModel(),
    policy: MotionFitPolicy = MotionFitPolicy(), track: str = "track_id", rows: int | None = None,
) -> DataFrame:
    """Shift, turn, inlier share and residual per pair, or the reason why there is none. Hypotheses of pairs with up to
    ``rows`` tracks are drawn from lists."""
    keys, rows = list(keys), min(LIMITS.fold_rows if rows is None else rows, _PLACES)
    good = settle(usable_tracks(tracks, policy).select(*keys, track, *_POINT))
    every = tracks.select(*keys).distinct()
    sizes = settle(good.groupBy(*keys).agg(F.count(F.lit(1)).alias("tracked")))
    enough = sizes.where(F.col("tracked") >= policy.min_features)
    large = enough.where(F.col("tracked") > rows)
    # Votes: all models of a pair as one short array (at most ``hypotheses``) on each track.
    if large.isEmpty():
        listed = _triples(good, keys, track, policy, camera)
    else:
        listed = _triples(good.join(large, keys, "left_anti"), keys, track, policy, camera).unionByName(_triples_of_large(good, large, keys, track, policy, camera))
    voting = good.join(listed, keys).select(*keys, *_POINT, F.inline("_m"))
    votes = voting.where(_agrees(camera, policy.residual_threshold_px)).groupBy(*keys, "_h", "tx", "ty", "yaw").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*keys).agg(F.max_by(F.struct("tx", "ty", "yaw", "votes"), F.struct("votes", -F.col("_h"))).alias("_b")).select(*keys, "_b.*")
    supported = settle(good.join(best.where(F.col("votes") >= 3), keys).where(_residual(camera) <= policy.residual_threshold_px).select(*keys, *_POINT))
    refined = supported.groupBy(*keys).agg(*_sums(camera)).select(*keys, *[c.alias(n) for n, c in _solution().items()])
    error = F.col("_e")
    judged = good.join(refined, keys).withColumn("_e", _residual(camera)).groupBy(*keys, "tx", "ty", "yaw").agg(
        count_if(error <= policy.residual_threshold_px).alias("inliers"),
        F.sqrt(F.avg(F.when(error <= policy.residual_threshold_px, error * error))).alias("rms"),
    )
    out = every.join(sizes, keys, "left").join(judged, keys, "left").withColumn("tracked", F.coalesce("tracked", F.lit(0)))
    ratio = F.coalesce(F.col("inliers") / F.col("tracked"), F.lit(0.0))
    solid = (
        (F.col("inliers") >= policy.min_inliers) & (F.col("inlier_ratio") >= policy.min_inlier_ratio)
        & (F.col("rms") <= policy.residual_threshold_px)
    )
    reason = (
        F.when(F.col("tracked") < policy.min_features, "insufficient_features")
        .when(F.col("yaw").isNull(), "ransac_failed").when(~F.coalesce(solid, F.lit(False)), "low_quality")
    )
    kept = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    return (
        out.withColumn("inlier_ratio", ratio).withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
        .select(*keys, "tracked", F.coalesce("inliers", F.lit(0)).alias("inliers"), "inlier_ratio", "rms", "valid", "reason",
                kept("tx").alias("dx"), kept("ty").alias("dy"), kept("yaw").alias("yaw"))
    )
