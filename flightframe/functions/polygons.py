"""Planar projection of boxes and checks of the projected quadrilaterals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.boxes import Box, area, clip
from flightframe.functions.steps import Step, let, with_steps, worked_out
from flightframe.policies import BoxMotionPolicy, MatchingPolicy

Point = tuple[Column, Column]


def _coordinates(points: Sequence[Point]) -> dict[str, Column]:
    return {f"p{a}{i}": c for i, point in enumerate(points) for a, c in zip("xy", point)}


def _points(value: Callable[[str], Column], count: int = 4) -> list[Point]:
    return [(value(f"px{i}"), value(f"py{i}")) for i in range(count)]


MATRIX = tuple(f"h{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3))


def matrix(prefix: str = "") -> list[Column]:
    return [F.col(prefix + name) for name in MATRIX]


def project(h: Sequence[Column], x: Column, y: Column) -> Point:
    """Perspective image of a point; null where the denominator is zero."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(w != 0, w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def corners(b: Box) -> list[Point]:
    return [(b.x1, b.y1), (b.x2, b.y1), (b.x2, b.y2), (b.x1, b.y2)]


def _turns(points: Sequence[Point]) -> list[Column]:
    out = []
    for i in range(len(points)):
        (ax, ay), (bx, by), (cx, cy) = (points[(i + k) % len(points)] for k in range(3))
        out.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    return out


def is_convex(points: Sequence[Point]) -> Column:
    """All turns strictly to the same side."""
    turns = _turns(points)
    return F.coalesce((F.least(*turns) > 0) | (F.greatest(*turns) < 0), F.lit(False))


def shoelace(points: Sequence[Point]) -> Column:
    total = F.lit(0.0)
    for i, (ax, ay) in enumerate(points):
        bx, by = points[(i + 1) % len(points)]
        total = total + (ax * by - bx * ay)
    return F.abs(total) / 2


def all_finite(points: Sequence[Sequence[Column]]) -> Column:
    good = F.lit(True)
    for point in points:
        for value in point:
            good = good & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.coalesce(good, F.lit(False))


def bounds(points: Sequence[Point]) -> Box:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def clipped_area(points: Sequence[Point], width: Column, height: Column) -> Column:
    """Area of a convex polygon inside the frame rectangle, by four half-plane cuts."""
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])
    sides = [
        (lambda p: p["x"]),
        (lambda p: width - p["x"]),
        (lambda p: p["y"]),
        (lambda p: height - p["y"]),
    ]
    for depth in sides:
        ring = let(ring, _cutter(depth))
    return let(ring, _ring_area)


def _cutter(depth: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda ring: _cut(ring, depth)


def _ring_area(ring: Column) -> Column:
    size = F.size(ring)
    after = lambda i: F.get(ring, (i + 1) % size)
    crossed = F.transform(ring, lambda p, i: p["x"] * after(i)["y"] - after(i)["x"] * p["y"])
    total = F.aggregate(crossed, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(size < 3, F.lit(0.0)).otherwise(F.abs(total) / 2)


def _cut(ring: Column, depth) -> Column:
    """Keep the part where ``depth`` (signed distance inside) is not negative."""
    empty = F.slice(ring, 1, 0)

    def step(p: Column, i: Column) -> Column:
        return let(F.get(ring, (i + 1) % F.size(ring)), lambda q: joined(p, q))

    def joined(p: Column, q: Column) -> Column:
        here, there = depth(p), depth(q)
        share = F.try_divide(here, here - there)
        meeting = F.struct(
            (p["x"] + (q["x"] - p["x"]) * share).alias("x"), (p["y"] + (q["y"] - p["y"]) * share).alias("y")
        )
        kept = F.when(here >= 0, F.array(p)).otherwise(empty)
        crossing = F.when((here >= 0) != (there >= 0), F.array(meeting)).otherwise(empty)
        return F.concat(kept, crossing)

    return F.flatten(F.transform(ring, step))


def _clipped(x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """``clipped_area`` of many quadrilaterals, by the same operations in the same order: a row of corners each."""
    size, wide, high = np.full(len(x), x.shape[1]), width[:, None], height[:, None]
    for depth in (lambda: x, lambda: wide - x, lambda: y, lambda: high - y):
        place = np.arange(x.shape[1])[None, :]
        after, there_is = (place + 1) % np.maximum(size, 1)[:, None], place < size[:, None]
        here, (next_x, next_y) = depth(), (np.take_along_axis(c, after, 1) for c in (x, y))
        there = np.take_along_axis(here, after, 1)
        kept, crossed = there_is & (here >= 0), there_is & ((here >= 0) != (there >= 0))
        share = np.divide(here, here - there, out=np.zeros_like(here), where=crossed)
        # Each corner gives itself and the crossing after it, if any, and these move up to the front.
        given = np.stack([kept, crossed], 2).reshape(len(x), -1)
        to, size = np.cumsum(given, 1) - 1, given.sum(1)
        row, column = np.nonzero(given)
        ring = np.zeros((2, len(x), max(1, size.max(initial=0))))
        for out, own, then in ((ring[0], x, next_x), (ring[1], y, next_y)):
            out[row, to[row, column]] = np.stack([own, own + (then - own) * share], 2).reshape(len(x), -1)[row, column]
        x, y = ring
    place = np.arange(x.shape[1])[None, :]
    after = (place + 1) % np.maximum(size, 1)[:, None]
    turned = np.where(place < size[:, None], x * np.take_along_axis(y, after, 1) - np.take_along_axis(x, after, 1) * y, 0.0)
    total = np.zeros(len(x))
    for part in turned.T:
        total = total + part
    return np.where(size < 3, 0.0, np.abs(total) / 2)


def _visible_area(points: Sequence[Point], width: Column, height: Column) -> Column:
    """``clipped_area`` in batches; corners that are no numbers are left to the expression."""

    @F.pandas_udf("double")
    def clipped(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series,
                x3: pd.Series, y3: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            column = lambda *parts: np.stack([p.to_numpy(float) for p in parts], 1)
            return pd.Series(_clipped(column(x0, x1, x2, x3), column(y0, y1, y2, y3), width.to_numpy(float), height.to_numpy(float)))

    return F.when(all_finite(points), clipped(*[c for p in points for c in p], width, height)).otherwise(clipped_area(points, width, height))


def project_box(
    h: Sequence[Column], b: Box, width: Column, height: Column, policy: BoxMotionPolicy = BoxMotionPolicy()
) -> Column:
    """Projected box as a struct: ``valid``, the clipped box ``x1..y2``, the projected centre
    ``cx, cy``, ``visible_ratio`` and ``edge_reliable``."""
    return worked_out(_box_steps(h, b, width, height, policy))


def with_projected_box(
    df: DataFrame, h: Sequence[Column], b: Box, width: Column, height: Column, policy: BoxMotionPolicy = BoxMotionPolicy(), prefix: str = "image_"
) -> DataFrame:
    """``df`` with the values of ``project_box`` as columns."""
    return with_steps(df, _box_steps(h, b, width, height, policy), prefix)


def _box_steps(h: Sequence[Column], b: Box, width: Column, height: Column, policy: BoxMotionPolicy) -> list[Step]:
    sides = lambda v, mark: Box(*[v(f"{mark}{n}") for n in ("x1", "y1", "x2", "y2")])
    named = lambda box_, mark: {f"{mark}{n}": c for n, c in zip(("x1", "y1", "x2", "y2"), box_)}

    def finished(v) -> dict[str, Column]:
        *points, middle = _points(v, 5)
        raw, inside = sides(v, "raw_"), sides(v, "clipped_")
        valid = (
            all_finite([*points, middle]) & is_convex(points) & (shoelace(points) > 1e-6) & (area(inside) > 0)
        )
        ratio = area(inside) / F.greatest(area(raw), F.lit(1e-12))
        return {
            "valid": F.coalesce(valid, F.lit(False)), **named(inside, ""), "cx": middle[0], "cy": middle[1],
            "visible_ratio": ratio, "edge_reliable": ratio >= policy.min_visible_ratio,
        }

    return [
        lambda v: _coordinates([*[project(h, x, y) for x, y in corners(b)], project(h, *b.center)]),
        lambda v: named(bounds(_points(v)), "raw_"), lambda v: named(clip(sides(v, "raw_"), width, height), "clipped_"), finished,
    ]


def check_polygon(
    points: Sequence[Point], width: Column, height: Column, policy: MatchingPolicy = MatchingPolicy()
) -> Column:
    """Struct of the first failed gate of a quadrilateral (``reason``, null if none) and its
    ``raw_area``, ``visible_area`` and ``visible_ratio``."""

    return worked_out(_polygon_steps(points, width, height, policy, lambda ring: clipped_area(ring, width.cast("double"), height.cast("double"))))


def with_polygon_check(
    df: DataFrame, points: Sequence[Point], width: Column, height: Column, policy: MatchingPolicy = MatchingPolicy(), prefix: str = "check_"
) -> DataFrame:
    """``df`` with the values of ``check_polygon`` as columns."""
    visible = F.col("_visible")
    placed, *rest = _polygon_steps(points, width, height, policy, lambda ring: visible)
    columns, corner = df.columns, lambda n: F.col(f"{prefix}{n}")
    df = with_steps(df, [placed], prefix).withColumn("_visible", _visible_area(_points(corner), width.cast("double"), height.cast("double")))
    return with_steps(df, rest, prefix).select(*columns, *[f"{prefix}{n}" for n in ("reason", "raw_area", "visible_area", "visible_ratio")])


def _polygon_steps(points: Sequence[Point], width: Column, height: Column, policy: MatchingPolicy, visible: Callable[[list[Point]], Column]) -> list[Step]:
    def measured(v) -> dict[str, Column]:
        ring = _points(v)
        extent = bounds(ring)
        return {
            "finite": all_finite(ring), "convex": is_convex(ring), "raw": shoelace(ring), "visible": visible(ring),
            **{f"e{i}": F.hypot(ring[(i + 1) % 4][0] - ring[i][0], ring[(i + 1) % 4][1] - ring[i][1]) for i in range(4)},
            "w": extent.width, "h": extent.height,
        }

    def judged(m) -> dict[str, Column]:
        spread = lambda a, b: F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1e-9))
        distortion = F.greatest(spread(m("e0"), m("e2")), spread(m("e1"), m("e3")))
        ratio = F.try_divide(m("visible"), m("raw"))
        reason = (
            F.when(~m("finite"), "polygon_points_invalid")
            .when((width <= 0) | (height <= 0), "frame_size_invalid")
            .when(~m("convex"), "polygon_not_convex")
            .when(m("raw") < policy.min_polygon_area, "polygon_area_too_small")
            .when(m("raw") > width * height * policy.max_frame_ratio, "polygon_area_too_large")
            .when(F.least(m("e0"), m("e1"), m("e2"), m("e3")) < policy.min_edge_px, "polygon_edge_too_short")
            .when(
                (F.least(m("w"), m("h")) <= 0) | (F.greatest(F.try_divide(m("w"), m("h")), F.try_divide(m("h"), m("w"))) > policy.max_aspect),
                "polygon_aspect_ratio",
            )
            .when(distortion > policy.max_distortion, "polygon_perspective_distortion")
            .when((m("visible") <= 0) | (ratio < policy.min_visible_ratio), "polygon_visibility")
        )
        return {"reason": reason, "raw_area": m("raw"), "visible_area": m("visible"), "visible_ratio": ratio}

    return [lambda v: _coordinates(points), measured, judged]


def determinant(h: Sequence[Column]) -> Column:
    return (
        h[0] * (h[4] * h[8] - h[5] * h[7])
        - h[1] * (h[3] * h[8] - h[5] * h[6])
        + h[2] * (h[3] * h[7] - h[4] * h[6])
    )


def condition_number(h: Sequence[Column]) -> Column:
    """Ratio of the largest to the smallest singular value: eigenvalues of the symmetric HᵀH
    in trigonometric form, the smallest one from the determinant to keep its digits."""
    return worked_out(_condition_steps(lambda v: h))["condition_number"]


def with_condition_number(df: DataFrame, h: Sequence[Column], prefix: str = "") -> DataFrame:
    """``df`` with the ``condition_number`` of ``h`` as a column."""
    return with_steps(df, _condition_steps(lambda v: h), prefix)


def _condition_steps(matrix_of: Callable[[Callable[[str], Column]], Sequence[Column]]) -> list[Step]:
    def products(v) -> dict[str, Column]:
        h = matrix_of(v)
        dot = lambda i, j: h[i] * h[j] + h[i + 3] * h[j + 3] + h[i + 6] * h[j + 6]
        values = (dot(0, 0), dot(1, 1), dot(2, 2), dot(0, 1), dot(0, 2), dot(1, 2))
        return {**{f"s_{n}": c for n, c in zip("abcdef", values)}, "det": determinant(h)}

    def centred(v) -> dict[str, Column]:
        a, b, c, d, e, f = (v(f"s_{n}") for n in "abcdef")
        m = (a + b + c) / 3
        off = d * d + e * e + f * f
        spread = F.sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m) + 2 * off) / 6)
        return {"m": m, "k": spread, "t_a": a - m, "t_b": b - m, "t_c": c - m}

    def rooted(v) -> dict[str, Column]:
        (a, b, c), (d, e, f) = (v(f"t_{n}") for n in "abc"), (v(f"s_{n}") for n in "def")
        cubic = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
        half = F.try_divide(cubic, 2 * v("k") * v("k") * v("k"))
        return {"angle": F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3}

    def spread_out(v) -> dict[str, Column]:
        third = 2.0943951023931953
        return {
            "large": v("m") + 2 * v("k") * F.cos(v("angle")), "small": v("m") + 2 * v("k") * F.cos(v("angle") + third), "trace": 3 * v("m"),
        }

    def ratio(v) -> dict[str, Column]:
        middle = v("trace") - v("large") - v("small")
        return {"condition_number": F.when(v("k") == 0, F.lit(1.0)).otherwise(F.try_divide(v("large") * F.sqrt(middle), F.abs(v("det"))))}

    return [products, centred, rooted, spread_out, ratio]


def matrix_fault(
    h: Sequence[Column], width: Column, height: Column, max_condition_number: float = 1e5
) -> Column:
    """Why a homography is implausible, or null. Rules are tried in order."""
    return worked_out(_fault_steps(h, width, height, max_condition_number))["fault"]


def with_matrix_fault(df: DataFrame, h: Sequence[Column], width: Column, height: Column, max_condition_number: float = 1e5, prefix: str = "") -> DataFrame:
    """``df`` with the ``fault`` of ``h`` as a column."""
    return with_steps(df, _fault_steps(h, width, height, max_condition_number), prefix)


def _fault_steps(h: Sequence[Column], width: Column, height: Column, max_condition_number: float) -> list[Step]:
    source = corners(Box(F.lit(0.0), F.lit(0.0), width - F.lit(1.0), height - F.lit(1.0)))
    unit = lambda v: [v(f"unit_{name}") for name in MATRIX]

    def divided(v) -> dict[str, Column]:
        safe = F.when(F.abs(h[8]) >= 1e-12, h[8])
        return {f"unit_{name}": value / safe for value, name in zip(h, MATRIX)}

    def seen(v) -> dict[str, Column]:
        image = _points(v)
        return {"finite": all_finite([tuple(h[:2]), tuple(h[2:4]), tuple(h[4:6]), tuple(h[6:8]), (h[8],)]), "image_finite": all_finite(image), "convex": is_convex(image), "area": shoelace(image)}

    def moved(v) -> dict[str, Column]:
        return {f"moved_{i}": F.hypot(px - x, py - y) for i, ((px, py), (x, y)) in enumerate(zip(_points(v), source))}

    def ruled(v) -> dict[str, Column]:
        cond, shift = v("condition_number"), F.greatest(*[v(f"moved_{i}") for i in range(4)])
        ratio = v("area") / F.greatest(F.lit(1.0), (width - 1) * (height - 1))
        return {"fault": (
            F.when(~v("finite"), "invalid_matrix")
            .when(F.abs(h[8]) < 1e-12, "singular_normalization")
            .when((F.abs(v("det")) < 1e-8) | (F.abs(v("det")) > 1e8), "implausible_determinant")
            .when(cond.isNull() | F.isnan(cond) | (cond > max_condition_number), "excessive_condition_number")
            .when(~(v("image_finite") & v("convex")), "invalid_corner_projection")
            .when(~ratio.between(0.1, 10.0), "implausible_projected_area")
            .when(shift > 2.0 * F.hypot(width, height), "excessive_corner_displacement")
        )}

    return [divided, *_condition_steps(unit), lambda v: _coordinates([project(unit(v), x, y) for x, y in source]), seen, moved, ruled]
