"""Motion from sampled flow vectors: camera motion, vehicle motion, scene quality.

A sample is one pixel ``(px, py)`` of the flow grid with its vector ``(dx, dy)`` in grid pixels.
Boxes are in frame pixels and reach the grid by ``scale``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.boxes import Box, box, inner_crop
from flightframe.functions.labels import MOVING, STATIONARY, UNKNOWN, VEHICLE
from flightframe.operators.overlap import join_meeting_boxes
from flightframe.plans.percentiles import grouped_percentiles
from flightframe.plans.settle import settle
from flightframe.policies import FlowPolicy, HomographyGate, HybridPolicy, ScenePolicy


def _pixel() -> Box:
    return Box(*[F.col(c).cast("double") for c in ("px", "py", "px", "py")])



@dataclass(frozen=True)
class FlowGrid:
    width: int
    height: int
    scale_x: float
    scale_y: float


def region(b: Box, grid: FlowGrid) -> Box:
    """First and last grid pixel of a frame box on each axis (empty boxes end before they start)."""
    low = lambda v, scale, size: F.greatest(F.lit(0), F.least(F.lit(size), F.floor(v * scale)))
    high = lambda v, scale, size: F.greatest(F.lit(0), F.least(F.lit(size), F.ceil(v * scale))) - 1
    pixels = (
        low(b.x1, grid.scale_x, grid.width), low(b.y1, grid.scale_y, grid.height),
        high(b.x2, grid.scale_x, grid.width), high(b.y2, grid.scale_y, grid.height),
    )
    return Box(*[p.cast("double") for p in pixels])


def regions(boxes: DataFrame, keys: Sequence[str], b: Box, grid: FlowGrid, keep: Sequence[str] = ()) -> DataFrame:
    r = region(b, grid)
    return boxes.select(*keys, *keep, *r.named("r_")).where((F.col("r_x2") >= F.col("r_x1")) & (F.col("r_y2") >= F.col("r_y1")))


def inside_regions(samples: DataFrame, areas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples paired with every region they lie in."""
    return join_meeting_boxes(samples, areas, keys, _pixel(), box("r_"), salt_by=["px", "py"])


def outside_regions(samples: DataFrame, areas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples that lie in no region."""
    return join_meeting_boxes(
        samples, areas, keys, _pixel(), box("r_"), how="left_anti", salt_by=["px", "py", "sample_id"]
    )


def _finite_samples(samples: DataFrame) -> DataFrame:
    ok = F.col("valid") & F.col("dx").isNotNull() & F.col("dy").isNotNull()
    for name in ("dx", "dy"):
        ok = ok & ~F.isnan(name) & (F.abs(name) != F.lit(float("inf")))
    return samples.where(ok)


def global_motion(
    samples: DataFrame, boxes: DataFrame, grid: FlowGrid, keys: Sequence[str] = ("pair",), policy: FlowPolicy = FlowPolicy(),
    rows: int | None = None,
) -> DataFrame:
    """Median vector per pair of the samples outside all boxes, if there are enough."""
    keys = list(keys)
    free = settle(
        outside_regions(_finite_samples(samples), regions(boxes, keys, box(), grid), keys).select(*keys, "dx", "dy")
    )
    counts = free.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels")).where(F.col("pixels") >= policy.min_valid_pixels)
    medians = grouped_percentiles(free, keys, {"_x": F.col("dx"), "_y": F.col("dy")}, [0.5], rows)
    return counts.join(medians, keys).select(
        *keys, "pixels", F.get("_x", F.lit(0)).alias("global_x"), F.get("_y", F.lit(0)).alias("global_y")
    )


def _vehicle_medians(
    samples: DataFrame, boxes: DataFrame, grid: FlowGrid, keys: list[str], crop: float, rows: int | None
) -> DataFrame:
    vehicles = boxes.where(F.col("cls") == VEHICLE)
    cropped = regions(vehicles, keys, inner_crop(box(), crop), grid, ["box_index"])
    inside = settle(inside_regions(_finite_samples(samples), cropped, keys).select(*keys, "box_index", "dx", "dy"))
    key = [*keys, "box_index"]
    counts = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("pixels"))
    medians = grouped_percentiles(inside, key, {"_x": F.col("dx"), "_y": F.col("dy")}, [0.5], rows)
    found = counts.join(medians, key).select(
        *key, "pixels", F.get("_x", F.lit(0)).alias("median_x"), F.get("_y", F.lit(0)).alias("median_y")
    )
    return vehicles.join(found, key, "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))


def vehicle_motion_global(
    samples: DataFrame, boxes: DataFrame, grid: FlowGrid, keys: Sequence[str] = ("pair",), policy: FlowPolicy = FlowPolicy(),
    rows: int | None = None,
) -> DataFrame:
    """Vehicle motion against the camera's: too few pixels or no camera motion is unknown."""
    keys = list(keys)
    camera = global_motion(samples, boxes, grid, keys, policy, rows).select(*keys, "global_x", "global_y")
    found = _vehicle_medians(samples, boxes, grid, keys, policy.inner_crop_ratio, rows).join(camera, keys, "left")
    magnitude = F.hypot(
        (F.col("median_x") - F.col("global_x")) / grid.scale_x, (F.col("median_y") - F.col("global_y")) / grid.scale_y
    )
    known = (F.col("pixels") >= policy.min_valid_pixels) & F.col("global_x").isNotNull()
    motion = F.when(~known, UNKNOWN).when(F.col("residual") > policy.threshold_px, MOVING).otherwise(STATIONARY)
    return found.withColumn("residual", F.when(known, magnitude)).withColumn("motion", motion)


def vehicle_motion_residual(
    samples: DataFrame, boxes: DataFrame, grid: FlowGrid, keys: Sequence[str] = ("pair",), policy: FlowPolicy = FlowPolicy(),
    rows: int | None = None,
) -> DataFrame:
    """Vehicle motion in compensated flow: too few pixels is stationary, and boxes longer than
    10 px get a threshold that grows with the root of their length."""
    found = _vehicle_medians(samples, boxes, grid, list(keys), policy.inner_crop_ratio, rows)
    b = box()
    cropped_w, cropped_h = b.width, b.height
    longest = F.greatest(cropped_w, cropped_h)
    limit = policy.residual_threshold_px + F.when(longest > 10.0, F.sqrt(longest) * 0.25).otherwise(0.0)
    enough = F.col("pixels") >= policy.min_valid_pixels
    magnitude = F.hypot(F.col("median_x") / grid.scale_x, F.col("median_y") / grid.scale_y)
    return (
        found.withColumn("residual", F.when(enough, magnitude))
        .withColumn("threshold", limit)
        .withColumn("motion", F.when(F.coalesce(F.col("residual") > limit, F.lit(False)), MOVING).otherwise(STATIONARY))
    )


def vehicle_motion_local(
    samples: DataFrame, boxes: DataFrame, grid: FlowGrid, keys: Sequence[str] = ("pair",), policy: FlowPolicy = FlowPolicy(),
    rows: int | None = None,
) -> DataFrame:
    """Vehicle median minus the median of the ring of background around it."""
    keys = list(keys)
    key = [*keys, "box_index"]
    good = _finite_samples(samples)
    b = box()
    vehicles = boxes.where(F.col("cls") == VEHICLE)
    grow_x, grow_y = b.width * policy.ring_expansion_ratio, b.height * policy.ring_expansion_ratio
    outer = Box(b.x1 - grow_x, b.y1 - grow_y, b.x2 + grow_x, b.y2 + grow_y)
    # The ring leaves out every box of the pair, so its own box too.
    free = outside_regions(good, regions(boxes, keys, b, grid), keys)
    ring = inside_regions(free, regions(vehicles, keys, outer, grid, ["box_index"]), keys)
    core = inside_regions(good, regions(vehicles, keys, inner_crop(b, policy.inner_crop_ratio), grid, ["box_index"]), keys)
    x, y = F.col("dx") / grid.scale_x, F.col("dy") / grid.scale_y
    both = settle(
        core.select(*key, F.lit("vehicle").alias("part"), x.alias("x"), y.alias("y")).unionByName(
            ring.select(*key, F.lit("background").alias("part"), x.alias("x"), y.alias("y"))
        )
    )
    tails = grouped_percentiles(
        both, [*key, "part"], {"_x": F.col("x"), "_y": F.col("y"), "_m": F.hypot("x", "y")}, [0.5, 0.75, 0.90], rows
    )
    counts = both.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("pixels"))
    stats = counts.join(tails, [*key, "part"])
    at = lambda part, c: F.max(F.when(F.col("part") == part, c))
    columns = []
    for part in ("vehicle", "background"):
        columns += [
            at(part, F.col("pixels")).alias(f"{part}_pixels"),
            at(part, F.get("_x", F.lit(0))).alias(f"{part}_x"), at(part, F.get("_y", F.lit(0))).alias(f"{part}_y"),
            *[at(part, F.get("_m", F.lit(i))).alias(f"{part}_{p}") for i, p in enumerate(("p50", "p75", "p90"))],
        ]
    wide = vehicles.join(stats.groupBy(*key).agg(*columns), key, "left")
    span = lambda size, scale: F.greatest(F.lit(0), F.ceil(size * scale))
    intended = F.greatest(
        F.lit(0),
        span(outer.width, grid.scale_x) * span(outer.height, grid.scale_y) - span(b.width, grid.scale_x) * span(b.height, grid.scale_y),
    )
    ratio = F.least(F.lit(1.0), F.coalesce("background_pixels", F.lit(0)) / F.greatest(intended, F.lit(1)))
    corrected = F.hypot(F.col("vehicle_x") - F.col("background_x"), F.col("vehicle_y") - F.col("background_y"))
    reason = (
        F.when(F.coalesce("vehicle_pixels", F.lit(0)) < policy.min_valid_pixels, "insufficient_vehicle_pixels")
        .when(F.coalesce("background_pixels", F.lit(0)) < policy.min_background_pixels, "insufficient_background_pixels")
        .when(F.col("valid_ratio") < policy.min_valid_ratio, "insufficient_background_ratio")
        .when(corrected <= policy.local_stationary_px, "corrected_stationary")
        .when(corrected >= policy.local_moving_px, "corrected_moving")
        .otherwise("corrected_hysteresis")
    )
    named = F.col("reason").startswith("corrected")
    motion = F.when(F.col("reason") == "corrected_stationary", STATIONARY).when(
        F.col("reason") == "corrected_moving", MOVING
    ).otherwise(UNKNOWN)
    return (
        wide.withColumn("valid_ratio", F.coalesce(ratio, F.lit(0.0))).withColumn("reason", reason)
        .withColumn("corrected", F.when(named, corrected)).withColumn("motion", motion)
    )


def _split_starts(size: int, parts: int) -> list[int]:
    """First index of each part when a range is split as evenly as possible, longer parts first."""
    base, extra = divmod(size, parts)
    return [i * base + min(i, extra) for i in range(parts)]


def scene_quality(
    samples: DataFrame, boxes: DataFrame, gates: DataFrame, grid: FlowGrid, keys: Sequence[str] = ("pair",),
    policy: ScenePolicy = ScenePolicy(), rows: int | None = None,
) -> DataFrame:
    """Background residual statistics per pair and the method they call for. ``gates`` has the
    keys, ``gate_valid``, ``accepted``, ``level``, and in ``cause`` why there is no matrix."""
    keys = list(keys)
    vehicles = boxes.where(F.col("cls") == VEHICLE)
    outside = outside_regions(samples, regions(vehicles, keys, box(), grid), keys)
    placed = lambda c, size, parts: F.size(
        F.filter(F.array(*[F.lit(s) for s in _split_starts(size, parts)]), lambda s: s <= F.col(c))
    ) - 1
    background = settle(
        outside.select(
            *keys, "valid", "dx", "dy", F.hypot(F.col("dx") / grid.scale_x, F.col("dy") / grid.scale_y).alias("m"),
            placed("py", grid.height, policy.grid_rows).alias("gr"), placed("px", grid.width, policy.grid_columns).alias("gc"),
        )
    )
    good = settle(_finite_samples(background))
    domain = background.groupBy(*keys).agg(F.count(F.lit(1)).alias("domain"))
    counts = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("background_pixels"), F.var_pop("m").alias("background_variance"))
    tails = grouped_percentiles(good, keys, {"_p": F.col("m")}, [0.5, 0.75, 0.90, 0.95], rows)
    cells = grouped_percentiles(good, [*keys, "gr", "gc"], {"_c": F.col("m")}, [0.5], rows).withColumn("cell", F.get("_c", F.lit(0)))
    cells = settle(cells.drop("_c"))
    spread = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("grid_cells"), (F.max("cell") - F.min("cell")).alias("grid_spread")
    )
    def gradient(name: str, step: dict[str, int]) -> DataFrame:
        there = cells.select(*keys, *[(F.col(c) - step.get(c, 0)).alias(c) for c in ("gr", "gc")], F.col("cell").alias("next"))
        pairs = cells.join(there, [*keys, "gr", "gc"])
        folded = grouped_percentiles(pairs, keys, {"_g": F.abs(F.col("next") - F.col("cell"))}, [0.5], rows)
        return folded.select(*keys, F.get("_g", F.lit(0)).alias(name))

    joined = gates
    for part in (domain, counts, tails, spread, gradient("gradient_x", {"gc": 1}), gradient("gradient_y", {"gr": 1})):
        joined = joined.join(part, keys, "left")
    names = ("background_median", "background_p75", "background_p90", "background_p95")
    joined = joined.withColumns({n: F.get("_p", F.lit(i)) for i, n in enumerate(names)}).drop("_p")
    pixels = F.coalesce("background_pixels", F.lit(0))
    share = F.when(F.coalesce("domain", F.lit(0)) > 0, pixels / F.col("domain")).otherwise(0.0)
    joined = joined.withColumn("background_pixels", pixels).withColumn("valid_background_ratio", share)
    needed = max(4, policy.grid_rows)
    fault = (
        F.when(~F.col("gate_valid"), F.concat(F.lit("homography_"), F.coalesce("cause", F.lit("invalid"))))
        .when(~F.col("accepted") | (F.col("level") == "low"), "homography_quality_low")
        .when(
            (F.col("valid_background_ratio") < policy.min_valid_background_ratio) | (F.col("background_pixels") < 4),
            "insufficient_background",
        )
        .when(F.coalesce("grid_cells", F.lit(0)) < needed, "insufficient_background_grid")
    )
    calm = (
        (F.col("background_median") <= policy.background_median_max)
        & (F.col("background_p90") <= policy.background_p90_max) & (F.col("grid_spread") <= policy.grid_spread_max)
    )
    method = F.when(fault.isNotNull(), "unknown").when(calm, "homography").otherwise("homography_bbox")
    reason = F.coalesce(
        fault, F.when(calm, "background_residual_low_and_homogeneous").otherwise("background_residual_high_or_spatially_nonuniform")
    )
    steady = lambda name: F.when(fault.isNull(), F.coalesce(name, F.lit(0.0)))
    return joined.withColumns(
        {
            "method": method, "reason": reason, "grid_spread": F.when(fault.isNull(), F.col("grid_spread")),
            "gradient_x": steady("gradient_x"), "gradient_y": steady("gradient_y"),
        }
    )


def homography_gate(rows: DataFrame, gates: Sequence[HomographyGate]) -> DataFrame:
    """Several acceptance gates on the same estimates: one output row per estimate and gate.

    ``fault`` carries an earlier failure (bad matrix, bad corners); rules are tried in order.
    """
    literal = F.array(
        *[
            F.struct(
                F.lit(g.name).alias("gate"), F.lit(g.mode).alias("mode"),
                *[F.lit(float(getattr(g, n))).alias(n) for n in (
                    "fixed_min_inlier_ratio", "high_inlier_ratio", "low_inlier_ratio", "min_matches", "min_inliers",
                    "max_condition_number", "max_reprojection_error_px", "min_spatial_coverage", "min_projected_overlap_ratio",
                )],
            )
            for g in gates
        ]
    )
    ratio = F.when(F.col("matches") > 0, F.col("inliers") / F.col("matches")).otherwise(0.0)
    tried = rows.withColumn("inlier_ratio", ratio).withColumn("_g", F.explode(literal))
    g = lambda name: F.col(f"_g.{name}")
    level = (
        F.when(F.col("inlier_ratio") >= g("high_inlier_ratio"), "high")
        .when(F.col("inlier_ratio") >= g("low_inlier_ratio"), "intermediate").otherwise("low")
    )
    fixed = g("mode") == "fixed"
    reason = (
        F.when(F.col("fault").isin("invalid_homography", "implausible_determinant"), F.col("fault"))
        .when(F.col("condition_number").isNull() | (F.col("condition_number") > g("max_condition_number")), "excessive_condition_number")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("matches") < g("min_matches"), "insufficient_matches")
        .when(F.col("inliers") < g("min_inliers"), "insufficient_inliers")
        .when(fixed & (F.col("inlier_ratio") >= g("fixed_min_inlier_ratio")), "fixed_accepted")
        .when(fixed, "low_inlier_ratio")
        .when(F.col("level") == "high", "adaptive_high_accepted")
        .when(F.col("level") == "low", "low_inlier_ratio")
        .when(F.col("reprojection_error").isNull() | (F.col("reprojection_error") > g("max_reprojection_error_px")), "high_reprojection_error")
        .when(F.col("spatial_coverage").isNull() | (F.col("spatial_coverage") < g("min_spatial_coverage")), "low_spatial_coverage")
        .when(F.col("projected_overlap") < g("min_projected_overlap_ratio"), "low_projected_overlap")
        .otherwise("adaptive_intermediate_accepted")
    )
    return (
        tried.withColumn("level", level).withColumn("reason", reason)
        .withColumn("gate", g("gate")).withColumn("accepted", F.col("reason").endswith("_accepted")).drop("_g")
    )


def hybrid_decision(policy: HybridPolicy = HybridPolicy()) -> tuple[Column, Column]:
    """Final motion and reason from box evidence (``bbox_*``) and flow evidence (``flow_*``)."""
    reliable = F.coalesce(
        F.col("bbox_matched") & (F.col("bbox_score") >= policy.min_association_score) & (F.col("bbox_iou") >= policy.min_iou),
        F.lit(False),
    )
    says = F.when(reliable, F.col("bbox_motion")).otherwise(UNKNOWN)
    decided = says.isin(MOVING, STATIONARY)
    flow = F.col("flow_motion")
    strong = (flow == MOVING) & (F.col("flow_residual") >= policy.strong_moving_residual_px) & (F.col("level") == "high")
    reason = (
        F.when(~F.col("homography_valid"), "invalid_homography")
        .when(F.col("bbox_reason") == "edge_unreliable", "frame_edge")
        .when(decided & (flow == says), "bbox_and_flow_agree")
        .when(decided & flow.isin(MOVING, STATIONARY), "bbox_flow_conflict")
        .when(decided, "reliable_bbox_flow_unknown")
        .when(F.coalesce(strong, F.lit(False)), "strong_flow_with_high_quality_homography")
        .when(~reliable, "bbox_association_unreliable")
        .otherwise("insufficient_consistent_evidence")
    )
    motion = (
        F.when(reason.isin("bbox_and_flow_agree", "reliable_bbox_flow_unknown"), says)
        .when(reason == "strong_flow_with_high_quality_homography", MOVING)
        .otherwise(UNKNOWN)
    )
    return motion, reason


MotionMethod = Callable[..., DataFrame]
# Methods by name; a caller adds its own function of the same signature.
MOTION_METHODS: dict[str, MotionMethod] = {
    "global_median": vehicle_motion_global,
    "homography": vehicle_motion_residual,
    "homography_local": vehicle_motion_local,
}


def vehicle_motion(method: str, samples: DataFrame, boxes: DataFrame, grid: FlowGrid, **settings) -> DataFrame:
    return MOTION_METHODS[method](samples, boxes, grid, **settings)


def final_motion(detections: DataFrame, confident: Column, measured: Column) -> DataFrame:
    """Published motion: other classes are unknown, vehicles stationary unless a confident
    measurement says otherwise."""
    motion = (
        F.when(F.col("cls") != VEHICLE, UNKNOWN)
        .when(confident, F.coalesce(measured, F.lit(STATIONARY))).otherwise(STATIONARY)
    )
    return detections.withColumn("motion_status", motion)


