"""Which landing pads are free."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.boxes import area, box, contains, intersection, ordered
from flightframe.functions.labels import (
    NOT_APPLICABLE, PAD_A, PAD_B, PERSON, SUITABLE, UNSUITABLE, VEHICLE,
)
from flightframe.operators.overlap import join_meeting_boxes
from flightframe.policies import LandingPolicy



def _sides(detections: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    pads = detections.where(F.col("cls").isin(PAD_A, PAD_B))
    obstacles = detections.where(F.col("cls").isin(VEHICLE, PERSON)).select(
        *keys, F.col("det_index").alias("o_index"), F.col("cls").alias("o_cls"),
        *[F.col(f"c{n}").alias(f"o_{n}") for n in ("x1", "y1", "x2", "y2")],
    )
    return pads, obstacles


def _occupied(policy: LandingPolicy) -> Column:
    shared = intersection(box("c"), box("o_"))
    middle_x, middle_y = box("o_").center
    enough = F.try_divide(shared, area(box("c"))) >= policy.occupancy_ratio
    if policy.use_center_check:
        enough = enough | contains(box("c"), middle_x, middle_y)
    if policy.use_bottom_center_check:
        enough = enough | contains(box("c"), middle_x, box("o_").y2)
    # Pads without a partner carry null obstacles, which least and greatest would skip.
    return box("o_").x1.isNotNull() & (shared >= policy.min_intersection_pixels) & enough


def _margin(width: Column, height: Column, policy: LandingPolicy) -> Column:
    return F.greatest(F.lit(policy.edge_margin_px), F.least(width, height) * policy.edge_margin_ratio)


def _outside(width: Column, height: Column, policy: LandingPolicy) -> Column:
    raw, margin = box(), _margin(width, height, policy)
    return (raw.x1 < -margin) | (raw.y1 < -margin) | (raw.x2 > width + margin) | (raw.y2 > height + margin)


def landing_status(
    detections: DataFrame,
    width: Column,
    height: Column,
    policy: LandingPolicy = LandingPolicy(),
    keys: Sequence[str] = ("frame",),
) -> DataFrame:
    """One row per pad with ``landing_status``. The order of rules matters: invalid box,
    outside the frame tolerance, too small, occupied, free."""
    pads, obstacles = _sides(detections, keys)
    slim = pads.select(*keys, "det_index", "cx1", "cy1", "cx2", "cy2")
    met = join_meeting_boxes(slim, obstacles.drop("o_index", "o_cls"), keys, box("c"), box("o_"), salt_by=["det_index"])
    hits = met.where(_occupied(policy)).select(*keys, "det_index").distinct().withColumn("occupied", F.lit(True))
    folded = pads.join(hits, [*keys, "det_index"], "left").withColumn("occupied", F.coalesce("occupied", F.lit(False)))
    status = (
        F.when((width <= 0) | (height <= 0) | ~ordered(box()) | ~ordered(box("c")), NOT_APPLICABLE)
        .when(_outside(width, height, policy), UNSUITABLE)
        .when(area(box("c")) < policy.min_area_pixels, NOT_APPLICABLE)
        .when(F.col("occupied"), UNSUITABLE)
        .otherwise(SUITABLE)
    )
    return folded.withColumn("landing_status", status)


def landing_pairs(
    detections: DataFrame, policy: LandingPolicy = LandingPolicy(), keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """Measured overlap of every pad with every obstacle that meets it."""
    pads, obstacles = _sides(detections, keys)
    joined = join_meeting_boxes(
        pads.select(*keys, "det_index", "cx1", "cy1", "cx2", "cy2"), obstacles, keys, box("c"), box("o_"),
        salt_by=["det_index"],
    )
    middle_x, middle_y = box("o_").center
    shared = intersection(box("c"), box("o_"))
    return joined.select(
        *keys, "det_index", "o_index", "o_cls",
        shared.alias("intersection_area"),
        F.try_divide(shared, area(box("c"))).alias("intersection_over_landing"),
        contains(box("c"), middle_x, middle_y).alias("center_inside"),
        contains(box("c"), middle_x, box("o_").y2).alias("bottom_center_inside"),
        _occupied(policy).alias("occupied"),
    )


def landing_diagnostics(
    detections: DataFrame,
    width: Column,
    height: Column,
    policy: LandingPolicy = LandingPolicy(),
    keys: Sequence[str] = ("frame",),
) -> DataFrame:
    """Per pad: areas, edge flag, and the reason of its status (class of the first occupying
    obstacle in detection order)."""
    pads, obstacles = _sides(detections, keys)
    kept = [c for c in pads.columns if c not in (*keys, "det_index")]
    joined = join_meeting_boxes(pads, obstacles, keys, box("c"), box("o_"), how="left", salt_by=["det_index"])
    occupied = F.coalesce(_occupied(policy), F.lit(False))
    folded = joined.groupBy(*keys, "det_index").agg(
        *[F.any_value(c).alias(c) for c in kept],
        F.min_by("o_cls", F.when(occupied, F.col("o_index"))).alias("occupied_by"),
        F.count(F.when(occupied, F.lit(1))).alias("occupying"),
    )
    raw = box()
    valid = ordered(raw) & ordered(box("c"))
    reason = (
        F.when((width <= 0) | (height <= 0) | ~valid, "invalid_bbox")
        .when(_outside(width, height, policy), "outside_frame_tolerance")
        .when(area(box("c")) < policy.min_area_pixels, "bbox_too_small")
        .when(F.col("occupied_by") == VEHICLE, "occupied_by_vehicle")
        .when(F.col("occupied_by") == PERSON, "occupied_by_person")
        .otherwise("clear_landing_area")
    )
    edge = (
        (raw.x1 < 0) | (raw.y1 < 0) | (raw.x2 > width) | (raw.y2 > height)
        | (box("c").x1 <= 1) | (box("c").y1 <= 1) | (box("c").x2 >= width - 1) | (box("c").y2 >= height - 1)
    )
    return folded.select(
        *keys, "det_index", "cls",
        area(raw).alias("bbox_area"), area(box("c")).alias("visible_area"),
        F.when(area(raw) > 0, area(box("c")) / area(raw)).otherwise(0.0).alias("visible_ratio"),
        (edge & valid).alias("frame_edge"), valid.alias("bbox_valid"),
        _margin(width, height, policy).alias("edge_margin_px"),
        "occupying", "occupied_by", reason.alias("decision_reason"),
    )
