"""Pairing boxes: with ground truth, and across frames after camera compensation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.functions.boxes import area, box, center_distance, diagonal, iou, touches_edge
from flightframe.functions.labels import MOVING, STATIONARY, UNKNOWN, VEHICLE
from flightframe.functions.polygons import MATRIX, matrix, with_projected_box
from flightframe.operators.greedy import greedy_one_to_one
from flightframe.operators.overlap import join_meeting_boxes
from flightframe.policies import BoxMotionPolicy



def iou_candidates(truth: DataFrame, detections: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Every meeting pair of truth and detection with its IoU (pairs apart have IoU zero)."""
    right = detections.select(
        *keys, "det_index", *[F.col(n).alias(f"d_{n}") for n in ("x1", "y1", "x2", "y2")]
    )
    pairs = join_meeting_boxes(
        truth.select(*keys, "gt_index", "x1", "y1", "x2", "y2"), right, keys, box(), box("d_"), salt_by=["gt_index"]
    )
    return pairs.select(*keys, "gt_index", "det_index", iou(box(), box("d_")).alias("score"))


def associate_ground_truth(
    truth: DataFrame, detections: DataFrame, min_iou: float, keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """One row per truth object: its detection (or null) and the best IoU it had with any."""
    from flightframe.plans.settle import settle

    key = [*keys, "gt_index"]
    pairs = settle(iou_candidates(truth, detections, keys))
    matches = greedy_one_to_one(pairs.where(F.col("score") >= min_iou), keys, "gt_index", "det_index", "score", settled=True)
    # What an object had and what it took meet in one aggregate.
    none = lambda c: F.lit(None).cast(pairs.schema[c].dataType)
    told = pairs.select(*key, F.col("score").alias("best_iou"), none("det_index").alias("det_index"), none("score").alias("match_iou")).union(
        matches.select(*key, none("score"), "det_index", "score"))
    found = told.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("best_iou", "det_index", "match_iou")])
    return truth.join(found, key, "left").withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0)))


def unmatched_truth(associated: DataFrame) -> DataFrame:
    return associated.where(F.col("det_index").isNull())


def unmatched_detections(
    detections: DataFrame, truth: DataFrame, matches: DataFrame, keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """Detections no truth object took, with the best IoU they had."""
    key = [*keys, "det_index"]
    best = iou_candidates(truth, detections, keys).groupBy(*key).agg(F.max("score").alias("best_iou"))
    taken = matches.where(F.col("det_index").isNotNull()).select(*key)
    return (
        detections.join(taken, key, "left_anti").join(best, key, "left")
        .withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0)))
    )


def track_candidates(
    previous: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = ("pair",),
    policy: BoxMotionPolicy = BoxMotionPolicy(),
) -> DataFrame:
    """Scored pairs of projected previous vehicles and current vehicles of one frame pair.

    Both sides carry ``width`` and ``height``; ``previous`` also the matrix ``h11..h33``.
    """
    width, height = F.col("width"), F.col("height")
    projected = (
        with_projected_box(previous.where(F.col("cls") == VEHICLE), matrix(), box(), width, height, policy)
        .where("image_valid")
        .select(
            *keys, F.col("det_index").alias("p_index"),
            *[F.col(f"image_{n}").alias(f"p_{n}") for n in ("x1", "y1", "x2", "y2", "cx", "cy")],
            F.col("image_edge_reliable").alias("p_reliable"),
        )
    )
    right = current.where(F.col("cls") == VEHICLE).select(
        *keys, "det_index", *[F.col(n).alias(f"d_{n}") for n in ("x1", "y1", "x2", "y2")],
        F.col("width").alias("d_w"), F.col("height").alias("d_h"),
    )
    if policy.match_min_iou <= 0:
        raise ValueError("match_min_iou must be positive: boxes apart are not candidates")
    pairs = join_meeting_boxes(projected, right, keys, box("p_"), box("d_"), salt_by=["p_index"])
    shared = iou(box("p_"), box("d_"))
    distance = center_distance(F.col("p_cx"), F.col("p_cy"), box("d_"))
    ratio = distance / F.greatest(diagonal(box("p_")), diagonal(box("d_")), F.lit(1.0))
    size = area(box("d_")) / F.greatest(area(box("p_")), F.lit(1e-12))
    quality = F.greatest(F.lit(0.0), 1.0 - F.col("center_ratio") / policy.match_max_center_distance_ratio)
    score = 0.6 * F.col("iou") + 0.3 * quality + 0.1 * F.least(F.col("size_ratio"), F.try_divide(F.lit(1.0), F.col("size_ratio")))
    reliable = F.col("p_reliable") & ~touches_edge(box("d_"), F.col("d_w"), F.col("d_h"))
    # A generator hands its output on as finished values: the gates below do not repeat them.
    facts = F.struct(
        shared.alias("iou"), distance.alias("center_residual"), ratio.alias("center_ratio"), size.alias("size_ratio"),
        reliable.alias("edge_reliable"),
    )
    return (
        pairs.select(*keys, "p_index", "det_index", F.inline(F.array(facts)))
        .where(
            (F.col("iou") >= policy.match_min_iou)
            & (F.col("center_ratio") <= policy.match_max_center_distance_ratio)
            & F.col("size_ratio").between(policy.min_size_ratio, policy.max_size_ratio)
        )
        .withColumn("score", score)
        .where(F.col("score") >= policy.match_min_score)
    )


def associate_tracks(
    previous: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = ("pair",),
    policy: BoxMotionPolicy = BoxMotionPolicy(),
) -> DataFrame:
    """Motion of every current vehicle from its projected match; unmatched ones are unknown."""
    from flightframe.plans.settle import settle

    candidates = settle(track_candidates(previous, current, keys, policy))
    chosen = greedy_one_to_one(candidates, keys, "p_index", "det_index", "score", settled=True).drop("score")
    matched = chosen.join(candidates, [*keys, "p_index", "det_index"])
    key = [*keys, "det_index"]
    residual = F.col("center_residual")
    reason = (
        F.when(F.col("p_index").isNull(), "unmatched")
        .when(~F.col("edge_reliable"), "edge_unreliable")
        .when((residual <= policy.stationary_threshold_px) & (F.col("iou") >= policy.match_min_iou), "stationary")
        .when(residual >= policy.moving_threshold_px, "moving")
        .otherwise("hysteresis")
    )
    status = F.when(F.col("reason").isin(MOVING, STATIONARY), F.col("reason")).otherwise(UNKNOWN)
    return (
        current.where(F.col("cls") == VEHICLE).select(*key).join(matched, key, "left")
        .withColumn("reason", reason).withColumn("motion", status)
    )


__all__ = [
    "MATRIX", "associate_ground_truth", "associate_tracks", "iou_candidates", "track_candidates",
    "unmatched_detections", "unmatched_truth",
]
