"""From raw model boxes to typed detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.boxes import Box, box, clip, ordered
from flightframe.functions.labels import detection_class
from flightframe.policies import DetectionPolicy


def normalize_detections(
    raw: DataFrame, width: Column, height: Column, policy: DetectionPolicy = DetectionPolicy()
) -> DataFrame:
    """Keep mapped, confident boxes that are ordered and partly inside the frame.

    Needs ``class_id``, ``conf`` and ``x1..y2``; adds ``cls`` and the clipped box ``cx1..cy2``.
    """
    b = box()
    inside = clip(b, width, height)
    clipped = {f"c{name}": column for name, column in zip(("x1", "y1", "x2", "y2"), inside)}
    # NaN compares as the largest value, so NaN confidences fail the upper bound.
    confident = F.col("conf").between(policy.min_confidence, 1.0) & ~F.isnan("conf")
    # An ordered box has something left after clipping exactly when it reaches into the frame.
    reaches = (b.x2 > 0) & (b.x1 < width) & (b.y2 > 0) & (b.y1 < height)
    return (
        raw.withColumn("cls", detection_class(F.col("class_id")))
        .where(F.col("cls").isNotNull() & confident & ordered(b) & reaches)
        .withColumns(clipped)
    )


def clipped_box() -> Box:
    return box("c")
