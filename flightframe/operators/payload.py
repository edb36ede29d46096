"""One nested answer per frame from the three task results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.labels import class_code, landing_code, motion_code

_SIDES = (("x1", "top_left_x"), ("y1", "top_left_y"), ("x2", "bottom_right_x"), ("y2", "bottom_right_y"))


def class_url(cls: Column, server: str) -> Column:
    base = server if server.endswith("/") else f"{server}/"
    return F.concat(F.lit(f"{base}classes/"), (class_code(cls) + 1).cast("string"), F.lit("/"))


def _listed(rows: DataFrame, keys: list[str], order: str, body: Column, name: str) -> DataFrame:
    """One array per frame, in order; a frame holds as many boxes as a picture can show."""
    entry = F.struct(F.col(order).alias("o"), body.alias("b"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["b"]).alias(name))


def combine_tasks(
    frames: DataFrame, detections: DataFrame, translations: DataFrame, matches: DataFrame,
    keys: Sequence[str] = ("frame",), server: str = "http://server/",
) -> DataFrame:
    """Every frame with its three result lists; a task without a result leaves an empty list."""
    keys = list(keys)
    text = lambda c: F.col(c).cast("string")
    sides = [text(c).alias(n) for c, n in _SIDES]
    detected = F.struct(
        class_url(F.col("cls"), server).alias("cls"), landing_code(F.col("landing_status")).alias("landing_status"),
        motion_code(F.col("motion_status")).alias("moving_status"), *sides,
    )
    position = F.struct(*[text(c).alias(f"translation_{c}") for c in "xyz"])
    found = F.struct(F.col("official_url").alias("reference"), *sides)
    joined = frames
    parts = (
        (detections, "det_index", detected, "detected_objects"),
        (translations, "x", position, "detected_translations"),
        (matches, "object_id", found, "reference_predictions"),
    )
    for rows, order, body, name in parts:
        joined = joined.join(_listed(rows, keys, order, body, name), keys, "left")
        empty = F.array().cast(joined.schema[name].dataType)
        joined = joined.withColumn(name, F.coalesce(name, empty))
    return joined


def prediction_payload(combined: DataFrame, frame_url: Column, keys: Sequence[str] = ("frame",)) -> DataFrame:
    body = F.struct(frame_url.alias("frame"), "detected_objects", "detected_translations", "reference_predictions")
    return combined.select(*keys, F.to_json(body).alias("payload"))


def affine_matrix(cx: float, cy: float) -> Column:
    """The 2x3 matrix a step (dx, dy, yaw) stands for; null for an invalid step."""
    yaw, dx, dy = F.col("yaw"), F.col("dx"), F.col("dy")
    rows = F.array(F.array(F.lit(1.0), yaw, -dx - yaw * cy), F.array(-yaw, F.lit(1.0), -dy + yaw * cx))
    return F.when(F.col("valid"), rows)
