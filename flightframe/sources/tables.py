"""Evaluation tables in text form, and writing of results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe import schema
from flightframe.functions.boxes import Box, touches_edge, with_parsed_box
from flightframe.functions.labels import MOVING, STATIONARY
from flightframe.functions.numbers import first_number, truth
from flightframe.plans.settle import settle


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, all columns as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def check_pair_truth(rows: DataFrame, name: Column | None = None) -> DataFrame:
    """Pair truth with normalised keys and an ``error`` per row: a value other than 0, 1 or
    IGNORE, or a key that occurs again."""
    tidy = name if name is not None else F.trim
    staged = rows.select(
        tidy(F.col("reference_id")).alias("reference_id"), tidy(F.col("frame_name")).alias("frame_name"),
        F.upper(F.trim("expected_match")).alias("expected"),
    )
    # Counting is combined before the shuffle and joined back, so a key repeated without end
    # never has to meet in one window.
    repeats = staged.groupBy("reference_id", "frame_name").agg(F.count(F.lit(1)).alias("copies"))
    error = F.when(~F.col("expected").isin("0", "1", "IGNORE"), "invalid_expected_match").when(
        F.col("copies") > 1, "duplicate_key"
    )
    return staged.join(repeats, ["reference_id", "frame_name"]).withColumn("error", error).drop("copies")


def read_pair_truth(spark: SparkSession, path: str) -> DataFrame:
    from flightframe.functions.labels import canonical_name

    rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema.PAIR_TRUTH).csv(path)
    return check_pair_truth(rows, canonical_name)


def write_reports(reports: Mapping[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each named result as its own table below ``folder``."""
    for name, df in reports.items():
        df.write.mode("overwrite").format(form).option("header", True).save(f"{folder}/{name}")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def enrich_samples(evals: DataFrame, diagnostics: DataFrame, quality: DataFrame, shapes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Matched, judged evaluation rows with typed measurements, and the malformed rows.

    ``diagnostics`` (frame_previous, frame_current, vehicle_index) and ``quality``
    (previous_frame, current_frame) are looked up with their last row winning; all inputs are
    text and carry ``line_no``.
    """
    judged = evals.where(truth(F.col("matched")) & ~truth(F.col("ignored")))
    staged = judged.withColumns(
        {
            "gt": F.lower(F.trim("gt_motion")), "detection_index": F.trim("matched_detection_index"),
        }
    )
    staged = with_parsed_box(staged, F.col("detection_bbox"))
    error = F.when(~F.coalesce(F.col("gt").isin(MOVING, STATIONARY), F.lit(False)), "invalid gt_motion").when(
        (F.coalesce("detection_index", F.lit("")) == "") | F.col("box").isNull(), "invalid matched detection"
    )
    staged = settle(staged.withColumn("error", error))
    malformed = staged.where(F.col("error").isNotNull()).select("line_no", "error")
    d_keys, q_keys = ["previous_frame", "current_frame", "detection_index"], ["previous_frame", "current_frame"]
    found = latest(
        diagnostics.withColumnsRenamed({"frame_previous": "previous_frame", "frame_current": "current_frame", "vehicle_index": "detection_index"}),
        d_keys, "line_no",
    ).drop("line_no")
    found = found.withColumnsRenamed({c: f"d_{c}" for c in found.columns if c not in d_keys})
    measured = latest(quality, q_keys, "line_no").drop("line_no")
    measured = measured.withColumnsRenamed({c: f"q_{c}" for c in measured.columns if c not in q_keys})
    joined = staged.where(F.col("error").isNull()).join(found, d_keys, "left").join(measured, q_keys, "left")
    b = Box(*[F.col(f"box.{n}") for n in ("x1", "y1", "x2", "y2")])
    edge = F.lit(False)
    if shapes is not None:
        joined = joined.join(shapes.withColumnRenamed("frame", "current_frame"), "current_frame", "left")
        edge = F.coalesce(touches_edge(b, F.col("width"), F.col("height")), F.lit(False))
    col = F.col
    out = joined.select(
        "line_no", *d_keys, "gt_object_index", col("gt").alias("gt_motion"), *b.named(),
        b.width.alias("bbox_width"), b.height.alias("bbox_height"), (b.width * b.height).alias("bbox_area"),
        edge.alias("frame_edge"), first_number(col("detection_confidence")).alias("detection_confidence"),
        truth(col("homography_valid")).alias("homography_valid"),
        F.coalesce("d_hybrid_homography_quality_level", "homography_quality_level").alias("homography_quality_level"),
        first_number(col("d_bbox_center_residual_px"), col("bbox_center_residual")).alias("bbox_center_residual"),
        first_number(col("d_bbox_iou"), col("bbox_iou")).alias("bbox_iou"),
        first_number(col("d_bbox_size_ratio")).alias("bbox_size_ratio"),
        first_number(col("d_bbox_association_score")).alias("association_score"),
        first_number(col("d_homography_residual_px"), col("flow_residual")).alias("flow_residual"),
        first_number(col("d_local_corrected_residual_magnitude"), col("local_corrected_residual")).alias("local_corrected_residual"),
        first_number(col("q_reprojection_error")).alias("reprojection_error"),
        first_number(col("q_spatial_coverage")).alias("spatial_coverage"),
        *[c for c in evals.columns if c.endswith("_prediction")],
    )
    return out, malformed
