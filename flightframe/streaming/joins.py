"""Live joins: frames answered once, references in force, and the three task results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.operators.references import is_active
from flightframe.plans.intervals import IntervalIndex


def answered_once(frames: DataFrame, keys: Sequence[str] = ("session", "frame_id"), order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Batch form: the first arrival of each frame, and the later ones as errors."""
    keys = list(keys)
    first = frames.groupBy(*keys).agg(F.min(order).alias("_first"))
    joined = frames.join(first, keys)
    again = joined.where(F.col(order) != F.col("_first")).drop("_first")
    return joined.where(F.col(order) == F.col("_first")).drop("_first"), again.withColumn("error", F.lit("duplicate_frame"))


def dedupe_frames_stream(frames: DataFrame, at: str = "ts", delay: str = "30 minutes", keys: Sequence[str] = ("session", "frame_id")) -> DataFrame:
    """Each frame goes on once while it can still repeat."""
    return frames.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def current_references(references: DataFrame) -> DataFrame:
    """The newest generation of each session's reference set."""
    newest = references.groupBy("session").agg(F.max("generation").alias("generation"))
    return references.join(newest, ["session", "generation"], "left_semi")


def active_references_stream(frames: DataFrame, references: DataFrame) -> DataFrame:
    """Live frames with the references in force; ``generation`` tells which set answered. The index of their windows
    is made when the stream starts, so a new set takes effect with a new start."""
    index = IntervalIndex(current_references(references), ["session"], "active_from", "active_until")
    return index.holding(frames, "frame_index").where(is_active(F.col("frame_index"), F.col("active_from"), F.col("active_until")))


def drop_stale(matches: DataFrame, references: DataFrame) -> DataFrame:
    """Matches found with a reference set that has been replaced do not count."""
    newest = references.groupBy("session").agg(F.max("generation").alias("generation"))
    return matches.join(newest, ["session", "generation"], "left_semi")


def combine_tasks_stream(
    frames: DataFrame, detections: DataFrame, translations: DataFrame, matches: DataFrame,
    limit: str = "30 seconds", delay: str = "1 minute",
) -> DataFrame:
    """Frames with the results that came within the limit; a missing part stays empty.

    Every input has ``session, frame_id, ts``; result inputs have one row per frame with their
    list or position as ``detected``, ``position`` and ``found``.
    """
    joined = frames.withWatermark("ts", delay)
    for name, part in (("detected", detections), ("position", translations), ("found", matches)):
        side = part.select(
            F.col("session").alias(f"{name}_s"), F.col("frame_id").alias(f"{name}_f"), F.col("ts").alias(f"{name}_ts"), name
        ).withWatermark(f"{name}_ts", delay)
        match = (
            (F.col("session") == F.col(f"{name}_s")) & (F.col("frame_id") == F.col(f"{name}_f"))
            & (F.col(f"{name}_ts") >= F.col("ts")) & (F.col(f"{name}_ts") <= F.col("ts") + F.expr(f"interval {limit}"))
        )
        joined = joined.join(side, match, "leftOuter").drop(f"{name}_s", f"{name}_f", f"{name}_ts")
    return joined
