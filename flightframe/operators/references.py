"""Reference objects: reading, activity windows, names and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.labels import frame_index_of
from flightframe.plans.intervals import IntervalIndex
from flightframe.plans.scans import CHUNK, ranged_axis, scan


def read_references(raw: DataFrame) -> DataFrame:
    """Typed references with ``error`` (null when good). Ids count the good ones by order; the
    end frame is exclusive in the payload, so it moves back by one where the window is longer.

    Needs position, order_no, url, image_url, frame_start/end and their image urls.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    bound = lambda name: F.coalesce(frame_index_of(F.col(name)), frame_index_of(F.col(f"{name}_image_url")))
    staged = raw.withColumns(
        {"official_url": F.trim("url"), "start": bound("frame_start"), "stop": bound("frame_end")}
    )
    orders = staged.groupBy("order_no").agg(F.min("position").alias("_first_order"))
    urls = staged.groupBy("official_url").agg(F.min("position").alias("_first_url"))
    staged = staged.join(orders, "order_no", "left").join(urls, "official_url", "left")
    error = (
        F.when(blank("url"), "url_empty").when(blank("image_url"), "image_url_empty")
        .when(F.col("order_no").isNull() | (F.col("order_no") < 0), "order_invalid")
        .when(F.col("position") > F.col("_first_order"), "order_repeated")
        .when(F.col("position") > F.col("_first_url"), "url_repeated")
        .when(F.col("start").isNull() | F.col("stop").isNull(), "bound_invalid")
        .when(F.col("stop") < F.col("start"), "bound_order")
    )
    staged = staged.withColumn("error", error)
    ordered, axis = ranged_axis(staged, [], ["order_no", "position"])
    good = F.col("error").isNull()
    numbered = scan(ordered, axis, sums={"_n": F.when(good, 1).otherwise(0)})
    until = F.when(F.col("stop") > F.col("start"), F.col("stop") - 1).otherwise(F.col("stop"))
    return numbered.select(
        "position", "order_no", "official_url", "image_url", F.when(good, F.col("_n")).alias("object_id"),
        F.when(good, F.col("start")).alias("active_from"), F.when(good, until).alias("active_until"), "error",
    )


def is_active(frame_index: Column, start: Column, stop: Column) -> Column:
    """Without bounds always; with a bound never for an unknown index; bounds are inclusive."""
    inside = (start.isNull() | (frame_index >= start)) & (stop.isNull() | (frame_index <= stop))
    return F.when(start.isNull() & stop.isNull(), F.lit(True)).otherwise(
        F.coalesce(frame_index.isNotNull() & inside, F.lit(False))
    )


def active_references(frames: DataFrame, references: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Every frame with each reference active at it, through an index of the activity windows."""
    index = IntervalIndex(references, keys, "active_from", "active_until")
    active = is_active(F.col("frame_index"), F.col("active_from"), F.col("active_until"))
    return index.holding(frames, "frame_index").where(active)


def reference_urls(matches: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches with the official url of their object, and matches of unknown objects."""
    named = matches.join(references.select("object_id", "official_url"), "object_id", "left")
    return named.where(F.col("official_url").isNotNull()), named.where(F.col("official_url").isNull())


def evaluation_pairs(references: DataFrame, frames: DataFrame, truth: DataFrame) -> DataFrame:
    """Every reference with every frame and the expected answer if there is one; all pairs are
    the result asked for, whatever the number of references."""
    pairs = frames.select("frame_name").crossJoin(references.select("reference_id").distinct())
    return pairs.join(truth.select("reference_id", "frame_name", "expected"), ["reference_id", "frame_name"], "left")


def truth_resolution(truth: DataFrame, references: DataFrame, frames: DataFrame, canonical) -> DataFrame:
    """Which truth rows name a known reference and frame, and whether tidying changed a name."""
    rows = truth.withColumns({"reference": canonical(F.col("reference_id")), "frame": canonical(F.col("frame_name"))})
    known_r = references.select(canonical(F.col("reference_id")).alias("reference")).distinct().withColumn("_r", F.lit(True))
    known_f = frames.select(canonical(F.col("frame_name")).alias("frame")).distinct().withColumn("_f", F.lit(True))
    joined = rows.join(known_r, "reference", "left").join(known_f, "frame", "left")
    return joined.select(
        "reference_id", "frame_name", "reference", "frame", "expected",
        F.col("_r").isNotNull().alias("reference_resolved"), F.col("_f").isNotNull().alias("frame_resolved"),
        (F.col("reference_id") != F.col("reference")).alias("reference_changed"),
        (F.col("frame_name") != F.col("frame")).alias("frame_changed"),
    )
