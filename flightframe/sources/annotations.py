"""Ground truth from XML, and checks of an annotated data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightframe import schema
from flightframe.functions.labels import normalize_motion_label
from flightframe.functions.numbers import finite_number
from flightframe.functions.boxes import Box
from flightframe.plans.settle import settle


def _parsed_box(o: Column) -> Column:
    """The box of an object: first spelling whose four numbers are finite and ordered."""
    def reading(container: Column, names: tuple[str, ...]) -> Column:
        b = Box(*[finite_number(container[n]) for n in names])
        return F.when((b.x2 > b.x1) & (b.y2 > b.y1), F.struct(*b.named()))

    first, second = ("xmin", "ymin", "xmax", "ymax"), ("x1", "y1", "x2", "y2")
    in_box = lambda c: F.coalesce(reading(c, first), reading(c, second))
    return F.when(o["bndbox"].isNotNull(), in_box(o["bndbox"])).otherwise(in_box(o["bbox"]))


def parse_annotations(files: DataFrame, path: str = "path", text: str = "xml") -> DataFrame:
    """One row per annotated object, in file order, with its ``error`` (null when good)."""
    # Generators hand their output on as finished values, so each text is parsed once.
    parsed = files.select(path, F.explode(F.array(F.from_xml(text, schema.ANNOTATION))).alias("a"))
    tags = ("motion", "motion_status", "hareket", "name", "class")
    facts = F.transform(
        "a.object",
        lambda o: F.struct(
            F.coalesce(*[normalize_motion_label(o[t]) for t in tags]).alias("motion"), _parsed_box(o).alias("_b")
        ),
    )
    staged = parsed.select(
        path, F.col("a.filename").alias("filename"),
        F.coalesce(F.trim("a.size.width").try_cast("int"), F.lit(0)).alias("width"),
        F.coalesce(F.trim("a.size.height").try_cast("int"), F.lit(0)).alias("height"),
        F.posexplode(facts).alias("object_index", "o"),
    ).select(path, "filename", "width", "height", "object_index", "o.*")
    b = Box(*[F.col(f"_b.{n}") for n in ("x1", "y1", "x2", "y2")])
    within = (b.x1 >= 0) & (b.x2 <= F.col("width")) & (b.y1 >= 0) & (b.y2 <= F.col("height"))
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    error = (
        F.when(F.col("motion").isNull(), "invalid_motion_label").when(F.col("_b").isNull(), "invalid_bbox")
        .when(sized & ~within, "bbox_out_of_bounds")
    )
    staged = staged.withColumn("error", error)
    # The first of equal objects stays. Equal ones are of one file, so of one row before; a join would parse the files again.
    good = F.when(F.col("error").isNull(), F.col("object_index"))
    first = F.min(good).over(Window.partitionBy(path, "motion", "_b"))
    repeated = F.col("error").isNull() & (F.col("object_index") > F.col("_first"))
    return staged.withColumn("_first", first).select(
        path, "filename", "width", "height", "object_index", "motion", "_b.x1", "_b.y1", "_b.x2", "_b.y2",
        F.when(repeated, "duplicate_object").otherwise(F.col("error")).alias("error"),
    )


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
    return parse_annotations(files.select("path", F.col("content").cast("string").alias("xml")))


def stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]+$", ""))


def dataset_issues(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Problems of a data set by file stem. ``images``: name; ``annotations``: path, filename,
    width, height (one row per file)."""
    left = images.select(stem(F.col("name")).alias("stem"), F.lit(True).alias("has_image"))
    right = annotations.select(
        stem(F.col("path")).alias("stem"), F.lit(True).alias("has_xml"),
        F.trim(F.coalesce("filename", F.lit(""))).alias("filename"), "width", "height",
    )
    both = left.join(right, "stem", "full_outer")
    xml = F.coalesce("has_xml", F.lit(False))
    rules = [
        (~xml, "missing_xml"),
        (xml & (F.col("filename") == ""), "missing_filename"),
        (xml & (F.col("filename") != "") & (stem(F.col("filename")) != F.col("stem")), "image_basename_mismatch"),
        (xml & F.col("has_image").isNull(), "missing_image"),
        (xml & ((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0)), "invalid_image_size"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda n: n.isNotNull())
    return both.select("stem", F.explode(found).alias("error"))


def dataset_profile(frames: DataFrame, pairs: DataFrame, objects: DataFrame) -> DataFrame:
    """Counts of frames, annotated files, pairs, and good objects by label, as one row each."""
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
    # Objects come out of parsing, so they are gone through once.
    counted = settle(objects.groupBy("path", "motion").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n")))
    labels = counted.where("n > 0").groupBy("motion").agg(F.sum("n").alias("n")).select(F.concat(F.lit("objects_"), "motion").alias("item"), "n")
    files = counted.select("path").distinct()
    return count("frames", frames).unionByName(count("pairs", pairs)).unionByName(count("annotations", files)).unionByName(labels)
