"""Frames and translations as they arrive: text payloads to typed, checked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe import schema
from flightframe.functions.labels import IMAGE_EXTENSIONS
from flightframe.functions.numbers import finite_number


def unknown_fields(payload: Column, known: Sequence[str]) -> Column:
    """Sorted names in a JSON object that are not known."""
    return F.array_sort(F.array_except(F.json_object_keys(payload), F.array(*[F.lit(k) for k in known])))


def parse_frames(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Frame JSON to columns; ``errors`` lists missing required fields."""
    body = F.from_json(payload, schema.RAW_FRAME)
    parsed = raw.withColumn("_b", body)
    missing = F.array(*[F.when(F.col(f"_b.{n}").isNull(), F.lit(f"missing_{n}")) for n in schema.FRAME_FIELDS])
    return parsed.select(
        *[c for c in raw.columns if c != payload], "_b.*",
        unknown_fields(F.col(payload), schema.FRAME_FIELDS).alias("unknown_fields"),
        F.filter(missing, lambda m: m.isNotNull()).alias("errors"),
    )


def parse_translations(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Translation JSON to columns: not-a-number text becomes null, a health that is no integer
    is an error."""
    parsed = raw.withColumn("_b", F.from_json(payload, schema.RAW_TRANSLATION))
    text = F.trim("_b.health_status")
    health = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    bad = F.col("_b.health_status").isNotNull() & (health.isNull() | ~health.isin(0, 1))
    return parsed.select(
        *[c for c in raw.columns if c != payload],
        health.alias("health"),
        *[finite_number(F.col(f"_b.translation_{axis}")).alias(f"gps_{axis}") for axis in "xyz"],
        F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit("invalid_health_status"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


def frame_context(frames: DataFrame, translations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames with their translation, which may be missing."""
    return frames.join(translations.drop("errors"), list(keys), "left")


def failed_rules(df: DataFrame) -> Column:
    """Names of the request rules a row breaks."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    source = F.lower(F.regexp_extract(F.trim("image_url"), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    # A one-letter scheme is a drive, so a path.
    allowed = (source == "") | (F.length(source) == 1) | source.isin("file", "http", "https")
    rules = [
        (blank("url"), "url_empty"), (blank("image_url"), "image_url_empty"), (blank("video"), "video_empty"),
        (blank("session"), "session_empty"), (F.col("frame_index") < 0, "frame_index_negative"),
        (~blank("image_url") & ~allowed, "image_source_scheme"),
        (F.col("active_until") < F.col("active_from"), "active_range"),
    ]
    names = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules])
    return F.filter(names, lambda n: n.isNotNull())


def validate_frames(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with ``failed``."""
    checked = df.withColumn("failed", failed_rules(df))
    return checked.where(F.size("failed") == 0).drop("failed"), checked.where(F.size("failed") > 0)


def parse_file_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Image names to sequence (prefix in lower case) and frame number; other files drop out."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return (
        names.where(extension.isin(*IMAGE_EXTENSIONS))
        .withColumn("_stem", stem)
        .where(F.col("_stem").rlike(r"\d$"))
        .withColumn("sequence", F.lower(F.regexp_extract("_stem", r"^(.*?)(\d+)$", 1)))
        .withColumn("number", F.regexp_extract("_stem", r"^(.*?)(\d+)$", 2).try_cast("long"))
        .drop("_stem")
    )


def frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder; contents are never read."""
    listed = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return parse_file_names(listed.withColumn("name", F.substring_index("path", "/", -1)))


def picture_format(content: Column) -> Column:
    """Format by leading bytes, null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def content_catalog(files: DataFrame, content: str = "content") -> DataFrame:
    kept = [c for c in files.columns if c != content]
    return files.select(
        *kept, picture_format(F.col(content)).alias("format"), F.sha2(F.col(content), 256).alias("content_hash"),
        F.octet_length(F.col(content)).cast("long").alias("bytes"),
    )


def camera_compatible(frames: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Frames of exactly the camera's resolution, and the others with the reason."""
    same = F.coalesce((F.col("width") == width) & (F.col("height") == height), F.lit(False))
    rejected = frames.where(~same).select(
        "*", F.lit("camera_resolution_mismatch").alias("reject_reason"),
        F.lit(width).alias("expected_width"), F.lit(height).alias("expected_height"),
    )
    return frames.where(same), rejected


def frames_stream(spark: SparkSession, folder: str, schema_of: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """Frames as they arrive in a folder of parquet files."""
    return (
        spark.readStream.schema(schema_of.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )
