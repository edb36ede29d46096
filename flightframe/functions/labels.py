"""Names and codes: classes, motion labels, landing states, file names, modalities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, aliases and wire codes that results are compared by.
MOVING, STATIONARY, UNKNOWN, IGNORE = "moving", "stationary", "unknown", "ignore"
VEHICLE, PERSON, PAD_A, PAD_B = "tasit", "insan", "uap", "uai"
CLASS_BY_MODEL_ID = {0: VEHICLE, 1: PERSON, 2: PAD_A, 3: PAD_B}
CLASS_CODES = {VEHICLE: 0, PERSON: 1, PAD_A: 2, PAD_B: 3}
SUITABLE, UNSUITABLE, NOT_APPLICABLE = "suitable", "unsuitable", "not_applicable"
LANDING_CODES = {SUITABLE: "1", UNSUITABLE: "0", NOT_APPLICABLE: "-1"}
MOTION_CODES = {MOVING: "1", STATIONARY: "0", UNKNOWN: "-1"}
MOTION_ALIASES = {
    "moving": MOVING,
    "hareketli": MOVING,
    "motion": MOVING,
    "stationary": STATIONARY,
    "hareketsiz": STATIONARY,
    "sabit": STATIONARY,
    "durgun": STATIONARY,
    "ignore": IGNORE,
    "ignored": IGNORE,
    "yoksay": IGNORE,
}
METHODS = (
    "global_median",
    "homography",
    "homography_bbox",
    "homography_hybrid",
    "homography_local",
    "homography_adaptive",
)
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
THERMAL_MAX_DIFFERENCE, RGB_MIN_DIFFERENCE = 6.0, 12.0


def lookup(key: Column, table: dict) -> Column:
    """Value of a small literal table, null for other keys."""
    first, *rest = table.items()
    chain = F.when(key == F.lit(first[0]), F.lit(first[1]))
    for name, value in rest:
        chain = chain.when(key == F.lit(name), F.lit(value))
    return chain


def detection_class(model_id: Column) -> Column:
    """Class of an integral, mapped model id (a double), else null."""
    return lookup(model_id, {float(number): name for number, name in CLASS_BY_MODEL_ID.items()})


def class_code(name: Column) -> Column:
    return lookup(name, CLASS_CODES)


def landing_code(name: Column) -> Column:
    return lookup(name, LANDING_CODES)


def motion_code(name: Column) -> Column:
    return lookup(name, MOTION_CODES)


def normalize_motion_label(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "_", " "), r"\s+", " "))
    compact = F.replace(spaced, F.lit(" "), F.lit(""))
    return F.coalesce(lookup(spaced, MOTION_ALIASES), lookup(compact, MOTION_ALIASES))


def classification_group(truth: Column, prediction: Column) -> Column:
    hit = lambda gt, pred: (truth == gt) & (prediction == pred)
    return (
        F.when(prediction == UNKNOWN, "unknown")
        .when(hit(STATIONARY, MOVING), "false_moving")
        .when(hit(STATIONARY, STATIONARY), "true_stationary")
        .when(hit(MOVING, MOVING), "true_moving")
        .when(hit(MOVING, STATIONARY), "false_stationary")
    )


def crop_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("tight"), "tight")
        .when(low.contains("medium"), "medium")
        .when(low.contains("wide"), "wide")
        .otherwise("unspecified")
    )


def modality(channel_difference: Column, dimensions: Column, channels: Column) -> Column:
    return (
        F.when(dimensions == 2, "thermal")
        .when((dimensions != 3) | (channels < 3), "unknown")
        .when(channel_difference <= THERMAL_MAX_DIFFERENCE, "thermal")
        .when(channel_difference >= RGB_MIN_DIFFERENCE, "rgb")
        .otherwise("unknown")
    )


def pipeline_kind(reference: Column, frame: Column) -> Column:
    known = (reference != "unknown") & (frame != "unknown")
    return F.when(known & (reference != frame), "cross_modal").otherwise("same_modal")


def frame_index_of(text: Column) -> Column:
    """Index from digits, from the last ``frame/N`` label in a URL path, or from the only
    number in the base name; null otherwise."""
    value = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    # url_decode reads '+' as a space; a path keeps it.
    path = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    labelled = F.regexp_extract_all(
        path, F.lit(r"(?i)(?:^|[/_.-])frames?(?:[/_.-]+)(\d+)(?=$|[/_.-])"), F.lit(1)
    )
    base = F.substring_index(F.regexp_replace(path, r"/+$", ""), "/", -1)
    numbers = F.regexp_extract_all(base, F.lit(r"(\d+)"), F.lit(1))
    return (
        F.when(value.rlike(r"^\d+$"), value.try_cast("long"))
        .when(F.size(labelled) > 0, F.get(labelled, F.size(labelled) - 1).try_cast("long"))
        .when(F.size(numbers) == 1, F.get(numbers, F.lit(0)).try_cast("long"))
    )


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers: the length of a run stands before its digits."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda run: F.regexp_replace(run, r"^0+(?=\d)", "")
    sized = F.transform(
        runs,
        lambda run: F.when(
            run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(run)).cast("string"), 10, "0"), digits(run))
        ).otherwise(run),
    )
    return F.concat_ws("", sized)


def canonical_name(name: Column) -> Column:
    """Trimmed, Unicode-composed names; Spark has no built-in for the composition."""

    @F.pandas_udf("string")
    def composed(names: pd.Series) -> pd.Series:
        return names.str.strip().str.normalize("NFC")

    return composed(name)
