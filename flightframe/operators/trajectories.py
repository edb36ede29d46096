"""Summaries of camera-motion runs: outlier jumps, per-run metrics, choice of a setting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightframe.functions.numbers import count_if, divide
from flightframe.plans.percentiles import grouped_percentiles
from flightframe.plans.settle import settle

# Failure reasons that have their own column.
NAMED_REASONS = ("initialization_or_reset", "low_quality", "insufficient_features")
JUMPS = {"translation_jump": "translation_px", "yaw_jump": "abs_yaw"}


def mad_jumps(steps: DataFrame, by: Sequence[str], values: dict[str, str] | None = None, rows: int | None = None) -> DataFrame:
    """Flag valid rows above median + 3 * median absolute deviation of their group."""
    by, values = list(by), values or JUMPS
    steps = settle(steps)
    valid = steps.where("valid")
    medians = grouped_percentiles(valid, by, {f"_m_{v}": F.col(v) for v in values.values()}, [0.5], rows)
    centred = valid.join(medians, by)
    spread = lambda v: F.abs(F.col(v) - F.get(f"_m_{v}", F.lit(0)))
    deviations = grouped_percentiles(centred, by, {f"_d_{v}": spread(v) for v in values.values()}, [0.5], rows)
    limits = settle(medians.join(deviations, by))
    flagged = steps.join(limits, by, "left")
    above = lambda v: F.col(v) > F.get(f"_m_{v}", F.lit(0)) + 3.0 * F.get(f"_d_{v}", F.lit(0))
    flags = {name: F.coalesce(F.col("valid") & above(v), F.lit(False)) for name, v in values.items()}
    return flagged.withColumns(flags).select(*steps.columns, *flags)


def trajectory_summary(steps: DataFrame, by: Sequence[str], order: str = "seq", rows: int | None = None) -> DataFrame:
    """Metrics per run. Needs ``frame_id, previous_id, valid, reason, translation_px, abs_yaw``,
    the jump flags and the pose columns of each step."""
    by = list(by)
    steps = settle(steps)
    ok = F.col("valid")
    tails = grouped_percentiles(
        steps.where(ok), by, {"_t": F.col("translation_px"), "_y": F.col("abs_yaw")}, [0.5, 0.90, 0.95], rows
    )
    label = F.concat(F.coalesce("previous_id", F.lit("initialization")), F.lit("->"), F.col("frame_id"))
    largest = lambda v: F.max_by(label, F.when(ok, F.struct(F.coalesce(F.col(v), F.lit(0.0)), -F.col(order))))
    reason = lambda name: count_if(~ok & (F.col("reason") == name))
    final = lambda c: F.max_by(c, order)
    stats = []
    for prefix, v in (("translation_px", "translation_px"), ("abs_yaw_rad", "abs_yaw")):
        value = F.when(ok, F.col(v))
        stats += [F.min(value).alias(f"min_{prefix}"), F.max(value).alias(f"max_{prefix}"), F.avg(value).alias(f"mean_{prefix}")]
    base = steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_frames"),
        reason("initialization_or_reset").alias("initialization_reset_count"),
        count_if(ok).alias("valid_count"), count_if(~ok).alias("invalid_count"),
        reason("low_quality").alias("low_quality_count"),
        reason("insufficient_features").alias("insufficient_features_count"),
        *stats,
        largest("translation_px").alias("largest_translation_jump_frame_pair"),
        largest("abs_yaw").alias("largest_yaw_jump_frame_pair"),
        count_if(ok & F.col("translation_jump")).alias("translation_jump_count"),
        count_if(ok & F.col("yaw_jump")).alias("yaw_jump_count"),
        F.coalesce(F.sum(F.when(ok, F.col("translation_px"))), F.lit(0.0)).alias("trajectory_length_px"),
        F.hypot(F.coalesce(final("pose_x"), F.lit(0.0)), F.coalesce(final("pose_y"), F.lit(0.0))).alias("net_displacement_px"),
        F.coalesce(final("pose_yaw"), F.lit(0.0)).alias("cumulative_yaw_rad"),
    )
    others = (
        steps.where(~ok & ~F.col("reason").isin(*NAMED_REASONS)).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("_o"))
    )
    text = F.to_json(F.map_from_entries("_o"))
    names = [("median", 0), ("p90", 1), ("p95", 2)]
    tail = [F.get(c, F.lit(i)).alias(f"{n}_{p}") for c, p in (("_t", "translation_px"), ("_y", "abs_yaw_rad")) for n, i in names]
    return (
        base.join(tails, by, "left").join(others, by, "left")
        .select(
            *base.columns, divide(F.col("valid_count"), F.col("total_frames")).alias("valid_ratio"), *tail,
            F.coalesce(text, F.lit("{}")).alias("other_failure_reasons"),
        )
    )


def assess_candidates(summaries: DataFrame, key: str) -> DataFrame:
    """Top three by valid ratio, fewest jumps at two ratios, and the best stability score."""
    jumps = F.col("translation_jump_count") + F.col("yaw_jump_count")
    penalty = 0.5 * jumps / F.greatest(F.lit(1), F.col("valid_count"))
    rows = summaries.withColumn("jumps", jumps).withColumn("stability_coverage_score", F.col("valid_ratio") - penalty)
    def pick(name: str, test, *order, k: int = 1) -> DataFrame:
        first = rows.where(test).orderBy(*order, F.asc(key)).limit(k)
        position = Window.partitionBy(F.lit(0)).orderBy(*order, F.asc(key))  # at most k rows
        return first.select(F.lit(name).alias("choice"), F.row_number().over(position).alias("rank"), key, "valid_ratio", "jumps", "stability_coverage_score")

    ratio = F.desc("valid_ratio")
    return (
        pick("highest_valid_ratio", F.lit(True), ratio, F.asc("jumps"), k=3)
        .unionByName(pick("lowest_jump_valid_ratio_ge_050", F.col("valid_ratio") >= 0.50, F.asc("jumps"), ratio))
        .unionByName(pick("lowest_jump_valid_ratio_ge_070", F.col("valid_ratio") >= 0.70, F.asc("jumps"), ratio))
        .unionByName(pick("stability_coverage_compromise", F.lit(True), F.desc("stability_coverage_score"), ratio))
    )
