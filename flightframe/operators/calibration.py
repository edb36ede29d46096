"""Robust similarity between camera steps and GPS steps.

The rotation has a closed form in the four sums of products, so a fit is three grouped passes
(step-ratio median, deviation median, sums over the kept samples). ``window_facts`` gives the same facts
for windows of the last ``max_samples`` samples: tasks go along the sorted samples, and what a row carries is
its own step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.numbers import count_if
from flightframe.plans.percentiles import grouped_percentiles
from flightframe.plans.settle import settle
from flightframe.policies import CalibrationPolicy

_AT_ONCE = 1024
_SIGMA = 1.4826  # fixed value: deviation median to standard deviation


def _finish(
    n: Column, kept: Column, median: Column, mad: Column, scale: Column, sums: dict[str, Column],
    policy: CalibrationPolicy, finite: Column,
) -> list[Column]:
    """Result columns from counts, medians and the sums over kept samples."""
    xx, xy, yx, yy = sums["xx"], sums["xy"], sums["yx"], sums["yy"]
    det = xx * yy - xy * yx
    reflected = det < 0
    turn = F.when(reflected, F.atan2(xy + yx, xx - yy)).otherwise(F.atan2(xy - yx, xx + yy))
    sign = F.when(reflected, -1.0).otherwise(1.0)
    m00, m10 = F.cos(turn), F.sin(turn)
    m01, m11 = -sign * m10, sign * m00
    # |scale * M * camera - gps|² summed, expanded into the sums at hand (M keeps lengths).
    cc, gg = sums["cc"], sums["gg"]
    cross = m00 * xx + m01 * yx + m10 * xy + m11 * yy
    squared = F.greatest(scale * scale * cc - 2 * scale * cross + gg, F.lit(0.0))
    rms = F.sqrt(F.try_divide(squared, kept))
    a, b, c = sums["uxx"], sums["uyy"], sums["uxy"]
    root = F.sqrt((a - b) * (a - b) + 4 * c * c)
    high, low = (a + b + root) / 2, F.greatest((a + b - root) / 2, F.lit(0.0))
    diversity = F.when(high > 1e-24, F.sqrt(low / high)).otherwise(F.lit(0.0))
    enough = (kept >= policy.min_samples) & (kept / n >= policy.min_inlier_ratio)
    reflection = reflected & F.lit(not policy.allow_reflection)
    reason = (
        F.when(n < policy.min_samples, "insufficient_samples")
        .when(~finite, "non_finite_samples")
        .when(~enough, "low_inlier_ratio")
        .when(reflection, "reflection_detected")
        .when(~scale.between(policy.scale_min, policy.scale_max), "scale_out_of_range")
        .when(diversity < policy.min_directional_diversity, "insufficient_directional_diversity")
        .when(rms > policy.max_rms_residual, "high_residual")
    )
    tried = (n >= policy.min_samples) & finite
    fitted = tried & enough & ~reflection
    when = lambda test, value: F.when(test, value)
    return [
        reason.isNull().alias("ready"),
        n.alias("sample_count"),
        F.when(tried, kept).otherwise(0).cast("long").alias("inlier_count"),
        when(fitted, m00).alias("m00"), when(fitted, m01).alias("m01"),
        when(fitted, m10).alias("m10"), when(fitted, m11).alias("m11"),
        when(fitted, scale).alias("scale"), when(fitted, rms).alias("rms_residual"),
        when(tried, median).alias("scale_median"), when(tried, mad).alias("scale_mad"),
        F.when(fitted, sums["span"]).otherwise(0.0).alias("motion_span"),
        F.when(fitted, diversity).otherwise(0.0).alias("directional_diversity"),
        reason.alias("failure_reason"),
    ]


def _tolerance(median: Column, mad: Column, policy: CalibrationPolicy) -> Column:
    return F.greatest(policy.outlier_mad_factor * _SIGMA * mad, F.abs(median) * 0.02, F.lit(1e-12))


def calibration_fit(
    samples: DataFrame,
    by: Sequence[str] = ("session",),
    policy: CalibrationPolicy = CalibrationPolicy(),
    rows: int | None = None,
) -> DataFrame:
    """One fit per group of samples with ``cam_x, cam_y, gps_x, gps_y``; groups of any size."""
    by = list(by)
    bad = F.lit(False)
    for name in ("cam_x", "cam_y", "gps_x", "gps_y"):
        bad = bad | F.col(name).isNull() | F.isnan(name) | (F.abs(name) == F.lit(float("inf")))
    camera, gps = F.hypot("cam_x", "cam_y"), F.hypot("gps_x", "gps_y")
    # Four passes read the samples, so they are written once.
    base = settle(
        samples.select(*by, "cam_x", "cam_y", "gps_x", "gps_y").withColumns(
            {"bad": bad, "camera": camera, "gps": gps, "ratio": F.try_divide(gps, camera)}
        )
    )
    medians = grouped_percentiles(base, by, {"ratios": F.col("ratio")}, [0.5], rows).withColumn(
        "median", F.get("ratios", F.lit(0))
    ).drop("ratios")
    centred = base.join(medians, by)
    deviations = grouped_percentiles(
        centred, by, {"devs": F.abs(F.col("ratio") - F.col("median"))}, [0.5], rows
    ).withColumn("mad", F.get("devs", F.lit(0))).drop("devs")
    limits = medians.join(deviations, by).withColumn("limit", _tolerance(F.col("median"), F.col("mad"), policy))
    marked = base.join(limits, by).withColumn(
        "kept", F.coalesce(F.abs(F.col("ratio") - F.col("median")) <= F.col("limit"), F.lit(False))
    )
    scales = grouped_percentiles(marked.where("kept"), by, {"s": F.col("ratio")}, [0.5], rows).withColumn(
        "scale", F.get("s", F.lit(0))
    ).drop("s")
    kept = lambda value: F.coalesce(F.sum(F.when(F.col("kept"), value)), F.lit(0.0))
    cx, cy, gx, gy, norm = (F.col(c) for c in ("cam_x", "cam_y", "gps_x", "gps_y", "camera"))
    totals = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("kept")).alias("kept_n"),
        F.bool_or("bad").alias("bad"),
        F.any_value("median").alias("median"),
        F.any_value("mad").alias("mad"),
        *[kept(value).alias(name) for name, value in _products(cx, cy, gx, gy, norm).items()],
    ).join(scales, by, "left")
    sums = {name: F.col(name) for name in _products(cx, cy, gx, gy, norm)}
    return totals.select(
        *by,
        *_finish(F.col("n"), F.col("kept_n"), F.col("median"), F.col("mad"), F.col("scale"), sums, policy, ~F.col("bad")),
    )


def _products(cx: Column, cy: Column, gx: Column, gy: Column, norm: Column) -> dict[str, Column]:
    return {
        "xx": cx * gx, "xy": cx * gy, "yx": cy * gx, "yy": cy * gy,
        "cc": cx * cx + cy * cy, "gg": gx * gx + gy * gy,
        "uxx": F.try_divide(cx * cx, norm * norm), "uyy": F.try_divide(cy * cy, norm * norm),
        "uxy": F.try_divide(cx * cy, norm * norm),
        "span": norm,
    }


def heading(camera: np.ndarray, gps: np.ndarray, policy: CalibrationPolicy) -> tuple[complex, bool] | None:
    """What turns camera steps into GPS steps, both as complex numbers: a factor and whether steps are mirrored
    first. None where ``calibration_fit`` is not ready. For live sessions, whose state one task holds."""
    ratio = np.abs(gps) / np.abs(camera)
    if len(ratio) < policy.min_samples or not np.isfinite(ratio).all():
        return None
    spread = np.abs(ratio - np.median(ratio))
    near = spread <= max(policy.outlier_mad_factor * _SIGMA * np.median(spread), np.median(ratio) * 0.02, 1e-12)
    if near.sum() < max(policy.min_samples, policy.min_inlier_ratio * len(near)):
        return None
    camera, gps, scale = camera[near], gps[near], np.median(ratio[near])
    turned, mirrored = np.vdot(camera, gps), np.dot(camera, gps)
    flip = bool(abs(mirrored) > abs(turned))
    factor = scale * np.exp(1j * np.angle(mirrored if flip else turned))
    off = np.abs(factor * (camera.conj() if flip else camera) - gps)
    # Doubled directions cancel out where steps go all ways, and add up where they lie on one line.
    line = abs(np.sum((camera / np.abs(camera)) ** 2)) / len(camera)
    ready = (
        (policy.allow_reflection or not flip) and policy.scale_min <= scale <= policy.scale_max
        and np.sqrt((1 - line) / (1 + line)) >= policy.min_directional_diversity and np.sqrt(np.mean(off**2)) <= policy.max_rms_residual
    )
    return (complex(factor), flip) if ready else None


_STEP = ("cam_x", "cam_y", "gps_x", "gps_y")
_SUMS = ("xx", "xy", "yx", "yy", "cc", "gg", "uxx", "uyy", "uxy", "span")
_FACTS = (("_n", "long"), ("_k", "long"), ("_median", "double"), ("_mad", "double"), ("_scale", "double"), *[(f"_{n}", "double") for n in _SUMS], ("_clean", "boolean"))


def _middles(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Medians along rows of the valid values, NaN without any."""
    ordered, m = np.sort(np.where(valid, values, np.inf), axis=1), valid.sum(1)
    at = lambda i: np.take_along_axis(ordered, np.maximum(i, 0)[:, None], 1)[:, 0]
    return np.where(m > 0, (at((m - 1) // 2) + at(m // 2)) / 2, np.nan)


def _facts_of(steps: np.ndarray, ends: np.ndarray, lengths: np.ndarray, policy: CalibrationPolicy) -> dict[str, np.ndarray]:
    """Facts of the windows of ``lengths[i]`` steps up to step ``ends[i]``."""
    width = policy.max_samples
    cx, cy, gx, gy = steps.T
    norm = np.hypot(cx, cy)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(norm == 0, np.nan, np.hypot(gx, gy) / norm)
        products = np.stack([cx * gx, cx * gy, cy * gx, cy * gy, cx * cx + cy * cy, gx * gx + gy * gy, *[p / (norm * norm) for p in (cx * cx, cy * cy, cx * cy)], norm])
    windows = lambda values, fill: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(width - 1, fill), values]), width)[ends]
    inside = np.arange(width)[None, :] >= width - lengths[:, None]
    own = windows(ratio, np.nan)
    valid = inside & ~np.isnan(own)
    median = _middles(own, valid)
    away = np.abs(own - median[:, None])
    mad = _middles(away, valid)
    kept = valid & (away <= np.maximum(np.maximum(policy.outlier_mad_factor * _SIGMA * mad, np.abs(median) * 0.02), 1e-12)[:, None])
    bad = ~np.isfinite(steps).all(1)
    out = {"_n": lengths, "_k": kept.sum(1), "_median": median, "_mad": mad, "_scale": _middles(own, kept)}
    out |= {f"_{name}": np.where(kept, windows(values, 0.0), 0.0).sum(1) for name, values in zip(_SUMS, products)}
    return out | {"_clean": ~(inside & windows(bad, False)).any(1)}


def window_facts(
    samples: DataFrame, keys: Sequence[str], policy: CalibrationPolicy, wanted: Column, kept: Sequence[str] = (), block: int | None = None,
) -> DataFrame:
    """For each wanted sample, the facts of a fit over the last ``max_samples`` samples up to it, with the ``kept`` columns.

    Samples are numbered 1, 2, ... within their keys. Numbers are cut into blocks that also get the
    ``max_samples - 1`` samples before them, so any group is shared out. A task goes along its blocks in order; a
    window is as long as its sample's number allows, and so never reaches into another group.
    """
    keys, kept, reach = list(keys), list(kept), policy.max_samples - 1
    block = block or max(reach + 1, 4096)
    own = F.floor((F.col("number") - 1) / block).cast("long")
    lead = F.floor((F.col("number") - 1 + reach) / block).cast("long")
    staged = samples.select(
        *keys, "number", *[F.col(c).cast("double").alias(c) for c in _STEP], *kept, wanted.alias("_want"), own.alias("_own"),
        F.explode(F.sequence(own, lead)).alias("_block"))
    sorted_rows = staged.withColumn("_want", F.col("_want") & (F.col("_own") == F.col("_block"))).repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "number")
    named = [*keys, "number", *kept]
    fields = {f.name: f for f in sorted_rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {fields[c].dataType.simpleString()}" for c in named], *[f"{c} {t}" for c, t in _FACTS]])

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = np.zeros((0, 4))
        for batch in batches:
            steps = np.concatenate([before, batch[list(_STEP)].to_numpy(float)])
            asked = np.flatnonzero(batch["_want"].to_numpy(bool))
            for low in range(0, len(asked), _AT_ONCE):
                rows = asked[low : low + _AT_ONCE]
                lengths = np.minimum(batch["number"].to_numpy()[rows], policy.max_samples).astype(np.int64)
                facts = _facts_of(steps, rows + len(before), lengths, policy)
                yield pd.concat([batch[named].iloc[rows].reset_index(drop=True), pd.DataFrame(facts)], axis=1)
            before = steps[max(0, len(steps) - reach) :]

    return sorted_rows.mapInPandas(along, schema)


def _fitted(facts: DataFrame, kept: Sequence[str], policy: CalibrationPolicy) -> DataFrame:
    nan_null = lambda c: F.when(~F.isnan(c), F.col(c))
    return facts.select(*kept, *_finish(
        F.col("_n"), F.col("_k"), nan_null("_median"), nan_null("_mad"), nan_null("_scale"), {n: F.col(f"_{n}") for n in _SUMS}, policy, F.col("_clean")))


def numbered_samples_fit(
    samples: DataFrame,
    ends: DataFrame,
    keys: Sequence[str],
    policy: CalibrationPolicy = CalibrationPolicy(),
) -> DataFrame:
    """Fits over the last ``max_samples`` samples at chosen sample numbers.

    ``samples`` has ``number`` (1, 2, ... within keys) and the four step columns; ``ends`` has the keys and
    ``end_number``. Each asked number is fitted once, however often it is asked for.
    """
    keys = list(keys)
    asked = ends.select(*keys, F.col("end_number").alias("number")).distinct().withColumn("_asked", F.lit(True))
    marked = samples.select(*keys, "number", *_STEP).join(asked, [*keys, "number"], "left")
    facts = window_facts(marked, keys, policy, F.coalesce("_asked", F.lit(False)))
    return _fitted(facts.withColumnRenamed("number", "end_number"), [*keys, "end_number"], policy)


def rolling_calibration(
    samples: DataFrame,
    keys: Sequence[str],
    policy: CalibrationPolicy = CalibrationPolicy(),
    block: int | None = None,
) -> DataFrame:
    """The fit after every sample, on the last ``max_samples``."""
    named = [*keys, "number"]
    kept = [c for c in samples.columns if c not in (*_STEP, *named)]
    return _fitted(window_facts(samples, keys, policy, F.lit(True), kept, block), [c for c in samples.columns if c not in _STEP], policy)
