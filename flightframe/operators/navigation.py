"""Where the aircraft is: GPS phases, calibration samples, and dead reckoning through GPS loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.functions.numbers import count_if
from flightframe.operators.calibration import numbered_samples_fit
from flightframe.operators.sequences import continuity_on, trajectory_on
from flightframe.plans.scans import CHUNK, Axis, axis_of, scan
from flightframe.plans.settle import settle
from flightframe.policies import LIMITS, CalibrationPolicy, CameraModel, NavigationPolicy

HEALTHY, UNHEALTHY = 1, 0


def _finite(*names: str) -> Column:
    good = F.lit(True)
    for name in names:
        good = good & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != F.lit(float("inf")))
    return F.coalesce(good, F.lit(False))


def navigation_states(
    frames: DataFrame,
    policy: NavigationPolicy = NavigationPolicy(),
    camera: CameraModel | None = None,
    keys: Sequence[str] = ("session",),
    order: str = "seq",
) -> tuple[DataFrame, Axis]:
    """Committed frames with pose, last GPS fix, health of the frame before, and loss anchors.

    Health before a frame follows the whole session (also frames of another modality); pose, fix
    and anchors follow the segment, so a reset wipes them.
    """
    cut, axis = axis_of(frames, keys, order)
    decided = continuity_on(cut, axis, policy.max_frame_gap, camera).where(F.col("action") != "duplicate")
    decided = scan(decided, axis, before={"_h": F.struct("health")}).withColumn(
        "previous_health", F.col("_h.health")
    ).drop("_h")
    # Frames that wipe the state leave only their health and the end of an era behind.
    decided = scan(decided, axis, sums={"_era": F.when(F.col("action") == "wipe", 1).otherwise(0)})
    posed = trajectory_on(decided.where(F.col("action") != "wipe"), axis, policy)
    inner = axis.within("segment")
    healthy = F.col("health") == HEALTHY
    fix_ok = healthy & _finite("gps_x", "gps_y", "gps_z")
    posed = posed.withColumn("fix_ok", F.coalesce(fix_ok, F.lit(False)))
    fix = F.struct(
        F.col("fix_ok").alias("ok"), F.col("gps_x").alias("x"), F.col("gps_y").alias("y"),
        F.col("gps_z").alias("z"), F.when(F.col("fix_ok"), F.col("frame_index")).alias("index"),
    )
    posed = scan(posed, inner, upto={"fix": F.when(healthy, fix)})
    state = F.struct("_era", "fix", "pose_x", "pose_y", "segment")
    posed = scan(posed, axis, before={"_b": state})
    same_era = F.col("_b._era") == F.col("_era")
    posed = posed.withColumn("before", F.when(same_era, F.col("_b"))).drop("_b", "_era")
    step = F.col("frame_index") - F.col("before.fix.index")
    adjacent = F.col("before.fix.ok") & (step > 0) & (step <= policy.max_frame_gap)
    lost = (F.col("health") == UNHEALTHY) & (F.col("previous_health") == HEALTHY)
    recovered = F.col("fix_ok") & (F.col("previous_health") == UNHEALTHY)
    posed = posed.withColumns(
        {
            "adjacent_fix": F.coalesce(adjacent, F.lit(False)),
            "lost": F.coalesce(lost, F.lit(False)),
            "recovered": F.coalesce(recovered, F.lit(False)),
        }
    )
    return posed, axis


def gps_phase(
    frames: DataFrame,
    policy: NavigationPolicy = NavigationPolicy(),
    camera: CameraModel | None = None,
    keys: Sequence[str] = ("session",),
    order: str = "seq",
) -> DataFrame:
    """Per committed frame: transition, length of the unhealthy run, healthy frames since
    recovery, and the anchor a loss or a recovery sets."""
    states, axis = navigation_states(frames, policy, camera, keys, order)
    inner = axis.within("segment")
    # A healthy fix ends an unhealthy run; a recovery starts the healthy count, a loss ends it.
    states = scan(
        states, inner,
        sums={
            "_fixes": F.when(F.col("fix_ok"), 1).otherwise(0),
            "_bad": F.when(F.col("health") == UNHEALTHY, 1).otherwise(0),
        },
    )
    mark = F.when(F.col("recovered"), F.struct(F.lit(True).alias("on"), F.col("_fixes").alias("at")))
    mark = mark.when(F.col("health") == UNHEALTHY, F.struct(F.lit(False).alias("on"), F.col("_fixes").alias("at")))
    states = scan(
        states, inner,
        upto={
            "_mark": mark,
            "_bad_at_fix": F.when(F.col("fix_ok"), F.col("_bad")),
            "transition": F.when(F.col("lost"), "lost").when(F.col("recovered"), "recovered"),
        },
    )
    count = F.when(F.col("_mark.on"), F.col("_fixes") - F.col("_mark.at") + 1).otherwise(0)
    sets = (F.col("lost") & F.col("adjacent_fix")) | F.col("recovered")
    anchor = lambda own, earlier: F.when(F.col("recovered"), own).when(sets, earlier)
    return states.withColumns(
        {
            "unhealthy_run": F.col("_bad") - F.coalesce(F.col("_bad_at_fix"), F.lit(0)),
            "recovery_count": F.coalesce(count, F.lit(0)),
            "sets_anchor": sets,
            "anchor_gps_x": anchor(F.col("gps_x"), F.col("before.fix.x")),
            "anchor_gps_y": anchor(F.col("gps_y"), F.col("before.fix.y")),
            "anchor_gps_z": anchor(F.col("gps_z"), F.col("before.fix.z")),
            "anchor_cam_x": anchor(F.col("pose_x"), F.col("before.pose_x")),
            "anchor_cam_y": anchor(F.col("pose_y"), F.col("before.pose_y")),
        }
    ).drop("_fixes", "_bad", "_mark", "_bad_at_fix", CHUNK)


def _sampled(states: DataFrame, policy: NavigationPolicy, calibration: CalibrationPolicy) -> DataFrame:
    """Add the camera and GPS step of healthy neighbours and why a step is no sample."""
    cam_x = F.col("pose_x") - F.col("before.pose_x")
    cam_y = F.col("pose_y") - F.col("before.pose_y")
    gps_x = F.col("gps_x") - F.col("before.fix.x")
    gps_y = F.col("gps_y") - F.col("before.fix.y")
    pair = (
        F.col("fix_ok") & (F.col("action") == "continue")
        & F.col("previous_health").eqNullSafe(HEALTHY) & F.col("adjacent_fix")
    )
    motion = F.col("action").isin("continue", "repeated_image")
    quality = F.coalesce(F.col("valid") & (F.col("action") == "continue"), F.lit(False))
    reason = (
        F.when(~F.col("health").eqNullSafe(HEALTHY), None)
        .when(~F.col("fix_ok"), "invalid_ground_truth")
        .when(~pair & motion & quality, "unmatched_gps_step")
        .when(~pair & motion, "motion_quality_invalid")
        .when(~pair, None)
        .when(~_finite("inlier_ratio"), "non_finite_sample")
        .when(~quality, "motion_quality_invalid")
        .when(F.hypot(cam_x, cam_y) < calibration.min_camera_step_px, "camera_step_too_small")
        .when(F.hypot(gps_x, gps_y) < calibration.min_gps_step, "gps_step_too_small")
    )
    sample = F.coalesce(pair, F.lit(False))
    return (
        states.withColumn("reject_reason", reason)
        .withColumn("is_sample", sample & F.col("reject_reason").isNull())
        .withColumns(
            {
                "cam_x": F.when(sample, cam_x), "cam_y": F.when(sample, cam_y),
                "step_x": F.when(sample, gps_x), "step_y": F.when(sample, gps_y),
            }
        )
    )


def calibration_samples(
    frames: DataFrame,
    policy: NavigationPolicy = NavigationPolicy(),
    calibration: CalibrationPolicy = CalibrationPolicy(),
    camera: CameraModel | None = None,
    keys: Sequence[str] = ("session",),
    order: str = "seq",
) -> DataFrame:
    """Healthy frames with their step pair as a sample, numbered within the segment, or the
    reason why there is none."""
    states, axis = navigation_states(frames, policy, camera, keys, order)
    sampled = _sampled(states, policy, calibration)
    sampled = scan(sampled, axis.within("segment"), sums={"number": F.when(F.col("is_sample"), 1).otherwise(0)})
    return sampled.where(F.col("is_sample") | F.col("reject_reason").isNotNull()).drop(CHUNK)


def sample_table(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accepted samples in the columns the calibration fits read."""
    return samples.where("is_sample").select(
        *keys, "segment", "number", "cam_x", "cam_y",
        F.col("step_x").alias("gps_x"), F.col("step_y").alias("gps_y"),
    )


def estimate_translation(
    frames: DataFrame,
    policy: NavigationPolicy = NavigationPolicy(),
    calibration: CalibrationPolicy = CalibrationPolicy(),
    camera: CameraModel | None = None,
    keys: Sequence[str] = ("session",),
    order: str = "seq",
    fold_rows: int | None = None,
) -> DataFrame:
    """Position of every committed frame: the fix while GPS is healthy, else the anchor moved by
    the calibrated camera displacement, each step held to ``max_delta_per_frame``."""
    keys = list(keys)
    states, axis = navigation_states(frames, policy, camera, keys, order)
    inner = axis.within("segment")
    sampled = scan(
        _sampled(states, policy, calibration), inner,
        sums={"number": F.when(F.col("is_sample"), 1).otherwise(0), "_fixes": F.when(F.col("fix_ok"), 1).otherwise(0)},
    )
    sampled = scan(sampled, axis, before={"_at": F.struct("number", F.col("segment").alias("segment"))})
    # Calibration is kept as (segment, sample number): a loss next to a fix freezes the one
    # reached before it, enough healthy frames after a recovery set it free again.
    mark = F.when(F.col("recovered"), F.struct(F.lit(True).alias("on"), F.col("_fixes").alias("at")))
    mark = mark.when(F.col("health") == UNHEALTHY, F.struct(F.lit(False).alias("on"), F.col("_fixes").alias("at")))
    freezes = F.col("lost") & F.col("adjacent_fix")
    sampled = scan(sampled, inner, upto={"_mark": mark})
    healthy_since = F.when(F.col("_mark.on"), F.col("_fixes") - F.col("_mark.at") + 1).otherwise(0)
    frees = F.col("fix_ok") & (healthy_since >= policy.recovery_min_healthy_frames)
    hold = F.when(
        freezes,
        F.struct(F.lit(True).alias("frozen"), F.col("_at.segment").alias("segment"), F.col("_at.number").alias("number")),
    ).when(
        frees,
        F.struct(F.lit(False).alias("frozen"), F.col("segment").alias("segment"), F.lit(0).cast("long").alias("number")),
    )
    own_anchor = F.struct(
        F.col("gps_x").alias("x"), F.col("gps_y").alias("y"), F.col("gps_z").alias("z"),
        F.col("pose_x").alias("cx"), F.col("pose_y").alias("cy"),
    )
    lost_anchor = F.struct(
        F.col("before.fix.x").alias("x"), F.col("before.fix.y").alias("y"), F.col("before.fix.z").alias("z"),
        F.col("before.pose_x").alias("cx"), F.col("before.pose_y").alias("cy"),
    )
    anchor = F.when(freezes, lost_anchor).when(F.col("recovered"), own_anchor)
    sampled = scan(sampled, inner, upto={"hold": hold, "anchor": anchor})
    frozen = F.coalesce(F.col("hold.frozen"), F.lit(False))
    sampled = sampled.withColumns(
        {
            "fit_segment": F.when(frozen, F.col("hold.segment")).otherwise(F.col("segment")),
            "fit_number": F.when(frozen, F.col("hold.number")).otherwise(F.col("number")),
        }
    )
    sampled = settle(
        sampled.select(
            *keys, order, "segment", "frame_index", "action", "health", "fix_ok", "valid", "gps_x", "gps_y", "gps_z",
            "pose_x", "pose_y", "anchor", "lost", "recovered", "is_sample", "number", "cam_x", "cam_y", "step_x", "step_y",
            "fit_segment", "fit_number", "_fixes", *([CHUNK] if axis.chunked else []),
        )
    )
    asks = (F.col("health") == UNHEALTHY) & (F.col("action") == "continue") & F.col("valid")
    ends = sampled.where(asks & (F.col("fit_number") > 0)).select(
        *keys, F.col("fit_segment").alias("segment"), F.col("fit_number").alias("end_number")
    )
    fits = numbered_samples_fit(sample_table(sampled, keys), ends, [*keys, "segment"], calibration)
    fits = fits.where("ready").select(
        *keys, F.col("segment").alias("fit_segment"), F.col("end_number").alias("fit_number"),
        "m00", "m01", "m10", "m11", "scale",
    )
    joined = sampled.join(fits, [*keys, "fit_segment", "fit_number"], "left")
    move_x = F.col("pose_x") - F.col("anchor.cx")
    move_y = F.col("pose_y") - F.col("anchor.cy")
    raw_x = F.col("anchor.x") + F.col("scale") * (F.col("m00") * move_x + F.col("m01") * move_y)
    raw_y = F.col("anchor.y") + F.col("scale") * (F.col("m10") * move_x + F.col("m11") * move_y)
    allowed = asks & F.col("scale").isNotNull() & F.lit(policy.z_policy != "return_none_if_schema_allows")
    raw = joined.withColumns(
        {
            "raw_x": F.when(allowed, raw_x), "raw_y": F.when(allowed, raw_y),
            "raw_z": F.when(allowed, F.col("anchor.z")),
        }
    )
    held = _held_steps(settle(raw), [*keys, "segment"], order, policy.max_delta_per_frame, fold_rows or LIMITS.fold_rows)
    out = lambda fix, estimate: F.when(F.col("fix_ok"), F.col(fix)).otherwise(F.col(estimate))
    status = (
        F.when(F.col("fix_ok"), "gps_ground_truth")
        .when(F.col("est_x").isNotNull(), "gps_loss_prediction")
        .when(F.col("health") == UNHEALTHY, "gps_loss_unavailable")
        .otherwise("ground_truth_unavailable")
    )
    clamped = F.hypot(F.col("est_x") - F.col("raw_x"), F.col("est_y") - F.col("raw_y")) > 1e-9
    return held.select(
        *keys, order, "segment", "frame_index", "action", "health", "lost", "recovered",
        (F.col("action") == "continue").alias("continuous"),
        F.coalesce(F.col("valid") & (F.col("action") == "continue"), F.lit(False)).alias("vo_valid"),
        "pose_x", "pose_y", F.col("anchor.cx").alias("anchor_cam_x"), F.col("anchor.cy").alias("anchor_cam_y"),
        F.col("number").alias("sample_count"), F.col("fit_number"), F.col("scale").isNotNull().alias("fit_ready"),
        out("gps_x", "est_x").alias("x"), out("gps_y", "est_y").alias("y"), out("gps_z", "raw_z").alias("z"),
        "raw_x", "raw_y", F.coalesce(clamped, F.lit(False)).alias("clamped"), status.alias("status"),
    )


def _held_steps(rows: DataFrame, keys: list[str], order: str, limit: float, fold_rows: int) -> DataFrame:
    """Hold each estimate within ``limit`` of the position before it.

    Each held value depends on the held value before it, so a run of estimates between two fixes
    is folded in order. Runs longer than ``fold_rows`` are folded piece after piece, all runs in
    parallel, and each piece starts from where the last one ended.
    """
    run = [*keys, "_fixes"]
    wants = rows.where(F.col("raw_x").isNotNull()).select(*run, order, "raw_x", "raw_y")
    starts = rows.where("fix_ok").select(*run, F.col("gps_x").alias("start_x"), F.col("gps_y").alias("start_y"))
    if limit <= 0:
        return rows.withColumn("est_x", F.col("raw_x")).withColumn("est_y", F.col("raw_y"))
    cut, axis = axis_of(wants, run, order)
    numbered = scan(cut, axis, sums={"_nth": F.lit(1)}).withColumn(
        "_piece", F.floor((F.col("_nth") - 1) / fold_rows).cast("int")
    )
    last_piece = 0
    if axis.chunked or not numbered.where(F.col("_piece") > 0).isEmpty():
        numbered = settle(numbered)
        last_piece = numbered.agg(F.max("_piece")).first()[0]
    carried, done = starts, None
    for piece in range(last_piece + 1):
        lists = (
            numbered.where(F.col("_piece") == piece)
            .groupBy(*run)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "raw_x", "raw_y"))).alias("steps"))
            .join(carried, run, "left")
        )
        folded = lists.select(*run, F.aggregate("steps", _start(), lambda acc, s: _hold(acc, s, limit)).alias("f"))
        if piece < last_piece:
            folded = settle(folded)
            carried = folded.select(*run, F.col("f.x").alias("start_x"), F.col("f.y").alias("start_y")).unionByName(
                carried.join(folded.select(*run), run, "left_anti")
            )
            carried = settle(carried)
        out = folded.select(*run, F.inline("f.out"))
        done = out if done is None else done.unionByName(out)
    estimates = done.select(*run, F.col("o").alias(order), "est_x", "est_y")
    return rows.join(estimates, [*run, order], "left")


def _start() -> Column:
    nothing = F.array().cast("array<struct<o:bigint,est_x:double,est_y:double>>")
    return F.struct(F.col("start_x").alias("x"), F.col("start_y").alias("y"), nothing.alias("out"))


def _hold(acc: Column, s: Column, limit: float) -> Column:
    dx, dy = s["raw_x"] - acc["x"], s["raw_y"] - acc["y"]
    far = F.hypot(dx, dy)
    shrink = F.when(acc["x"].isNotNull() & (far > limit), F.lit(float(limit)) / far)
    x = F.when(shrink.isNotNull(), acc["x"] + dx * shrink).otherwise(s["raw_x"])
    y = F.when(shrink.isNotNull(), acc["y"] + dy * shrink).otherwise(s["raw_y"])
    row = F.struct(s["o"].cast("long").alias("o"), x.alias("est_x"), y.alias("est_y"))
    return F.struct(x.alias("x"), y.alias("y"), F.concat(acc["out"], F.array(row)).alias("out"))


def gps_loss_report(
    estimates: DataFrame, truth: DataFrame, keys: Sequence[str] = ("session",), order: str = "seq",
    rows: int | None = None,
) -> DataFrame:
    """Per session: errors of the loss estimates against the true positions, counts, and whether
    the answer passes (finite, not stale, height held, first step kept, fix returned at recovery)."""
    from flightframe.plans.percentiles import grouped_percentiles

    keys = list(keys)
    joined = estimates.join(truth.select(*keys, order, "true_x", "true_y", "true_z"), [*keys, order])
    lossy = F.col("health") == UNHEALTHY
    predicted = lossy & F.col("x").isNotNull()
    error = F.when(predicted, F.hypot(F.col("x") - F.col("true_x"), F.col("y") - F.col("true_y")))
    joined = joined.withColumn("position_error", error)
    tails = grouped_percentiles(joined, keys, {"p": F.col("position_error")}, [0.95], rows)
    finite = F.col("x").isNull() | _finite("x", "y", "z")
    stale = lossy & ~F.col("vo_valid") & F.col("x").isNotNull()
    moved = F.hypot(F.col("pose_x") - F.col("anchor_cam_x"), F.col("pose_y") - F.col("anchor_cam_y")) > 1e-8
    first_kept = F.col("lost") & F.col("vo_valid") & F.col("x").isNotNull() & F.coalesce(moved, F.lit(False))
    z_held = ~predicted | F.col("z").isNotNull()
    truth_back = ~F.col("recovered") | (
        (F.col("x") == F.col("true_x")) & (F.col("y") == F.col("true_y")) & (F.col("z") == F.col("true_z"))
    )
    folded = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_count"),
        count_if(F.col("health") == HEALTHY).alias("healthy_frames"),
        count_if(lossy).alias("loss_frames"),
        count_if(F.col("recovered")).alias("recoveries"),
        count_if(F.col("vo_valid")).alias("vo_valid_count"),
        count_if(predicted).alias("valid_prediction_count"),
        count_if(lossy & F.col("x").isNull()).alias("none_count"),
        F.avg("position_error").alias("mean_position_error"),
        F.max("position_error").alias("max_position_error"),
        F.max("sample_count").alias("calibration_samples"),
        F.min(F.when(F.col("fit_ready"), F.col(order))).alias("first_ready_at"),
        count_if(F.col("lost") & F.col("fit_ready")).alias("losses_ready"),
        count_if(first_kept).alias("losses_first_step_kept"),
        count_if(F.col("clamped")).alias("clamped_count"),
        F.bool_and(z_held).alias("z_policy_correct"),
        F.bool_or(stale).alias("stale_prediction"),
        F.bool_and(finite).alias("finite_outputs"),
        F.bool_and(F.coalesce(truth_back, F.lit(False))).alias("recovery_truth"),
    )
    ok = (
        (F.col("losses_first_step_kept") > 0) & F.col("z_policy_correct") & ~F.col("stale_prediction")
        & F.col("finite_outputs") & F.col("recovery_truth")
    )
    return (
        folded.join(tails, keys, "left")
        .withColumn("p95_position_error", F.get("p", F.lit(0)))
        .withColumn("result", F.when(ok, "PASS").otherwise("FAIL"))
        .drop("p")
    )
