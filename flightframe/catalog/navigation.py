"""GPS phases, calibration and position through GPS loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightframe.catalog import query
from flightframe.catalog.sequences import TRAJECTORY
from flightframe.catalog.shared import ctes, rounded, view
from flightframe.operators import calibration as C
from flightframe.operators import motion_fit as M
from flightframe.operators import navigation as N
from flightframe.policies import CalibrationPolicy, CameraModel, MotionFitPolicy

POLICY = CalibrationPolicy(min_samples=6, min_camera_step_px=0.5)

# Health of the frame before (over all frames that leave a trace) and the fix it left behind.
_STATE = f"""{TRAJECTORY}, env as (select session, seq, health, era from b where not repeat), ph as (select session, seq, lag(health) over (partition by session order by seq) as previous_health from env),
f0 as (select q.*, ph.previous_health, (coalesce(health = 1, false) and gps_x is not null and gps_y is not null and gps_z is not null) as fix_ok from q join ph on q.session = ph.session and q.seq = ph.seq),
f1 as (select *, max(case when health = 1 then seq end) over (partition by session, segment order by seq) as fix_seq from f0),
f2 as (select *, lag(fix_seq) over w as b_fix_seq, lag(pose_x) over w as b_x, lag(pose_y) over w as b_y, lag(seq) over w as b_seq from f1 window w as (partition by session, era order by seq)),
f3 as (select f2.*, g.fix_ok as b_ok, case when g.fix_ok then g.frame_index end as b_index, g.gps_x as bgx, g.gps_y as bgy, g.gps_z as bgz from f2 left join f1 g on f2.session = g.session and f2.b_fix_seq = g.seq),
st as (select *, coalesce(b_ok and frame_index - b_index > 0 and frame_index - b_index <= 1, false) as adjacent, coalesce(health = 0 and previous_health = 1, false) as lost, coalesce(fix_ok and previous_health = 0, false) as recovered from f3)"""


@query(
    "gps_phase",
    f"""{_STATE}, gx as (select *, sum(case when fix_ok then 1 else 0 end) over w as fixes, sum(case when health = 0 then 1 else 0 end) over w as bad, max(case when recovered then seq end) over w as rseq, max(case when health = 0 then seq end) over w as useq,
  max(case when fix_ok then seq end) over w as okseq, max(case when lost then seq end) over w as lseq from st window w as (partition by session, segment order by seq)),
gy as (select gx.*, rf.fixes as r_fixes, ok.bad as bad_at from gx left join gx rf on gx.session = rf.session and gx.rseq = rf.seq left join gx ok on gx.session = ok.session and gx.okseq = ok.seq)
select session, seq, case when lseq is null and rseq is null then null when coalesce(lseq, -1) > coalesce(rseq, -1) then 'lost' else 'recovered' end as transition, cast(bad - coalesce(bad_at, 0) as bigint) as unhealthy_run,
  cast(case when rseq is not null and rseq > coalesce(useq, -1) then fixes - r_fixes + 1 else 0 end as bigint) as recovery_count, (lost and adjacent) or recovered as sets_anchor,
  round(case when recovered then gps_x when lost and adjacent then bgx end, 6) as anchor_gps_x, round(case when recovered then gps_y when lost and adjacent then bgy end, 6) as anchor_gps_y,
  round(case when recovered then pose_x when lost and adjacent then b_x end, 6) as anchor_cam_x, round(case when recovered then pose_y when lost and adjacent then b_y end, 6) as anchor_cam_y from gy""",
)
def gps_phase(spark, sf_dir):
    return rounded(
        N.gps_phase(view(spark, sf_dir, "v_frames")).select(
            "session", "seq", "transition", "unhealthy_run", "recovery_count", "sets_anchor", "anchor_gps_x", "anchor_gps_y", "anchor_cam_x", "anchor_cam_y"
        )
    )


_SAMPLED = f"""{_STATE}, pr as (select *, coalesce(fix_ok and action = 'continue' and previous_health = 1 and adjacent, false) as pair, coalesce(valid and action = 'continue', false) as quality, action in ('continue', 'repeated_image') as motion from st),
rs as (select *, case when health is null or health <> 1 then null when not fix_ok then 'invalid_ground_truth' when not pair and motion and quality then 'unmatched_gps_step' when not pair and motion then 'motion_quality_invalid' when not pair then null
  when not quality then 'motion_quality_invalid' when sqrt(power(pose_x - b_x, 2) + power(pose_y - b_y, 2)) < 0.5 then 'camera_step_too_small' when sqrt(power(gps_x - bgx, 2) + power(gps_y - bgy, 2)) < 0.02 then 'gps_step_too_small' end as reject_reason from pr),
sm as (select *, pair and reject_reason is null as is_sample from rs), nm as (select *, cast(sum(case when is_sample then 1 else 0 end) over (partition by session, segment order by seq) as bigint) as number from sm)"""


@query(
    "calibration_samples",
    f"""{_SAMPLED} select session, seq, segment, is_sample, reject_reason, number, round(case when pair then pose_x - b_x end, 6) as cam_x, round(case when pair then pose_y - b_y end, 6) as cam_y,
  round(case when pair then gps_x - bgx end, 6) as step_x, round(case when pair then gps_y - bgy end, 6) as step_y from nm where is_sample or reject_reason is not null""",
)
def calibration_samples(spark, sf_dir):
    found = N.calibration_samples(view(spark, sf_dir, "v_frames"), calibration=POLICY)
    return rounded(found.select("session", "seq", "segment", "is_sample", "reject_reason", "number", "cam_x", "cam_y", "step_x", "step_y"))


def _samples(spark, sf_dir):
    return N.sample_table(N.calibration_samples(view(spark, sf_dir, "v_frames"), calibration=POLICY), ["session"])


@query(
    "calibration_fit",
    f"""{_SAMPLED}, sa as (select session, pose_x - b_x as cx, pose_y - b_y as cy, gps_x - bgx as gx, gps_y - bgy as gy from nm where is_sample), ra as (select *, sqrt(gx * gx + gy * gy) / sqrt(cx * cx + cy * cy) as ratio from sa),
md as (select session, median(ratio) as m from ra group by session), dv as (select ra.session, median(abs(ratio - m)) as d from ra join md on ra.session = md.session group by ra.session),
ka as (select ra.*, m, d, abs(ratio - m) <= greatest(3.5 * 1.4826 * d, abs(m) * 0.02, 1e-12) as kept from ra join md on ra.session = md.session join dv on ra.session = dv.session),
ta as (select session, count(*) as n, count(*) filter (where kept) as kn, any_value(m) as m, any_value(d) as d, median(ratio) filter (where kept) as scale, sum(cx * gx) filter (where kept) as xx, sum(cx * gy) filter (where kept) as xy, sum(cy * gx) filter (where kept) as yx, sum(cy * gy) filter (where kept) as yy,
  sum(sqrt(cx * cx + cy * cy)) filter (where kept) as span from ka group by session)
select session, n as sample_count, case when n >= 6 then kn else 0 end as inlier_count, case when n >= 6 then round(m, 6) end as scale_median, case when n >= 6 and kn >= 6 and kn >= 0.7 * n and xx * yy - xy * yx >= 0 then round(scale, 6) end as scale,
  case when n >= 6 and kn >= 6 and kn >= 0.7 * n and xx * yy - xy * yx >= 0 then round(cos(atan2(xy - yx, xx + yy)), 6) end as m00, case when n < 6 then 'insufficient_samples' when kn < 6 or kn < 0.7 * n then 'low_inlier_ratio' when xx * yy - xy * yx < 0 then 'reflection_detected' end as early_reason from ta""",
)
def calibration_fit(spark, sf_dir):
    fit = C.calibration_fit(_samples(spark, sf_dir), ["session"], POLICY)
    early = F.when(F.col("failure_reason").isin("insufficient_samples", "low_inlier_ratio", "reflection_detected"), F.col("failure_reason"))
    return rounded(fit.select("session", "sample_count", "inlier_count", "scale_median", "scale", "m00", early.alias("early_reason")))


# The fit over a list ``s`` of samples, in the steps of the operator: medians, kept samples, sums, rules.
_FIT = """g1 as (select *, list_transform(s, lambda x: x.ratio) as rs from li), g2 as (select *, list_aggregate(rs, 'median') as md from g1),
g3 as (select *, list_aggregate(list_transform(rs, lambda x: abs(x - md)), 'median') as mad from g2),
g4 as (select *, list_filter(s, lambda x: abs(x.ratio - md) <= greatest(3.5 * 1.4826 * mad, abs(md) * 0.02, 1e-12)) as k from g3),
g5 as (select *, len(s) as n, len(k) as kn, list_aggregate(list_transform(k, lambda x: x.ratio), 'median') as scale, {sums} from g4),
g6 as (select *, xx * yy - xy * yx < 0 as mirrored, case when xx * yy - xy * yx < 0 then atan2(xy + yx, xx - yy) else atan2(xy - yx, xx + yy) end as turn, sqrt((uxx - uyy) * (uxx - uyy) + 4 * uxy * uxy) as root from g5),
g7 as (select *, cos(turn) as m00, sin(turn) as m10, case when mirrored then sin(turn) else -sin(turn) end as m01, case when mirrored then -cos(turn) else cos(turn) end as m11, (uxx + uyy + root) / 2 as high, greatest((uxx + uyy - root) / 2, 0) as low from g6),
g8 as (select *, case when high > 1e-24 then sqrt(low / high) else 0 end as diversity, sqrt(greatest(scale * scale * cc - 2 * scale * (m00 * xx + m01 * yx + m10 * xy + m11 * yy) + gg, 0) / nullif(kn, 0)) as rms from g7),
g9 as (select *, case when n < 6 then 'insufficient_samples' when not (kn >= 6 and kn * 1e0 / n >= 0.7e0) then 'low_inlier_ratio' when mirrored then 'reflection_detected' when not scale between 1e-6 and 10 then 'scale_out_of_range'
  when diversity < 0.1 then 'insufficient_directional_diversity' when rms > 0.5 then 'high_residual' end as failure_reason, n >= 6 and kn >= 6 and kn * 1e0 / n >= 0.7e0 and not mirrored as fitted from g8)""".replace("{sums}", ", ".join(
    f"coalesce(list_sum(list_transform(k, lambda x: {e})), 0) as {c}" for c, e in (
        ("xx", "x.cx * x.gx"), ("xy", "x.cx * x.gy"), ("yx", "x.cy * x.gx"), ("yy", "x.cy * x.gy"), ("cc", "x.cx * x.cx + x.cy * x.cy"), ("gg", "x.gx * x.gx + x.gy * x.gy"),
        ("uxx", "x.cx * x.cx / (x.norm * x.norm)"), ("uyy", "x.cy * x.cy / (x.norm * x.norm)"), ("uxy", "x.cx * x.cy / (x.norm * x.norm)"), ("span", "x.norm"))))
_ROLLED = f"""{_SAMPLED}, sa as (select session, segment, number, struct_pack(cx := pose_x - b_x, cy := pose_y - b_y, gx := gps_x - bgx, gy := gps_y - bgy, norm := sqrt(power(pose_x - b_x, 2) + power(pose_y - b_y, 2)),
  ratio := sqrt(power(gps_x - bgx, 2) + power(gps_y - bgy, 2)) / sqrt(power(pose_x - b_x, 2) + power(pose_y - b_y, 2))) as x from nm where is_sample),
li as (select session, segment, number, list(x) over (partition by session, segment order by number rows between 449 preceding and current row) as s from sa), {_FIT}"""


@query(
    "rolling_calibration",
    f"""{_ROLLED} select session, segment, number, failure_reason is null as ready, n as sample_count, case when n >= 6 then kn else 0 end as inlier_count, {', '.join(f'round(case when fitted then {c} end, 6) as {c}' for c in ('m00', 'm01', 'm10', 'm11', 'scale'))},
  round(case when fitted then rms end, 6) as rms_residual, round(case when n >= 6 then md end, 6) as scale_median, round(case when n >= 6 then mad end, 6) as scale_mad, round(case when fitted then span else 0 end, 6) as motion_span,
  round(case when fitted then diversity else 0 end, 6) as directional_diversity, failure_reason from g9""",
)
def rolling_calibration(spark, sf_dir):
    return rounded(C.rolling_calibration(_samples(spark, sf_dir), ["session", "segment"], POLICY))


# Calibration in force, anchor and estimate of every frame; estimates between two fixes are held to 5 a step, one after the other.
_LOCATED = f"""{_ROLLED.replace('with ', 'with recursive ', 1)}, n1 as (select *, cast(sum(case when fix_ok then 1 else 0 end) over w as bigint) as fixes, max(case when recovered then seq end) over w as rseq, max(case when health = 0 then seq end) over w as useq,
  lag(number) over o as at_number, lag(segment) over o as at_segment from nm window w as (partition by session, segment order by seq), o as (partition by session order by seq)),
n2 as (select a.*, case when a.rseq is not null and a.rseq > coalesce(a.useq, -1) then a.fixes - r.fixes + 1 else 0 end as healthy from n1 a left join n1 r on r.session = a.session and r.seq = a.rseq),
n3 as (select *, lost and adjacent as freezes, fix_ok and healthy >= 1 as frees from n2),
n4 as (select *, max(case when freezes or frees then seq end) over w as hseq, max(case when freezes or recovered then seq end) over w as aseq from n3 window w as (partition by session, segment order by seq)),
n5 as (select a.*, case when h.freezes then h.at_segment else a.segment end as fit_segment, case when h.freezes then h.at_number else a.number end as fit_number,
  case when c.freezes then c.bgx else c.gps_x end as ax, case when c.freezes then c.bgy else c.gps_y end as ay, case when c.freezes then c.bgz else c.gps_z end as az, case when c.freezes then c.b_x else c.pose_x end as acx, case when c.freezes then c.b_y else c.pose_y end as acy,
  coalesce(a.health = 0 and a.action = 'continue' and a.valid, false) as asks from n4 a left join n4 h on h.session = a.session and h.seq = a.hseq left join n4 c on c.session = a.session and c.seq = a.aseq),
fits as (select f.session, f.segment, f.number, f.m00, f.m01, f.m10, f.m11, f.scale from g9 f semi join (select session, fit_segment, fit_number from n5 where asks) e on e.session = f.session and e.fit_segment = f.segment and e.fit_number = f.number where failure_reason is null),
n6 as (select a.*, f.scale, case when asks then ax + f.scale * (f.m00 * (pose_x - acx) + f.m01 * (pose_y - acy)) end as raw_x, case when asks then ay + f.scale * (f.m10 * (pose_x - acx) + f.m11 * (pose_y - acy)) end as raw_y
  from n5 a left join fits f on f.session = a.session and f.segment = a.fit_segment and f.number = a.fit_number),
wants as materialized (select w.session, w.segment, w.fixes, w.seq, w.raw_x, w.raw_y, s.gps_x as sx, s.gps_y as sy, row_number() over (partition by w.session, w.segment, w.fixes order by w.seq) as n
  from n6 w left join (select session, segment, fixes, gps_x, gps_y from n6 where fix_ok) s on s.session = w.session and s.segment = w.segment and s.fixes = w.fixes where raw_x is not null),
held as (select session, segment, fixes, seq, n, case when sqrt(power(raw_x - sx, 2) + power(raw_y - sy, 2)) > 5 then sx + (raw_x - sx) * (5 / sqrt(power(raw_x - sx, 2) + power(raw_y - sy, 2))) else raw_x end as est_x,
    case when sqrt(power(raw_x - sx, 2) + power(raw_y - sy, 2)) > 5 then sy + (raw_y - sy) * (5 / sqrt(power(raw_x - sx, 2) + power(raw_y - sy, 2))) else raw_y end as est_y from wants where n = 1
  union all select session, segment, fixes, seq, n, case when far > 5 then est_x + (raw_x - est_x) * (5 / far) else raw_x end, case when far > 5 then est_y + (raw_y - est_y) * (5 / far) else raw_y end
  from (select w.*, h.est_x, h.est_y, sqrt(power(w.raw_x - h.est_x, 2) + power(w.raw_y - h.est_y, 2)) as far from held h join wants w on w.session = h.session and w.segment = h.segment and w.fixes = h.fixes and w.n = h.n + 1) t),
located as (select a.session, a.seq, a.segment, a.frame_index, a.action, a.health, a.lost, a.recovered, a.action = 'continue' as continuous, coalesce(a.valid and a.action = 'continue', false) as vo_valid, a.pose_x, a.pose_y,
  a.acx as anchor_cam_x, a.acy as anchor_cam_y, a.number as sample_count, a.fit_number, a.scale is not null as fit_ready, case when a.fix_ok then a.gps_x else e.est_x end as x, case when a.fix_ok then a.gps_y else e.est_y end as y,
  case when a.fix_ok then a.gps_z when a.raw_x is not null then a.az end as z, a.raw_x, a.raw_y, coalesce(sqrt(power(e.est_x - a.raw_x, 2) + power(e.est_y - a.raw_y, 2)) > 1e-9, false) as clamped,
  case when a.fix_ok then 'gps_ground_truth' when e.est_x is not null then 'gps_loss_prediction' when a.health = 0 then 'gps_loss_unavailable' else 'ground_truth_unavailable' end as status
  from n6 a left join held e on e.session = a.session and e.segment = a.segment and e.seq = a.seq)"""
_REPORTED = f"""{_LOCATED}, tr as (select session, seq, coalesce(gps_x, 0) as true_x, gps_y as true_y, gps_z as true_z from v_frames),
er as (select *, health = 0 as lossy, health = 0 and x is not null as predicted, case when health = 0 and x is not null then sqrt(power(x - true_x, 2) + power(y - true_y, 2)) end as error from located join tr using (session, seq)),
sm_ as (select session, count(*) as frame_count, count(*) filter (where health = 1) as healthy_frames, count(*) filter (where lossy) as loss_frames, count(*) filter (where recovered) as recoveries, count(*) filter (where vo_valid) as vo_valid_count,
  count(*) filter (where predicted) as valid_prediction_count, count(*) filter (where lossy and x is null) as none_count, round(avg(error), 6) as mean_position_error, round(max(error), 6) as max_position_error, max(sample_count) as calibration_samples,
  min(seq) filter (where fit_ready) as first_ready_at, count(*) filter (where lost and fit_ready) as losses_ready, count(*) filter (where lost and vo_valid and x is not null and coalesce(sqrt(power(pose_x - anchor_cam_x, 2) + power(pose_y - anchor_cam_y, 2)) > 1e-8, false)) as losses_first_step_kept,
  count(*) filter (where clamped) as clamped_count, bool_and(not predicted or z is not null) as z_policy_correct, bool_or(lossy and not vo_valid and x is not null) as stale_prediction,
  bool_and(x is null or (isfinite(x) and y is not null and isfinite(y) and z is not null and isfinite(z))) as finite_outputs, bool_and(coalesce(not recovered or (x = true_x and y = true_y and z = true_z), false)) as recovery_truth, round(quantile_cont(error, 0.95), 6) as p95_position_error from er group by session)
select *, case when losses_first_step_kept > 0 and z_policy_correct and not stale_prediction and finite_outputs and recovery_truth then 'PASS' else 'FAIL' end as result from sm_"""
_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in ("pose_x", "pose_y", "anchor_cam_x", "anchor_cam_y", "x", "y", "z", "raw_x", "raw_y"))


# All frames of the live form: those that leave no trace in the pose are skipped.
LIVE = f"""{_LOCATED}, heard as (select session, seq, event, action, segment from s union all select session, seq, case when usable then 'duplicate_frame' else 'unsupported_modality' end, case when usable then 'duplicate' else 'wipe' end,
  (select coalesce(max(s.segment), 0) from s where s.session = b.session and s.seq < b.seq) from b where repeat or not usable)"""
LIVE_COLUMNS = "h.seq, h.action, h.event, h.segment, round(l.pose_x, 6) as pose_x, round(l.pose_y, 6) as pose_y, round(l.x, 6) as x, round(l.y, 6) as y, round(l.z, 6) as z, coalesce(l.status, 'skipped') as status"


@query("translation_estimated", f"{_LOCATED} select * replace ({_ROUNDED}) from located")
def translation_estimated(spark, sf_dir):
    return rounded(N.estimate_translation(view(spark, sf_dir, "v_frames"), calibration=POLICY))


@query("gps_loss_report", _REPORTED)
def gps_loss_report(spark, sf_dir):
    frames = view(spark, sf_dir, "v_frames")
    truth = frames.select("session", "seq", F.coalesce("gps_x", F.lit(0.0)).alias("true_x"), F.col("gps_y").alias("true_y"), F.col("gps_z").alias("true_z"))
    return rounded(N.gps_loss_report(N.estimate_translation(frames, calibration=POLICY), truth))


def tracks(spark, sf_dir):
    """Tracks that follow one planar motion per pair, with outliers and bad returns."""
    t = view(spark, sf_dir, "v_tracks")
    turn, right, down = (F.col("pair") % 5 - 2) / 1e3, (F.col("pair") % 7 - 3).cast("double"), (F.col("pair") % 3 - 1).cast("double")
    off = F.when(F.col("outlier"), 25.0).otherwise(0.0)
    u, v = F.col("px") - 250.0, F.col("py") - 200.0
    moved_x, moved_y = F.col("px") - right + turn * v + off, F.col("py") - down - turn * u
    return t.select(
        "pair", "track_id", F.col("px").alias("x0"), F.col("py").alias("y0"), moved_x.alias("x1"), moved_y.alias("y1"),
        (F.col("px") + F.col("fb") - 0.6).alias("xb"), F.col("py").alias("yb"), "ok", F.lit(500).alias("width"), F.lit(420).alias("height"), "outlier",
    )


CAMERA = CameraModel(width=500, height=420, cx=250.0, cy=200.0)
_TRACKS = """{v}, r as (select *, (pair % 5 - 2) / 1e3 as turn, pair % 7 - 3e0 as rx, pair % 3 - 1e0 as ry from v_tracks),
p as (select pair, track_id, ok, outlier, px as x0, py as y0, px - rx + turn * (py - 200) + case when outlier then 25 else 0 end as x1, py - ry - turn * (px - 250) as y1, px + fb - 0.6 as xb, py as yb from r),
g as (select * from p where ok and x0 >= 0 and x0 < 500 and y0 >= 0 and y0 < 420 and x1 >= 0 and x1 < 500 and y1 >= 0 and y1 < 420 and xb >= 0 and xb < 500 and yb >= 0 and yb < 420 and abs(xb - x0) <= 0.7)"""


@query("tracks_usable", _TRACKS.replace("{v}", ctes("v_tracks")) + " select pair, track_id, outlier from g")
def tracks_usable(spark, sf_dir):
    return M.usable_tracks(tracks(spark, sf_dir), MotionFitPolicy(fb_error_px=0.7)).select("pair", "track_id", "outlier")


@query(
    "motion_refitted",
    _TRACKS.replace("{v}", ctes("v_tracks")) + """, k as (select pair, x0 - 250 as u, y0 - 200 as v, x1 - x0 as dx, y1 - y0 as dy from g where not outlier),
s as (select pair, count(*) as n, sum(u) as su, sum(v) as sv, sum(dx) as sdx, sum(dy) as sdy, sum(u * u + v * v) as r, sum(v * dx - u * dy) as m from k group by pair), y as (select *, (m - (sv * sdx - su * sdy) / n) / (r - (su * su + sv * sv) / n) as yaw from s where r - (su * su + sv * sv) / n > 1)
select pair, round(yaw, 6) as yaw, round((yaw * sv - sdx) / n, 5) as tx, round((-yaw * su - sdy) / n, 5) as ty from y""",
)
def motion_refitted(spark, sf_dir):
    good = M.usable_tracks(tracks(spark, sf_dir), MotionFitPolicy(fb_error_px=0.7)).where("not outlier")
    fit = M.refit(good, ["pair"], F.lit(True), CAMERA).where(F.col("yaw").isNotNull())
    return fit.select("pair", F.round("yaw", 6).alias("yaw"), F.round("tx", 5).alias("tx"), F.round("ty", 5).alias("ty"))


_LEAST = lambda p: f"""sum(1) as {p}n, sum(x0 - 250) as {p}u, sum(y0 - 200) as {p}v, sum(x1 - x0) as {p}dx, sum(y1 - y0) as {p}dy, sum((x0 - 250) * (x0 - 250) + (y0 - 200) * (y0 - 200)) as {p}r, sum((y0 - 200) * (x1 - x0) - (x0 - 250) * (y1 - y0)) as {p}m"""
_SOLVED = "select *, (yaw * sv - sdx) / sn as tx, (-yaw * su - sdy) / sn as ty from (select *, (sm - (sv * sdx - su * sdy) / sn) / case when sr - (su * su + sv * sv) / sn > 1e-9 then sr - (su * su + sv * sv) / sn end as yaw from {t}) z"
_OFF = "sqrt(power(-{m}.tx + {m}.yaw * (g.y0 - 200) - (g.x1 - g.x0), 2) + power(-{m}.ty - {m}.yaw * (g.x0 - 250) - (g.y1 - g.y0), 2))"
_HEX = lambda text, place: f"cast('0x' || substr(md5({text}), {place}, 13) as bigint)"
_PLANAR = _TRACKS.replace("{v}", ctes("v_tracks")) + f""", sz as (select pair, count(*) as tracked from g group by pair),
en as (select g.*, unnest(range(1, cast(greatest(1, ceil(2400e0 / tracked)) as bigint) + 1)) as i from g join sz using (pair) where tracked >= 12),
eh as (select *, {_HEX("track_id || ':' || i", 1)} % 200 as h from en),
eo as (select pair, h, track_id, struct_pack(o := {_HEX("track_id || '@' || h", 1)}, t := track_id, x0 := x0, y0 := y0, x1 := x1, y1 := y1) as pt, struct_pack(p := {_HEX("track_id || '@' || h", 14)}, t := track_id) as po from eh),
th as (select pair, h, min(pt) as a, max(pt) as c, arg_min(pt, po) as b from eo group by pair, h),
pk as (select pair, h, unnest([a, b, c], recursive := false) as pt from th where a <> b and b <> c and a <> c), px as (select pair, h, pt.x0 as x0, pt.y0 as y0, pt.x1 as x1, pt.y1 as y1 from pk),
ms as (select pair, h, {_LEAST('s')} from px group by pair, h), mo as (select * from ({_SOLVED.format(t='ms')}) y where yaw is not null),
vt as (select mo.pair, mo.h, any_value(mo.tx) as tx, any_value(mo.ty) as ty, any_value(mo.yaw) as yaw, count(*) as votes from mo join g on g.pair = mo.pair where {_OFF.format(m='mo')} <= 2 group by mo.pair, mo.h),
be as (select * from (select *, row_number() over (partition by pair order by votes desc, h) as place from vt) z where place = 1 and votes >= 3),
su_ as (select g.pair, {_LEAST('s')} from g join be using (pair) where {_OFF.format(m='be')} <= 2 group by g.pair), rf as ({_SOLVED.format(t='su_')}),
ju as (select g.pair, any_value(rf.tx) as tx, any_value(rf.ty) as ty, any_value(rf.yaw) as yaw, count(*) filter (where {_OFF.format(m='rf')} <= 2) as inliers, sqrt(avg(power({_OFF.format(m='rf')}, 2)) filter (where {_OFF.format(m='rf')} <= 2)) as rms from g join rf on rf.pair = g.pair group by g.pair),
al as (select pair, coalesce(tracked, 0) as tracked, tx, ty, yaw, inliers, rms, coalesce(inliers * 1e0 / tracked, 0) as inlier_ratio from (select distinct pair from p) e left join sz using (pair) left join ju using (pair)),
re as (select *, case when tracked < 12 then 'insufficient_features' when yaw is null then 'ransac_failed' when not coalesce(inliers >= 8 and inlier_ratio >= 0.5 and rms <= 2, false) then 'low_quality' end as reason from al)
select pair, tracked, coalesce(inliers, 0) as inliers, round(inlier_ratio, 4) as inlier_ratio, round(rms, 4) as rms, reason is null as valid, reason, round(case when reason is null then tx end, 4) as dx, round(case when reason is null then ty end, 4) as dy, round(case when reason is null then yaw end, 4) as yaw from re"""


@query("planar_motion_fit", _PLANAR)
def planar_motion_fit(spark, sf_dir):
    return rounded(M.planar_motion_fit(tracks(spark, sf_dir), camera=CAMERA, policy=MotionFitPolicy(fb_error_px=0.7)), 4)
