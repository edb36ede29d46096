"""Pairs, continuity, warm-up and camera trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightframe.catalog import query
from flightframe.catalog.shared import ctes, rounded, view
from flightframe.operators import sequences as S
from flightframe.operators import trajectories as T

_NUM = ctes("v_numbers") + ", p as (select *, lag(number) over w as pn, lag(name) over w as pname from v_numbers window w as (partition by sequence order by number, seq))"


@query("consecutive_pairs", f"{_NUM} select sequence, pname as previous_name, name from p where number = pn + 1")
def consecutive_pairs(spark, sf_dir):
    return S.consecutive_pairs(view(spark, sf_dir, "v_numbers")).select("sequence", F.col("previous.name").alias("previous_name"), "name")


@query("pairing_diagnostics", f"{_NUM} select sequence, count(*) as frames, count(*) filter (where number = pn + 1) as valid_pairs, min(number) as first_number, max(number) as last_number from p group by sequence")
def pairing_diagnostics(spark, sf_dir):
    return S.pairing_diagnostics(view(spark, sf_dir, "v_numbers"))


@query("skipped_pairs", f"{_NUM} select sequence, pname as previous_name, name, number - pn as frame_gap from p where number - pn <> 1")
def skipped_pairs(spark, sf_dir):
    return S.skipped_pairs(view(spark, sf_dir, "v_numbers")).select("sequence", F.col("previous.name").alias("previous_name"), "name", "frame_gap")


_FR = ctes("v_frames")
_REPEATS = f"{_FR}, d as (select * from (select *, lag(frame_id) over (partition by session order by seq) as pid from v_frames) x where pid is null or pid <> frame_id)"


@query("repeats_dropped", f"{_REPEATS} select session, seq, frame_id from d")
def repeats_dropped(spark, sf_dir):
    return S.drop_repeats(view(spark, sf_dir, "v_frames")).select("session", "seq", "frame_id")


_CONT = f"""{_FR}, a as (select *, modality = 'rgb' as usable, sum(case when modality <> 'rgb' then 1 else 0 end) over (partition by session order by seq) as era from v_frames),
b as (select *, coalesce(usable and frame_id = lag(frame_id) over (partition by session, era, usable order by seq), false) as repeat from a),
c as (select *, lag(seq) over w as p_seq, lag(video) over w as p_video, lag(width) over w as p_width, lag(height) over w as p_height, lag(modality) over w as p_mod, lag(frame_index) over w as p_index, lag(fingerprint) over w as p_print
  from b where usable and not repeat window w as (partition by session, era order by seq)),
e as (select *, case when p_seq is null then 'first_frame' when video <> p_video then 'video_changed' when width <> p_width or height <> p_height then 'shape_changed' when modality <> p_mod then 'modality_changed'
  when frame_index is null or p_index is null then 'frame_index_missing' when frame_index - p_index <= 0 then 'out_of_order' when frame_index - p_index > 1 then 'frame_gap' when fingerprint = p_print then 'freeze_detected' else 'continue' end as event from c),
s as (select *, case event when 'first_frame' then 'first' when 'freeze_detected' then 'repeated_image' when 'continue' then 'continue' else 'reset' end as action,
  cast(sum(case when event in ('freeze_detected', 'continue') then 0 else 1 end) over (partition by session order by seq) as bigint) as segment from e)"""


@query(
    "continuity",
    f"""{_CONT} select session, seq, event, action, segment from s union all
select session, seq, case when usable then 'duplicate_frame' else 'unsupported_modality' end, case when usable then 'duplicate' else 'wipe' end,
  (select coalesce(max(s.segment), 0) from s where s.session = b.session and s.seq < b.seq) from b where repeat or not usable""",
)
def continuity(spark, sf_dir):
    return S.continuity(view(spark, sf_dir, "v_frames")).select("session", "seq", "event", "action", "segment")


_BASE = f"""{_REPEATS}, c as (select *, lag(seq) over w as p_seq, lag(video) over w as pv, lag(width) over w as pw, lag(frame_index) over w as pi from d window w as (partition by session order by seq)),
e as (select *, case when p_seq is null then 'first_frame' when video <> pv then 'video_changed' when width <> pw then 'shape_changed' when frame_index is null or pi is null then 'frame_index_missing'
  when frame_index - pi <= 0 then 'out_of_order' when frame_index - pi > 1 then 'frame_gap' else 'comparable' end as baseline from c),
r as (select *, sum(case when baseline in ('comparable', 'first_frame') then 0 else 1 end) over (partition by session order by seq) as run from e),
w as (select *, row_number() over (partition by session, run order by seq) as warmup from r)"""


@query("motion_baseline", f"{_BASE} select session, seq, baseline, baseline = 'comparable' as comparable, warmup, (baseline = 'comparable' and k % 10 <> 4 and warmup > 1) as confident from w")
def motion_baseline(spark, sf_dir):
    frames = view(spark, sf_dir, "v_frames").withColumn("frozen", F.col("k") % 10 == 4)
    return S.motion_baseline(frames).select("session", "seq", "baseline", "comparable", "warmup", "confident")


TRAJECTORY = f"""{_CONT}, m as (select *, sum(case when action in ('continue', 'repeated_image') then 1 else 0 end) over (partition by session, segment order by seq) as steps from s),
u as (select *, (action = 'continue' and valid and steps >= 1) as used from m),
y as (select *, sum(case when used then yaw else 0 end) over (partition by session, segment order by seq) as pose_yaw from u),
q as (select *, sum(case when used then cos(-pose_yaw) * dx - sin(-pose_yaw) * dy else 0 end) over (partition by session, segment order by seq) as pose_x,
  sum(case when used then sin(-pose_yaw) * dx + cos(-pose_yaw) * dy else 0 end) over (partition by session, segment order by seq) as pose_y from y)"""


@query("trajectory", f"{TRAJECTORY} select session, seq, segment, used as motion_used, round(pose_yaw, 6) as pose_yaw, round(pose_x, 6) as pose_x, round(pose_y, 6) as pose_y from q")
def trajectory(spark, sf_dir):
    posed = S.integrate_trajectory(view(spark, sf_dir, "v_frames"))
    return rounded(posed.select("session", "seq", "segment", "motion_used", "pose_yaw", "pose_x", "pose_y"))


def vo_steps(spark, sf_dir):
    """Committed frames as camera-motion steps of five runs."""
    posed = S.integrate_trajectory(view(spark, sf_dir, "v_frames"))
    ok = (F.col("action") == "continue") & F.col("valid")
    reason = F.when(F.col("action").isin("first", "reset"), "initialization_or_reset").when(F.col("action") == "repeated_image", "freeze").otherwise(F.col("reason"))
    return posed.select(
        (F.col("session") % 5).alias("run"), "seq", F.col("seq").cast("string").alias("frame_id"), F.lit(None).cast("string").alias("previous_id"),
        ok.alias("valid"), F.when(~ok, reason).alias("reason"), F.when(ok, F.hypot("dx", "dy")).alias("translation_px"), F.when(ok, F.abs("yaw")).alias("abs_yaw"),
        "pose_x", "pose_y", "pose_yaw",
    )


_STEPS = f"""{TRAJECTORY}, st as (select session % 5 as run, seq, cast(seq as varchar) as frame_id, (action = 'continue' and valid) as ok, case when action in ('first', 'reset') then 'initialization_or_reset' when action = 'repeated_image' then 'freeze' else reason end as why,
  sqrt(dx * dx + dy * dy) as t, abs(yaw) as a, pose_x, pose_y, pose_yaw from q),
md as (select run, median(t) as mt, median(a) as ma from st where ok group by run), dv as (select st.run, median(abs(t - mt)) as dt, median(abs(a - ma)) as da from st join md on st.run = md.run where ok group by st.run),
j as (select st.*, coalesce(ok and t > mt + 3 * dt, false) as tj, coalesce(ok and a > ma + 3 * da, false) as yj from st left join md on st.run = md.run left join dv on st.run = dv.run)"""


@query("mad_jumps", f"{_STEPS} select run, seq, tj as translation_jump, yj as yaw_jump from j")
def mad_jumps(spark, sf_dir):
    return T.mad_jumps(vo_steps(spark, sf_dir), ["run"]).select("run", "seq", "translation_jump", "yaw_jump")


_SUMMARY_COLUMNS = (
    "run", "total_frames", "initialization_reset_count", "valid_count", "invalid_count", "low_quality_count", "insufficient_features_count", "min_translation_px", "max_translation_px",
    "mean_translation_px", "median_translation_px", "p90_translation_px", "p95_translation_px", "mean_abs_yaw_rad", "p95_abs_yaw_rad", "largest_translation_jump_frame_pair",
    "translation_jump_count", "yaw_jump_count", "trajectory_length_px", "net_displacement_px", "cumulative_yaw_rad", "valid_ratio", "other_failure_reasons",
)
_TSUM = f"""{_STEPS}, fin as (select run, arg_max(pose_x, seq) as fx, arg_max(pose_y, seq) as fy, arg_max(pose_yaw, seq) as fyaw from j group by run),
big as (select run, frame_id from (select run, frame_id, row_number() over (partition by run order by t desc, seq) as n from j where ok) z where n = 1),
oth as (select run, why, count(*) as n from j where not ok and why not in ('initialization_or_reset', 'low_quality', 'insufficient_features') group by run, why),
ot as (select run, '{{' || string_agg('"' || why || '":' || n, ',' order by why) || '}}' as txt from oth group by run),
bb as (select run, count(*) as total_frames, count(*) filter (where not ok and why = 'initialization_or_reset') as initialization_reset_count, count(*) filter (where ok) as valid_count, count(*) filter (where not ok) as invalid_count,
  count(*) filter (where not ok and why = 'low_quality') as low_quality_count, count(*) filter (where not ok and why = 'insufficient_features') as insufficient_features_count,
  min(t) filter (where ok) as mn, max(t) filter (where ok) as mx, avg(t) filter (where ok) as av, quantile_cont(t, 0.5) filter (where ok) as md, quantile_cont(t, 0.9) filter (where ok) as q9, quantile_cont(t, 0.95) filter (where ok) as q95,
  avg(a) filter (where ok) as ay, quantile_cont(a, 0.95) filter (where ok) as qy, count(*) filter (where tj) as translation_jump_count, count(*) filter (where yj) as yaw_jump_count, sum(t) filter (where ok) as len from j group by run)"""


@query(
    "trajectory_summary",
    f"""{_TSUM} select bb.run, total_frames, initialization_reset_count, valid_count, invalid_count, low_quality_count, insufficient_features_count, round(mn, 6) as min_translation_px, round(mx, 6) as max_translation_px,
  round(av, 6) as mean_translation_px, round(bb.md, 6) as median_translation_px, round(q9, 6) as p90_translation_px, round(q95, 6) as p95_translation_px, round(ay, 6) as mean_abs_yaw_rad, round(qy, 6) as p95_abs_yaw_rad,
  'initialization->' || big.frame_id as largest_translation_jump_frame_pair, translation_jump_count, yaw_jump_count, round(len, 4) as trajectory_length_px, round(sqrt(fx * fx + fy * fy), 6) as net_displacement_px,
  round(fyaw, 6) as cumulative_yaw_rad, round(valid_count * 1e0 / total_frames, 6) as valid_ratio, coalesce(txt, '{{}}') as other_failure_reasons
from bb join fin on bb.run = fin.run join big on bb.run = big.run left join ot on bb.run = ot.run""",
)
def trajectory_summary(spark, sf_dir):
    steps = T.mad_jumps(vo_steps(spark, sf_dir), ["run"])
    found = T.trajectory_summary(steps, ["run"]).select(*_SUMMARY_COLUMNS)
    return rounded(found.withColumn("trajectory_length_px", F.round("trajectory_length_px", 4)))


@query(
    "candidates_assessed",
    f"""{_TSUM}, ca as (select run, valid_count * 1e0 / total_frames as valid_ratio, translation_jump_count + yaw_jump_count as jumps, valid_count * 1e0 / total_frames - 0.5 * (translation_jump_count + yaw_jump_count) / greatest(1, valid_count) as score from bb),
oa as (select 'highest_valid_ratio' as choice, row_number() over (order by valid_ratio desc, jumps, run) as "rank", * from ca union all select 'lowest_jump_valid_ratio_ge_050', row_number() over (order by jumps, valid_ratio desc, run), * from ca where valid_ratio >= 0.5
union all select 'lowest_jump_valid_ratio_ge_070', row_number() over (order by jumps, valid_ratio desc, run), * from ca where valid_ratio >= 0.7 union all select 'stability_coverage_compromise', row_number() over (order by score desc, valid_ratio desc, run), * from ca)
select choice, "rank", run, round(valid_ratio, 6) as valid_ratio, jumps, round(score, 6) as stability_coverage_score from oa where "rank" <= case when choice = 'highest_valid_ratio' then 3 else 1 end""",
)
def candidates_assessed(spark, sf_dir):
    steps = T.mad_jumps(vo_steps(spark, sf_dir), ["run"])
    return rounded(T.assess_candidates(T.trajectory_summary(steps, ["run"]), "run"))


