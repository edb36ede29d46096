"""Threshold sweeps, rankings, cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightframe.catalog import query
from flightframe.catalog.shared import SCORES, counts_sql, ctes, rounded, scored, scores_sql, view
from flightframe.operators import sweep as S
from flightframe.plans.settle import settle

_LOW, _HIGH = (2.0, 3.0, 4.0, 5.0), (6.0, 8.0, 10.0, 12.0)
LOCAL_LOW = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)
LOCAL_HIGH = (4.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0)
SCENE_DEFAULTS = (2.0, 5.0, 3.0, 0.20)
SCENE_GRIDS = [tuple(sorted({max(0.0, v * f) for f in S.SCENE_FACTORS})) for v in SCENE_DEFAULTS[:3]]
RATIOS = tuple(sorted({max(0.01, min(1.0, SCENE_DEFAULTS[3] * f)) for f in S.RATIO_FACTORS}))

_values = lambda name, values: f"(values {', '.join(f'(cast({v!r} as double))' for v in values)}) {name}_t({name})"
_DECIDE = """case when not homography_valid or frame_edge or projected_edge or residual is null or iou is null then 'unknown' when iou < mi or score < ms or size_ratio < mn or size_ratio > mx then 'unknown'
  when residual <= lo then 'stationary' when residual >= hi then 'moving' else 'unknown' end"""
# The samples only reach a decision through their values, so equal ones are counted first.
_CELLS = ctes("v_samples") + ", cell as (select gt, residual, iou, score, size_ratio, homography_valid, frame_edge, projected_edge, count(*) as n from v_samples group by all)"


def box_sweep(spark, sf_dir):
    return settle(S.threshold_sweep(view(spark, sf_dir, "v_samples")))


_up_to = lambda grid, v: "case " + " ".join(f"when {v} >= {t!r} then cast({t!r} as double)" for t in sorted(grid, reverse=True)) + " else -1e0 end"
_from = lambda grid, v: "case " + " ".join(f"when {v} <= {t!r} then cast({t!r} as double)" for t in sorted(grid)) + " else 1e9 end"
# All configurations over cells: a value only counts through the grid threshold next to it.
_FULL = f"""{_CELLS}, near as (select gt, {_from(S.STATIONARY_GRID, 'residual')} as r_lo, {_up_to(S.MOVING_GRID, 'residual')} as r_hi, {_up_to(S.IOU_GRID, 'iou')} as i, {_up_to(S.SCORE_GRID, 'score')} as s, {_up_to(S.MIN_SIZE_GRID, 'size_ratio')} as z_lo, {_from(S.MAX_SIZE_GRID, 'size_ratio')} as z_hi, sum(n) as n
  from cell where homography_valid and not frame_edge and not projected_edge and residual is not null and iou is not null and score is not null and size_ratio is not null group by all),
grid as (select *, row_number() over (order by lo, hi, mi, ms, mn, mx) - 1 as config_id from {_values('lo', S.STATIONARY_GRID)} cross join {_values('hi', S.MOVING_GRID)} cross join {_values('mi', S.IOU_GRID)} cross join {_values('ms', S.SCORE_GRID)} cross join {_values('mn', S.MIN_SIZE_GRID)} cross join {_values('mx', S.MAX_SIZE_GRID)} where lo < hi),
gates as (select distinct mi, ms, mn, mx from grid), gated as (select mi, ms, mn, mx, gt, r_lo, r_hi, sum(n) as n from gates join near on i >= mi and s >= ms and z_lo >= mn and z_hi <= mx group by all),
hit as (select config_id, sum(case when gt = 'moving' and r_hi >= hi then n end) as mm, sum(case when gt = 'stationary' and r_hi >= hi then n end) as sm, sum(case when gt = 'stationary' and r_lo <= lo then n end) as ss, sum(case when gt = 'moving' and r_lo <= lo then n end) as ms_
  from grid join gated using (mi, ms, mn, mx) group by config_id),
whole as (select cast(sum(n) as bigint) as total, cast(coalesce(sum(case when gt = 'moving' then n end), 0) as bigint) as moving_gt, cast(coalesce(sum(case when gt = 'stationary' then n end), 0) as bigint) as stationary_gt from cell),
c as (select *, total - moving_pred - stationary_pred as unknown_pred from (select *, true_moving + false_moving as moving_pred, true_stationary + false_stationary as stationary_pred from (select config_id, lo as stationary_threshold, hi as moving_threshold, mi as min_iou, ms as min_association_score, mn as min_size_ratio, mx as max_size_ratio, mi >= 0.1e0 and ms >= 0.25e0 and mn >= 0.5e0 and mx <= 2e0 as replay_supported, total, moving_gt, stationary_gt,
  cast(coalesce(mm, 0) as bigint) as true_moving, cast(coalesce(sm, 0) as bigint) as false_moving, cast(coalesce(ss, 0) as bigint) as true_stationary, cast(coalesce(ms_, 0) as bigint) as false_stationary from grid left join hit using (config_id) cross join whole) a) b)"""
_ALL = ["config_id", *S.CONFIG, "replay_supported"]
_SWEPT = f"{_FULL}, sweep as ({scores_sql('c', _ALL).replace('round(', '(').replace(', 6)', ')')}), pool as (select * from sweep where replay_supported or not exists (select 1 from sweep where replay_supported))"
_boards = [
    ("highest_macro_f1", "true", "macro_f1 desc, balanced_accuracy desc, coverage desc"),
    ("highest_balanced_accuracy", "true", "balanced_accuracy desc, macro_f1 desc, coverage desc"),
    ("highest_stationary_f1", "true", "stationary_f1 desc, macro_f1 desc, coverage desc"),
    ("highest_moving_f1", "true", "moving_f1 desc, macro_f1 desc, coverage desc"),
    *[(f"macro_f1_coverage_0{c}", f"coverage >= {c / 100}", "macro_f1 desc, coverage desc, balanced_accuracy desc") for c in (50, 60, 70, 80)],
    ("lowest_false_moving_recall070_coverage060", "moving_recall >= 0.7 and coverage >= 0.6", "false_moving, macro_f1 desc, coverage desc"),
    ("conservative_false_stationary_zero", "false_stationary = 0", "macro_f1 desc, coverage desc, moving_recall desc"),
]
_shown = ", ".join(["config_id", *S.CONFIG, *[f"round({m}, 6) as {m}" for m in SCORES]])
_BOARDS = f"{_SWEPT}, board as (" + " union all ".join(f"select '{name}' as leaderboard, row_number() over (order by {order}, config_id) as rank, * from pool where {test}" for name, test, order in _boards) + f") select leaderboard, cast(rank as integer) as rank, {_shown}, false_moving, false_stationary from board where rank <= 10"
_chosen = lambda name, first, order, then: f"select * from (select '{name}' as profile, * from pool order by case when {first} then 0 else 1 end, {order}, {then}, config_id limit 1) t"
_cautious = "false_stationary = 0 and moving_recall >= 0.5 and coverage >= 0.4"
_CHOSEN = f"{_SWEPT} select profile, {_shown} from (" + " union all ".join([
    _chosen("Balanced", "coverage >= 0.5", "macro_f1 desc", "balanced_accuracy desc, coverage desc"),
    _chosen("Conservative", _cautious, f"case when {_cautious} then false_moving else 0 end", f"macro_f1 desc, case when {_cautious} then 0e0 - coverage else false_moving end"),
    _chosen("High Coverage", "true", "coverage desc", "macro_f1 desc, balanced_accuracy desc"),
]) + ") p"
_PARETO = f"""{_SWEPT}, u as (select macro_f1, coverage, false_moving, false_stationary, min(config_id) as config_id from sweep group by all)
select u.config_id, {', '.join(f'sweep.{n}' for n in S.CONFIG)}, round(u.macro_f1, 6) as macro_f1, round(u.coverage, 6) as coverage, u.false_moving, u.false_stationary from u join sweep on sweep.config_id = u.config_id
where not exists (select 1 from u o where o.macro_f1 >= u.macro_f1 and o.coverage >= u.coverage and o.false_moving <= u.false_moving and o.false_stationary <= u.false_stationary and o.config_id <> u.config_id)"""
_MEANS = f"{_SWEPT}, scope as (select 'all_grid' as scope, * from sweep union all select 'replay_supported', * from sweep where replay_supported) " + " union all ".join(
    f"select scope, '{name}' as parameter, {name} as value, count(*) as config_count, {', '.join(f'round(avg({m}), 6) as mean_{m}' for m in S.SENSITIVITY_METRICS)} from scope group by scope, {name}" for name in S.CONFIG)


@query("threshold_sweep", f"{_FULL} {scores_sql('c', _ALL)}")
def threshold_sweep(spark, sf_dir):
    return scored(S.threshold_sweep(view(spark, sf_dir, "v_samples")), ["config_id", *S.CONFIG, "replay_supported"])


@query("leaderboards", _BOARDS)
def leaderboards(spark, sf_dir):
    return rounded(S.leaderboards(box_sweep(spark, sf_dir)).select("leaderboard", "rank", "config_id", *S.CONFIG, *SCORES, "false_moving", "false_stationary"))


@query("profiles_selected", _CHOSEN)
def profiles_selected(spark, sf_dir):
    return rounded(S.select_profiles(box_sweep(spark, sf_dir)).select("profile", "config_id", *S.CONFIG, *SCORES))


@query("pareto_frontier", _PARETO)
def pareto_frontier(spark, sf_dir):
    return rounded(S.pareto_frontier(box_sweep(spark, sf_dir)).select("config_id", *S.CONFIG, "macro_f1", "coverage", "false_moving", "false_stationary"))


@query("parameter_sensitivity", _MEANS)
def parameter_sensitivity(spark, sf_dir):
    return rounded(S.parameter_sensitivity(box_sweep(spark, sf_dir)))


_LOCAL = ctes("v_evals") + f", cell as (select gt_motion as gt, local_corrected_residual as v, count(*) as n from v_evals where matched and not ignored group by all), grid as (select * from {_values('lo', LOCAL_LOW)} cross join {_values('hi', LOCAL_HIGH)} where lo < hi), d as (select lo, hi, gt, n, case when v is null then 'unknown' when v <= lo then 'stationary' when v >= hi then 'moving' else 'unknown' end as pred from grid cross join cell), c as (select lo as stationary_threshold, hi as moving_threshold, {counts_sql('gt', 'pred', 'n')} from d group by lo, hi)"


def _judged(spark, sf_dir):
    return view(spark, sf_dir, "v_evals").where(F.col("matched") & ~F.col("ignored"))


def local_sweep(spark, sf_dir):
    return S.band_sweep(_judged(spark, sf_dir), "gt_motion", "local_corrected_residual", F.lit(True), LOCAL_LOW, LOCAL_HIGH)


@query("local_threshold_sweep", f"{_LOCAL} {scores_sql('c', ['stationary_threshold', 'moving_threshold'])}")
def local_threshold_sweep(spark, sf_dir):
    return scored(local_sweep(spark, sf_dir), ["stationary_threshold", "moving_threshold"])


@query(
    "best_sweep_rows",
    f"""{_LOCAL}, s as ({scores_sql('c', ['stationary_threshold', 'moving_threshold'])}), o as (select 'top' as choice, row_number() over (order by macro_f1 desc, balanced_accuracy desc, coverage desc, stationary_threshold, moving_threshold) as n, * from s
union all select 'coverage_0.70', row_number() over (order by macro_f1 desc, balanced_accuracy desc, coverage desc, stationary_threshold, moving_threshold), * from s where coverage >= 0.7
union all select 'coverage_0.80', row_number() over (order by macro_f1 desc, balanced_accuracy desc, coverage desc, stationary_threshold, moving_threshold), * from s where coverage >= 0.8)
select choice, stationary_threshold, moving_threshold, macro_f1, coverage from o where n <= case choice when 'top' then 5 else 1 end""",
)
def best_sweep_rows(spark, sf_dir):
    return rounded(S.best_rows(local_sweep(spark, sf_dir)).select("choice", "stationary_threshold", "moving_threshold", "macro_f1", "coverage"))


@query(
    "box_threshold_sensitivity",
    ctes("v_evals") + f""", cell as (select gt_motion as gt, bbox_center_residual as r, bbox_iou as i, association_score as s, frame_edge as e, count(*) as n from v_evals where matched and not ignored group by all),
grid as (select * from {_values('lo', _LOW)} cross join {_values('hi', _HIGH)} cross join {_values('mi', S.SENSITIVITY_IOU)} cross join {_values('ms', S.SENSITIVITY_SCORE)}),
d as (select grid.*, gt, n, case when r is null or i is null or s is null or i < mi or s < ms or e then 'unknown' when r <= lo then 'stationary' when r >= hi then 'moving' else 'unknown' end as pred from grid cross join cell),
c as (select lo as stationary_threshold, hi as moving_threshold, mi as min_iou, ms as min_association_score, {counts_sql('gt', 'pred', 'n')} from d group by lo, hi, mi, ms) {scores_sql('c', S.CONFIG[:4])}""",
)
def box_threshold_sensitivity(spark, sf_dir):
    gates = (S.Gate("min_iou", "bbox_iou", ">=", S.SENSITIVITY_IOU), S.Gate("min_association_score", "association_score", ">=", S.SENSITIVITY_SCORE))
    swept = S.band_sweep(_judged(spark, sf_dir), "gt_motion", "bbox_center_residual", ~F.col("frame_edge"), S.SENSITIVITY_STATIONARY, S.SENSITIVITY_MOVING, gates)
    return scored(swept, S.CONFIG[:4])


SCENE_SWEPT = ctes("v_scenes") + f""", cell as (select gt, homography_result as h, homography_bbox_result as b, homography_valid and quality_level <> 'low' as solid, background_ratio as br, background_median as bm, background_p90 as bp, grid_spread as gs, count(*) as n from v_scenes group by all),
grid as (select * from {_values('a', SCENE_GRIDS[0])} cross join {_values('p', SCENE_GRIDS[1])} cross join {_values('g', SCENE_GRIDS[2])} cross join {_values('q', RATIOS)}),
d as (select a, p, g, q, gt, n, case when not (solid and br >= q) then 'none' when bm <= a and bp <= p and gs <= g then 'h' else 'b' end as how, h, b from grid cross join cell),
e as (select *, case how when 'none' then 'unknown' when 'h' then h else b end as pred from d),
t as (select a, p, g, q, sum(n) as total, sum(case when gt = 'moving' then n end) as m, sum(case when gt = 'stationary' then n end) as s, coalesce(sum(case when gt = 'moving' and pred = 'moving' then n end), 0) as tpm, coalesce(sum(case when gt = 'stationary' and pred = 'moving' then n end), 0) as fm,
  coalesce(sum(case when gt = 'stationary' and pred = 'stationary' then n end), 0) as tps, coalesce(sum(case when gt = 'moving' and pred = 'stationary' then n end), 0) as fs, coalesce(sum(case when how = 'h' then n end), 0) as hs, coalesce(sum(case when how = 'b' then n end), 0) as bs from e group by a, p, g, q)
select a as background_median_max, p as background_p90_max, g as grid_spread_max, round(q, 6) as min_valid_background_ratio, round(2e0 * tpm / (tpm + fm + m), 6) as moving_f1, round(2e0 * tps / (tps + fs + s), 6) as stationary_f1, round((tpm + tps) * 1e0 / total, 6) as strict_accuracy,
  round((tpm + fm + tps + fs) * 1e0 / total, 6) as coverage, cast(total - tpm - fm - tps - fs as bigint) as "unknown", cast(fm as bigint) as false_moving, cast(fs as bigint) as false_stationary, cast(hs as bigint) as homography_selected, cast(bs as bigint) as homography_bbox_selected,
  cast(total - hs - bs as bigint) as unknown_selected, round((2e0 * tpm / (tpm + fm + m) + 2e0 * tps / (tps + fs + s)) / 2, 6) as macro_f1 from t"""


@query("scene_threshold_sweep_full", SCENE_SWEPT)
def scene_threshold_sweep_full(spark, sf_dir):
    return rounded(S.scene_sweep(view(spark, sf_dir, "v_scenes"), *SCENE_GRIDS, RATIOS))


_FOLDS = ctes("v_samples") + ", f as (select pair_id, cast((row_number() over (order by pair_id) - 1) % 5 + 1 as integer) as fold from (select distinct pair_id from v_samples) p)"


@query("group_folds", f"{_FOLDS} select pair_id, fold from f")
def group_folds(spark, sf_dir):
    return S.group_folds(view(spark, sf_dir, "v_samples"), "pair_id")


_PROFILES = (("Balanced", 3.0, 8.0, 0.10, 0.25, 0.5, 2.0), ("Conservative", 2.0, 12.0, 0.30, 0.45, 0.6, 2.0), ("High Coverage", 5.0, 6.0, 0.10, 0.25, 0.5, 2.0))
_CV = f"""{_FOLDS}, pf as (select * from (values {', '.join(f"('{p[0]}', " + ', '.join(f'cast({v!r} as double)' for v in p[1:]) + ')' for p in _PROFILES)}) t(profile, lo, hi, mi, ms, mn, mx)),
d as (select profile, f.fold, gt, {_DECIDE} as pred from v_samples s join f on s.pair_id = f.pair_id cross join pf), k as (select * from (select distinct fold from f) a cross join (values ('train'), ('validation')) b(split)),
c as (select d.profile, k.fold, k.split, {counts_sql('gt', 'pred')} from k join d on (k.split = 'validation') = (d.fold = k.fold) group by d.profile, k.fold, k.split), v as ({scores_sql('c', ['profile', 'fold', 'split'])})"""


def _validated(spark, sf_dir):
    profiles = spark.createDataFrame(_PROFILES, "profile string, " + ", ".join(f"{c} double" for c in S.CONFIG))
    return S.cross_validate(view(spark, sf_dir, "v_samples"), profiles)


@query("cross_validation", f"{_CV} select * from v")
def cross_validation(spark, sf_dir):
    return scored(_validated(spark, sf_dir), ["profile", "fold", "split"])


@query(
    "cross_validation_summary",
    f"""{_CV} select profile, {', '.join(f"round(avg({m}), 4) as {m}_mean, round(stddev_pop({m}), 4) as {m}_std" for m in ('macro_f1', 'coverage', 'stationary_f1', 'moving_f1'))} from v where split = 'validation' group by profile""",
)
def cross_validation_summary(spark, sf_dir):
    return rounded(S.cross_validation_summary(_validated(spark, sf_dir)), 4)


