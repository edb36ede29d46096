"""Scores, groups and statistics of evaluation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightframe.catalog import query
from flightframe.catalog.motion import GATES_SQL, gate_decisions
from flightframe.catalog.shared import SCORES, counts_sql, ctes, div, rounded, scored, scores_sql, view
from flightframe.functions.labels import METHODS, MOVING, crop_type
from flightframe.operators import metrics as M
from flightframe.operators.sweep import most_ambiguous, top_errors

FEATURES = ("bbox_center_residual", "flow_residual", "local_corrected_residual")
_EVALS = ctes("v_evals")
_LONG = _EVALS + ", j as (select * from v_evals where matched and not ignored), m as (" + " union all ".join(
    f"select '{m}' as method, {m}_prediction as prediction, frame, gt_index, gt_motion, {', '.join(FEATURES)} from j" for m in METHODS
) + ")"
_GROUP = """case when prediction = 'unknown' then 'unknown' when gt_motion = 'stationary' and prediction = 'moving' then 'false_moving'
  when gt_motion = 'stationary' then 'true_stationary' when prediction = 'moving' then 'true_moving' else 'false_stationary' end"""
_GROUPED = f'{_LONG}, g as (select *, {_GROUP} as "group" from m)'


@query(
    "motion_summary",
    f"""{_LONG}, t as (select count(*) as total_gt, count(*) filter (where matched) as matched_gt, count(*) filter (where not matched) as unmatched_gt, count(*) filter (where ignored) as ignored_gt from v_evals),
c as (select method, {counts_sql('gt_motion', 'prediction')} from m group by method),
s as ({scores_sql('c', ['method'], ['balanced_score'])}) select s.*, t.* from s cross join t""",
)
def motion_summary(spark, sf_dir):
    found = M.motion_summary(view(spark, sf_dir, "v_evals"))
    return scored(found, ["method", "total_gt", "matched_gt", "unmatched_gt", "ignored_gt"], ["balanced_score"])


@query(
    "motion_confusion",
    f"""{_LONG}, cells as (select * from (select distinct method from m) a cross join (values ('moving'), ('stationary')) b(gt_motion) cross join (values ('moving'), ('stationary'), ('unknown')) c(predicted_motion))
select cells.method, cells.gt_motion, cells.predicted_motion, count(m.method) as "count" from cells
left join m on m.method = cells.method and m.gt_motion = cells.gt_motion and m.prediction = cells.predicted_motion
group by cells.method, cells.gt_motion, cells.predicted_motion""",
)
def motion_confusion(spark, sf_dir):
    return M.motion_confusion(view(spark, sf_dir, "v_evals"))


@query(
    "classification_metrics",
    f"{_LONG}, c as (select method, frame % 10 as part, {counts_sql('gt_motion', 'prediction')} from m group by method, frame % 10) {scores_sql('c', ['method', 'part'])}",
)
def classification_metrics(spark, sf_dir):
    e = view(spark, sf_dir, "v_evals").where(F.col("matched") & ~F.col("ignored"))
    long = M.method_rows(e.withColumn("part", F.col("frame") % 10), ["part", "gt_motion"])
    return scored(M.classification_metrics(long, ["method", "part"], "gt_motion", "prediction"), ["method", "part"])


@query("outcome_groups", f'{_GROUPED} select method, "group", gt_motion, count(*) as n from g group by method, "group", gt_motion')
def outcome_groups(spark, sf_dir):
    return M.grouped_samples(view(spark, sf_dir, "v_evals"), FEATURES).groupBy("method", "group", "gt_motion").agg(F.count(F.lit(1)).alias("n"))


def _stats(value: str, probs: dict[str, float]) -> str:
    tails = ", ".join(f"round(quantile_cont({value}, {p}), 6) as {n}" for n, p in probs.items())
    return f"count({value}) as \"count\", round(min({value}), 6) as minimum, round(max({value}), 6) as maximum, round(avg({value}), 6) as mean, {tails}"


_UNPIVOT = lambda table, keep: " union all ".join(f"select {keep}, '{f}' as feature, {f} as value from {table}" for f in FEATURES)


@query(
    "group_statistics",
    f"""{_GROUPED}, u as ({_UNPIVOT('g', 'method, "group"')}) select method, "group", feature, {_stats('value', M.GROUP_PROBS)} from u group by method, "group", feature""",
)
def group_statistics(spark, sf_dir):
    return rounded(M.group_statistics(view(spark, sf_dir, "v_evals"), FEATURES))


_SAMPLE_FEATURES = ("residual", "iou", "score", "size_ratio")


@query(
    "feature_distributions",
    ctes("v_samples") + ", u as (" + " union all ".join(f"select gt, '{f}' as feature, {f} as value from v_samples" for f in _SAMPLE_FEATURES)
    + f") select gt, feature, {_stats('value', M.TRUTH_PROBS)} from u group by gt, feature",
)
def feature_distributions(spark, sf_dir):
    return rounded(M.feature_distributions(view(spark, sf_dir, "v_samples"), "gt", _SAMPLE_FEATURES))


@query(
    "rank_auc",
    f"""{_EVALS}, j as (select * from v_evals where matched and not ignored), u as ({_UNPIVOT('j', 'gt_motion')}),
c as (select feature, value, count(*) filter (where gt_motion = 'moving') as pos, count(*) filter (where gt_motion = 'stationary') as neg from u where value is not null group by feature, value),
r as (select *, sum(neg) over (partition by feature order by value rows between unbounded preceding and 1 preceding) as below from c),
f as (select feature, cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives, sum(pos * (coalesce(below, 0) + neg / 2e0)) / (sum(pos) * sum(neg) * 1e0) as auc from r group by feature),
d as (select feature, median(case when gt_motion = 'moving' then value end) as positive_median, median(case when gt_motion = 'stationary' then value end) as negative_median from u group by feature)
select f.feature, positives + negatives as "count", positives, negatives, round(auc, 6) as auc, round(greatest(auc, 1 - auc), 6) as separation_auc,
  round(positive_median, 6) as positive_median, round(negative_median, 6) as negative_median from f join d on f.feature = d.feature""",
)
def rank_auc(spark, sf_dir):
    e = view(spark, sf_dir, "v_evals").where(F.col("matched") & ~F.col("ignored"))
    return rounded(M.rank_auc(e, F.col("gt_motion") == MOVING, FEATURES))


_ALL = _EVALS + ", m as (" + " union all ".join(f"select '{m}' as method, {m}_prediction as prediction from v_evals" for m in METHODS) + ")"
_SHARE = lambda n: f"round(100e0 * count(*) filter (where prediction = '{n}') / count(*), 6) as {n}_percentage"


@query(
    "method_shares",
    f"""{_ALL} select method, count(*) as total_detections, count(*) filter (where prediction = 'moving') as moving_count, count(*) filter (where prediction = 'stationary') as stationary_count,
  count(*) filter (where prediction = 'unknown') as unknown_count, {_SHARE('moving')}, {_SHARE('stationary')}, {_SHARE('unknown')} from m group by method""",
)
def method_shares(spark, sf_dir):
    return rounded(M.method_shares(view(spark, sf_dir, "v_evals")))


@query(
    "method_disagreements",
    _EVALS + " " + " union all ".join(
        f"select '{a}_vs_{b}' as comparison, count(*) filter (where {a}_prediction is distinct from {b}_prediction) as differing from v_evals"
        for i, b in enumerate(METHODS[:5]) for a in METHODS[:i]
    ),
)
def method_disagreements(spark, sf_dir):
    return M.method_disagreements(view(spark, sf_dir, "v_evals"))


@query(
    "method_transitions",
    _EVALS + " " + " union all ".join(
        f"select '{n}' as transition, count(*) filter (where {a}_prediction = '{x}' and {b}_prediction = '{y}') as \"count\" from v_evals"
        for n, (a, x, b, y) in M.TRANSITIONS.items()
    ),
)
def method_transitions(spark, sf_dir):
    return M.method_transitions(view(spark, sf_dir, "v_evals"))


@query(
    "gate_summary",
    f"{GATES_SQL} select gate, level, count(*) filter (where reason like '%accepted') as accepted, count(*) filter (where not reason like '%accepted') as rejected from decided group by gate, level",
)
def gate_summary(spark, sf_dir):
    return M.gate_summary(gate_decisions(spark, sf_dir))


@query(
    "gate_difference",
    f"""{GATES_SQL} select pair, gate_id from decided where gate = 'adaptive' and reason like '%accepted'
intersect select pair, gate_id from decided where gate = 'fixed_050' and not reason like '%accepted'""",
)
def gate_difference(spark, sf_dir):
    return M.gate_difference(gate_decisions(spark, sf_dir), ["pair", "gate_id"], "adaptive", "fixed_050")


_SCORE = "coalesce(greatest(local_corrected_residual, flow_residual, bbox_center_residual), -1e0)"


@query(
    "top_errors",
    f"""{_GROUPED}, r as (select *, {_SCORE} as score from g where "group" = 'false_moving'), n as (select *, row_number() over (partition by method order by score desc, gt_index, frame) as "rank" from r)
select method, frame, gt_index, score, "rank" from n where "rank" <= 20""",
)
def top_false_moving(spark, sf_dir):
    g = M.grouped_samples(view(spark, sf_dir, "v_evals"), FEATURES).withColumn("key", F.struct("gt_index", "frame"))
    found = top_errors(g, "false_moving", key="key")
    return found.select("method", "frame", "gt_index", "score", "rank")


@query(
    "most_ambiguous",
    f"""{_GROUPED}, r as (select method, frame, gt_index, abs(coalesce(nullif(local_corrected_residual, 0), 4) - 4) as distance from g where "group" = 'unknown')
select method, frame, gt_index, round(distance, 6) as distance from r order by r.distance, method, gt_index, frame limit 100""",
)
def ambiguous(spark, sf_dir):
    g = M.grouped_samples(view(spark, sf_dir, "v_evals"), FEATURES).withColumn("key", F.struct("gt_index", "frame"))
    return rounded(most_ambiguous(g, key="key").select("method", "frame", "gt_index", "distance"))


_MATCH = ctes("v_matches")
_CONF = lambda made: f"""count(*) filter (where expected = '1' and {made}) as true_positive, count(*) filter (where expected = '0' and {made}) as false_positive,
  count(*) filter (where expected = '0' and not {made}) as true_negative, count(*) filter (where expected = '1' and not {made}) as false_negative,
  count(*) filter (where expected in ('0', '1')) as evaluated_count, count(*) filter (where expected = 'IGNORE') as ignored_count"""
_PR = lambda source, keep: f"""select {keep} true_positive, false_positive, true_negative, false_negative, evaluated_count, ignored_count, round(p, 6) as "precision", round(r, 6) as recall,
  round({div('2 * p * r', 'p + r')}, 6) as f1, case when evaluated_count <> 0 then round((true_positive + true_negative) * 1e0 / evaluated_count, 6) end as accuracy
from (select *, {div('true_positive', 'true_positive + false_positive')} as p, {div('true_positive', 'true_positive + false_negative')} as r from {source}) z"""


@query("match_confusion", f"{_MATCH}, c as (select {_CONF('produced')} from v_matches) {_PR('c', '')}")
def match_confusion(spark, sf_dir):
    return rounded(M.match_confusion(view(spark, sf_dir, "v_matches")))


_SPECS = [
    (name, feature, op, base * k if name == "maximum_rms" else max(0.0, min(1.0, base * k)))
    for name, feature, op, base, factors in (
        ("minimum_similarity", "similarity_mean", ">=", 0.45, (0.8, 1.0, 1.2)),
        ("minimum_inlier_ratio", "inlier_ratio", ">=", 0.35, (0.75, 1.0, 1.25)),
        ("maximum_rms", "rms", "<=", 8.0, (0.75, 1.0, 1.25)),
        ("minimum_visibility", "visible_ratio", ">=", 0.25, (0.75, 1.0, 1.25)),
        ("minimum_confidence", "confidence", ">=", 0.35, (0.75, 1.0, 1.25)),
    )
    for k in factors
]


def _sensitivity(n, f, op, t):
    ok = f"{f} {op} cast({t!r} as double)"
    return f"""select '{n}' as parameter, '{op}' as operator, cast({t!r} as double) as threshold, count(*) as eligible_count, count(*) filter (where {ok}) as pass_count,
  count(*) filter (where expected = '1' and {ok}) as tp, count(*) filter (where expected = '0' and {ok}) as fp,
  count(*) filter (where expected = '1') as pos, count(*) filter (where expected = '0') as neg from v_matches where expected <> 'IGNORE' and {f} is not null"""


_MATCH_FEATURES = ("correspondence_count", "inlier_ratio", "rms", "visible_ratio", "confidence")


@query(
    "match_distributions",
    ctes("v_matches") + ", u as (" + " union all ".join(f"""select case expected when '1' then 'positive' when '0' then 'negative' end as "group", '{f}' as feature, cast({f} as double) as value from v_matches where expected in ('0', '1')""" for f in _MATCH_FEATURES)
    + f""" union all select case when accepted then 'accepted' else 'rejected' end, 'confidence', confidence from v_matches) select "group", feature, {_stats('value', M.MATCH_PROBS)} from u group by "group", feature""",
)
def match_distributions(spark, sf_dir):
    return rounded(M.match_distributions(view(spark, sf_dir, "v_matches"), _MATCH_FEATURES))


@query(
    "match_threshold_sensitivity",
    f"{_MATCH}, c as ({' union all '.join(_sensitivity(*s) for s in _SPECS)}), " + """
r as (select *, tp * 1e0 / nullif(tp + fp, 0) as p, tp * 1e0 / nullif(pos, 0) as rc from c)
select parameter, operator, round(threshold, 6) as threshold, eligible_count, pass_count, round(rc, 6) as positive_pass_rate, round(fp * 1e0 / nullif(neg, 0), 6) as negative_pass_rate,
  round(p, 6) as "precision", round(rc, 6) as recall, round(2 * p * rc / nullif(p + rc, 0), 6) as f1 from r""",
)
def match_threshold_sensitivity(spark, sf_dir):
    specs = spark.createDataFrame(_SPECS, "parameter string, feature string, operator string, threshold double")
    return rounded(M.match_threshold_sensitivity(view(spark, sf_dir, "v_matches"), specs))


_SELECTED = "case stage when 'hybrid' then hybrid_accepted when 'aliked_lightglue' then local_accepted else accepted end"
_TIMEOUT = f"""{_MATCH}, t as (select *, {_SELECTED} as selected_accepted from v_matches), x as (select t.*, timeout_sec, time_limit = timeout_sec as observed from t cross join (values (2e0), (3e0), (4e0), (5e0), (6e0)) l(timeout_sec)),
y as (select *, case when observed then outcome = 'timeout' else elapsed > timeout_sec end as late from x), z as (select *, case when observed then produced else selected_accepted and not late end as made from y),
c as (select timeout_sec, count(*) filter (where made) as successful, count(*) filter (where late) as timeout_count, bool_and(observed) as all_observed, {_CONF('made')} from z group by timeout_sec),
w as (select c.*, case when all_observed then 'observed production run' else 'offline measured-duration replay' end as mode from c)"""


def _timeouts(spark, sf_dir):
    rows = view(spark, sf_dir, "v_matches").withColumn("selected_accepted", M.selected_accepted(F.col("stage")))
    return M.timeout_sensitivity(rows)


@query("timeout_sensitivity", f"{_TIMEOUT} {_PR('w', 'timeout_sec, successful, timeout_count, mode,')}")
def timeout_sensitivity(spark, sf_dir):
    return rounded(_timeouts(spark, sf_dir))


@query(
    "smallest_safe_timeout",
    f"""{_TIMEOUT} select min(case when timeout_count = 0 and false_positive = 0 and false_negative = 0 then timeout_sec end) as candidate,
  min(case when timeout_count = 0 and false_positive = 0 and false_negative = 0 and all_observed then timeout_sec end) as observed from w""",
)
def smallest_safe_timeout(spark, sf_dir):
    return M.smallest_safe_timeout(_timeouts(spark, sf_dir))


_CROP = "case when lower(reference_id) like '%tight%' then 'tight' when lower(reference_id) like '%medium%' then 'medium' when lower(reference_id) like '%wide%' then 'wide' else 'unspecified' end"
_REFSUM = f"""{_MATCH}, s as (select reference_id, {_CROP} as crop_type, count(*) as pair_count, count(*) filter (where produced) as accepted_count,
  count(*) filter (where produced) * 1e0 / count(*) as accepted_rate, avg(correspondence_count) as mean_correspondences, avg(inlier_ratio) as mean_inlier_ratio,
  avg(case when produced then confidence end) as mean_confidence from v_matches group by reference_id)"""


def _reference_summary(spark, sf_dir):
    return M.reference_summary(view(spark, sf_dir, "v_matches"), crop_type(F.col("reference_id")))


@query(
    "reference_summary",
    f"""{_REFSUM} select reference_id, crop_type, pair_count, accepted_count, round(accepted_rate, 6) as accepted_rate, round(mean_correspondences, 6) as mean_correspondences,
  round(mean_inlier_ratio, 6) as mean_inlier_ratio, round(mean_confidence, 6) as mean_confidence from s""",
)
def reference_summary(spark, sf_dir):
    return rounded(_reference_summary(spark, sf_dir))


@query(
    "crop_summary",
    f"""{_REFSUM} select crop_type, count(*) as reference_count, round(avg(accepted_rate), 6) as accepted_rate, round(avg(mean_correspondences), 6) as mean_correspondences,
  round(avg(mean_inlier_ratio), 6) as mean_inlier_ratio from s group by crop_type""",
)
def crop_summary(spark, sf_dir):
    return rounded(M.crop_summary(_reference_summary(spark, sf_dir)))


@query(
    "latency_summary",
    f"""{_MATCH} select stage, count(elapsed) as "count", round(min(elapsed), 6) as minimum, round(max(elapsed), 6) as maximum, round(avg(elapsed), 6) as mean,
  round(quantile_cont(elapsed, 0.5), 6) as p50, round(quantile_cont(elapsed, 0.95), 6) as p95 from v_matches group by stage""",
)
def latency_summary(spark, sf_dir):
    return rounded(M.latency_summary(view(spark, sf_dir, "v_matches"), ["stage"], "elapsed"))


@query("stage_outcomes", f'{_MATCH} select stage, outcome, count(*) as "count" from v_matches group by stage, outcome')
def stage_outcomes(spark, sf_dir):
    return M.stage_outcomes(view(spark, sf_dir, "v_matches"))


_CAUSES = f"""{_MATCH}, t as (select *, {_SELECTED} as sel from v_matches), c as (select *, case when produced = sel then 'consistent' when not reference_active then 'inactive_reference'
  when stage = 'dinov2' and hybrid_accepted then 'service_used_dinov2_config' when sel and stage <> 'dinov2' and outcome = 'timeout' then 'local_refinement_timeout'
  when sel then 'service_result_missing_unknown' else 'geometry_rejected_after_diagnostic' end as root_cause from t)"""


def _caused(spark, sf_dir):
    m = view(spark, sf_dir, "v_matches").withColumn("selected_accepted", M.selected_accepted(F.col("stage")))
    return m.withColumn("root_cause", M.root_cause(F.col("stage")))


@query(
    "root_causes",
    f"""{_CAUSES} select doc_id, root_cause, case when produced then null when root_cause = 'local_refinement_timeout' then 'timeout' when root_cause = 'inactive_reference' then 'inactive_reference' else outcome end as final_rejection from c""",
)
def root_causes(spark, sf_dir):
    c = _caused(spark, sf_dir)
    return c.select("doc_id", "root_cause", M.final_rejection(F.col("root_cause"), F.col("outcome")).alias("final_rejection"))


_CAUSE_NAMES = (
    "consistent", "inactive_reference", "service_used_dinov2_config", "local_refinement_timeout",
    "service_result_missing_unknown", "geometry_rejected_after_diagnostic",
)


@query(
    "service_consistency",
    f"""{_CAUSES} select count(*) filter (where accepted) as dinov2_accepted, count(*) filter (where local_accepted) as local_accepted, count(*) filter (where hybrid_accepted) as hybrid_accepted,
  count(*) filter (where sel) as selected_accepted, count(*) filter (where produced) as produced, count(*) filter (where stage <> 'dinov2' and outcome = 'timeout') as timeout_pairs,
  {', '.join(f"count(*) filter (where root_cause = '{c}') as {c}" for c in _CAUSE_NAMES)} from c""",
)
def service_consistency(spark, sf_dir):
    return M.service_consistency(_caused(spark, sf_dir))
