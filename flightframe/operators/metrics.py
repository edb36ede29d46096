"""Scores of three-outcome motion answers, of match answers, and feature statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.labels import METHODS, MOVING, STATIONARY, UNKNOWN, classification_group
from flightframe.functions.numbers import count_if, divide, divide_or_null, harmonic
from flightframe.plans.percentiles import grouped_percentiles
from flightframe.plans.scans import CHUNK, ranged_axis, scan
from flightframe.plans.settle import settle

COUNTS = (
    "total", "moving_gt", "stationary_gt", "moving_pred", "stationary_pred", "unknown_pred",
    "true_moving", "false_moving", "true_stationary", "false_stationary",
)


def method_rows(rows: DataFrame, keep: Sequence[str], methods: Sequence[str] = METHODS) -> DataFrame:
    """One row per method: ``method`` and ``prediction``."""
    return rows.unpivot(
        list(keep), [f"{m}_prediction" for m in methods], "method", "prediction"
    ).withColumn("method", F.regexp_replace("method", "_prediction$", ""))


def outcome_counts(truth: Column, prediction: Column, weight: Column | None = None) -> list[Column]:
    """The ten counts all motion scores follow from; ``weight`` counts a row several times."""
    one = F.lit(1) if weight is None else weight
    count = lambda test: F.coalesce(F.sum(F.when(test, one)), F.lit(0))
    moving, stationary = truth == MOVING, truth == STATIONARY
    says_moving, says_stationary = prediction == MOVING, prediction == STATIONARY
    tests = (
        F.lit(True), moving, stationary, says_moving, says_stationary, prediction == UNKNOWN,
        moving & says_moving, stationary & says_moving, stationary & says_stationary, moving & says_stationary,
    )
    return [count(test).alias(name) for test, name in zip(tests, COUNTS)]


def with_scores(counts: DataFrame) -> DataFrame:
    """Add the scores; a division by zero gives zero."""
    c = {name: F.col(name) for name in COUNTS}
    correct = c["true_moving"] + c["true_stationary"]
    decided = c["moving_pred"] + c["stationary_pred"]
    first = {
        "strict_accuracy": divide(correct, c["total"]),
        "decided_only_accuracy": divide(correct, decided),
        "coverage": divide(decided, c["total"]),
        "moving_precision": divide(c["true_moving"], c["moving_pred"]),
        "moving_recall": divide(c["true_moving"], c["moving_gt"]),
        "stationary_precision": divide(c["true_stationary"], c["stationary_pred"]),
        "stationary_recall": divide(c["true_stationary"], c["stationary_gt"]),
        "unknown_rate": divide(c["unknown_pred"], c["total"]),
    }
    second = {
        "moving_f1": harmonic(F.col("moving_precision"), F.col("moving_recall")),
        "stationary_f1": harmonic(F.col("stationary_precision"), F.col("stationary_recall")),
        "balanced_accuracy": (F.col("moving_recall") + F.col("stationary_recall")) / 2,
        "balanced_score": F.col("strict_accuracy") * F.col("coverage"),
    }
    return counts.withColumns(first).withColumns(second).withColumn(
        "macro_f1", (F.col("moving_f1") + F.col("stationary_f1")) / 2
    )


def classification_metrics(rows: DataFrame, by: Sequence[str], truth: str, prediction: str) -> DataFrame:
    return with_scores(rows.groupBy(*by).agg(*outcome_counts(F.col(truth), F.col(prediction))))


def motion_summary(evals: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Per method: association totals over all rows, scores over matched rows not ignored."""
    long = method_rows(evals, ["gt_motion", "matched", "ignored"], methods)
    judged = F.col("matched") & ~F.col("ignored")
    totals = [
        F.count(F.lit(1)).alias("total_gt"), count_if(F.col("matched")).alias("matched_gt"),
        count_if(~F.col("matched")).alias("unmatched_gt"), count_if(F.col("ignored")).alias("ignored_gt"),
    ]
    counts = outcome_counts(F.when(judged, F.col("gt_motion")), F.when(judged, F.col("prediction")))
    counts[0] = count_if(judged).alias("total")
    return with_scores(long.groupBy("method").agg(*totals, *counts))


def motion_confusion(evals: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Counts of every (method, truth, prediction) cell, empty cells included."""
    judged = evals.where(F.col("matched") & ~F.col("ignored"))
    counted = method_rows(judged, ["gt_motion"], methods).groupBy("method").agg(
        *[
            count_if((F.col("gt_motion") == gt) & (F.col("prediction") == pred)).alias(f"{gt}|{pred}")
            for gt in (MOVING, STATIONARY) for pred in (MOVING, STATIONARY, UNKNOWN)
        ]
    )
    cells = [c for c in counted.columns if c != "method"]
    long = counted.unpivot(["method"], cells, "cell", "count")
    return long.select(
        "method", F.split("cell", r"\|")[0].alias("gt_motion"),
        F.split("cell", r"\|")[1].alias("predicted_motion"), "count",
    )


def method_shares(rows: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    said = lambda label: count_if(F.col("prediction") == label)
    counted = method_rows(rows, [], methods).groupBy("method").agg(
        F.count(F.lit(1)).alias("total_detections"),
        said(MOVING).alias("moving_count"), said(STATIONARY).alias("stationary_count"), said(UNKNOWN).alias("unknown_count"),
    )
    share = lambda name: (100.0 * divide(F.col(f"{name}_count"), F.col("total_detections"))).alias(f"{name}_percentage")
    return counted.select("*", share("moving"), share("stationary"), share("unknown"))


def method_disagreements(rows: DataFrame, methods: Sequence[str] = METHODS[:5]) -> DataFrame:
    """For each pair of methods, on how many rows they differ."""
    names = [(a, b) for i, b in enumerate(methods) for a in methods[:i]]
    folded = rows.agg(
        *[
            count_if(~F.col(f"{a}_prediction").eqNullSafe(F.col(f"{b}_prediction"))).alias(f"{a}_vs_{b}")
            for a, b in names
        ]
    )
    return folded.unpivot([], folded.columns, "comparison", "differing")


# The label changes between methods that are reported.
TRANSITIONS = {
    "global_median_moving_to_homography_stationary": ("global_median", MOVING, "homography", STATIONARY),
    "global_median_moving_to_homography_unknown": ("global_median", MOVING, "homography", UNKNOWN),
    "homography_stationary_to_bbox_unknown": ("homography", STATIONARY, "homography_bbox", UNKNOWN),
    "homography_moving_to_bbox_unknown": ("homography", MOVING, "homography_bbox", UNKNOWN),
}


def method_transitions(rows: DataFrame) -> DataFrame:
    hit = lambda m, label: F.col(f"{m}_prediction") == label
    folded = rows.agg(*[count_if(hit(a, x) & hit(b, y)).alias(name) for name, (a, x, b, y) in TRANSITIONS.items()])
    return folded.unpivot([], folded.columns, "transition", "count")


def feature_rows(rows: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keep), list(features), "feature", "value")


def value_statistics(
    rows: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], rows_limit: int | None = None
) -> DataFrame:
    """Count, min, max, mean and named percentiles of the non-null values of each group."""
    # Equal values are counted once before anything meets in a group.
    counted = rows.groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    known = settle(counted)
    tails = grouped_percentiles(
        known.where(F.col("_value").isNotNull()), by, {"_p": F.col("_value")}, list(probs.values()), rows_limit, F.col("_n")
    )
    n = F.sum(F.when(F.col("_value").isNotNull(), F.col("_n")))
    base = known.groupBy(*by).agg(
        F.coalesce(n, F.lit(0)).alias("count"), F.min("_value").alias("minimum"), F.max("_value").alias("maximum"),
        divide_or_null(F.sum(F.col("_value") * F.col("_n")), n).alias("mean"),
    )
    named = [F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(probs)]
    return base.join(tails, list(by), "left").select(*base.columns, *named)


# The percentiles each report shows.
GROUP_PROBS = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.90, "p95": 0.95}
TRUTH_PROBS = {"p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95}
MATCH_PROBS = {"p50": 0.50, "p95": 0.95}
LATENCY_PROBS = {"p50": 0.50, "p95": 0.95}


def grouped_samples(evals: DataFrame, features: Sequence[str], methods: Sequence[str] = METHODS) -> DataFrame:
    """Judged rows per method with their outcome group."""
    judged = evals.where(F.col("matched") & ~F.col("ignored"))
    kept = [c for c in judged.columns if not c.endswith("_prediction")]
    return method_rows(judged, kept, methods).withColumn(
        "group", classification_group(F.col("gt_motion"), F.col("prediction"))
    ).where(F.col("group").isNotNull())


def group_statistics(evals: DataFrame, features: Sequence[str], methods: Sequence[str] = METHODS) -> DataFrame:
    long = feature_rows(grouped_samples(evals, features, methods), ["method", "group"], features)
    return value_statistics(long, ["method", "group", "feature"], "value", GROUP_PROBS)


def feature_distributions(rows: DataFrame, truth: str, features: Sequence[str]) -> DataFrame:
    return value_statistics(feature_rows(rows, [truth], features), [truth, "feature"], "value", TRUTH_PROBS)


def match_distributions(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Finite values of each feature by expected answer, and confidences by accepted or not."""
    label = F.when(F.col("expected") == "1", "positive").when(F.col("expected") == "0", "negative")
    judged = rows.withColumn("group", label).where(F.col("group").isNotNull())
    told = rows.select(F.when(F.coalesce("accepted", F.lit(False)), "accepted").otherwise("rejected").alias("group"), F.lit("confidence").alias("feature"), F.col("confidence").cast("double").alias("value"))
    long = feature_rows(judged.withColumns({f: F.col(f).cast("double") for f in features}), ["group"], features)
    finite = F.when(~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))), F.col("value"))
    return value_statistics(long.unionByName(told).withColumn("value", finite), ["group", "feature"], "value", MATCH_PROBS)


def rank_auc(rows: DataFrame, positive: Column, features: Sequence[str]) -> DataFrame:
    """Tie-averaged rank AUC per feature.

    Rows are first counted per distinct value (combined before the shuffle); the running count
    of negatives then goes along the sorted distinct values, in chunks.
    """
    flagged = rows.withColumn("_positive", positive)
    long = feature_rows(flagged, ["_positive"], features).where(F.col("value").isNotNull())
    counted = settle(
        long.groupBy("feature", "value").agg(
            count_if(F.col("_positive")).alias("pos"), count_if(~F.col("_positive")).alias("neg")
        )
    )
    ordered, axis = ranged_axis(counted, ["feature"], ["value"])
    running = scan(ordered, axis, sums={"neg_upto": F.col("neg")}).drop(CHUNK)
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2)
    folded = running.groupBy("feature").agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(wins).alias("wins")
    )
    medians = [
        _weighted_median(ordered, axis, name, label) for name, label in (("pos", "positive_median"), ("neg", "negative_median"))
    ]
    auc = divide_or_null(F.col("wins"), F.col("positives") * F.col("negatives"))
    scored = folded.select(
        "feature", (F.col("positives") + F.col("negatives")).alias("count"), "positives", "negatives", auc.alias("auc")
    ).withColumn("separation_auc", F.greatest(F.col("auc"), 1 - F.col("auc")))
    return scored.join(medians[0], "feature", "left").join(medians[1], "feature", "left")


def _weighted_median(ordered: DataFrame, axis, weight: str, label: str) -> DataFrame:
    """Median per feature of values counted ``weight`` times."""
    running = scan(ordered.where(F.col(weight) > 0), axis, sums={"upto": F.col(weight)})
    totals = ordered.groupBy("feature").agg(F.sum(weight).alias("n"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    covers = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col(weight) <= at)
    return running.join(totals, "feature").groupBy("feature").agg(
        ((F.max(F.when(covers(low), F.col("value"))) + F.max(F.when(covers(high), F.col("value")))) / 2).alias(label)
    )


def gate_summary(decisions: DataFrame) -> DataFrame:
    """Accepted and rejected pairs by gate and quality level."""
    return decisions.groupBy("gate", "level").agg(
        count_if(F.col("accepted")).alias("accepted"), count_if(~F.col("accepted")).alias("rejected")
    )


def gate_difference(decisions: DataFrame, key: Sequence[str], yes: str, no: str) -> DataFrame:
    """Pairs gate ``yes`` accepts and gate ``no`` rejects."""
    took = decisions.where((F.col("gate") == yes) & F.col("accepted")).select(*key)
    left = decisions.where((F.col("gate") == no) & ~F.col("accepted")).select(*key)
    return took.intersect(left)


def _match_counts(expected: Column, produced: Column) -> list[Column]:
    yes, no = expected == "1", expected == "0"
    made = F.coalesce(produced, F.lit(False))
    return [
        count_if(yes & made).alias("true_positive"), count_if(no & made).alias("false_positive"),
        count_if(no & ~made).alias("true_negative"), count_if(yes & ~made).alias("false_negative"),
        count_if(yes | no).alias("evaluated_count"), count_if(expected == "IGNORE").alias("ignored_count"),
    ]


def _with_match_scores(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(f"{n}") for n in ("true_positive", "false_positive", "true_negative", "false_negative"))
    return (
        counts.withColumn("precision", divide(tp, tp + fp))
        .withColumn("recall", divide(tp, tp + fn))
        .withColumn("f1", harmonic(F.col("precision"), F.col("recall")))
        .withColumn("accuracy", divide_or_null(tp + tn, F.col("evaluated_count")))
    )


def match_confusion(rows: DataFrame) -> DataFrame:
    """Rows marked IGNORE count only as ignored."""
    return _with_match_scores(rows.agg(*_match_counts(F.col("expected"), F.col("produced"))))


def match_threshold_sensitivity(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Pass rates when one threshold is moved. ``specs``: parameter, feature, operator, threshold
    (a short literal table); divisions by zero give null here."""
    features = [r[0] for r in specs.select("feature").distinct().collect()]
    long = feature_rows(rows, ["expected"], features).where(
        F.col("value").isNotNull() & (F.col("expected") != "IGNORE")
    )
    tried = long.join(specs, "feature")
    passed = F.when(F.col("operator") == ">=", F.col("value") >= F.col("threshold")).otherwise(
        F.col("value") <= F.col("threshold")
    )
    yes, no = F.col("expected") == "1", F.col("expected") == "0"
    folded = tried.groupBy("parameter", "operator", "threshold").agg(
        F.count(F.lit(1)).alias("eligible_count"), count_if(passed).alias("pass_count"),
        count_if(yes & passed).alias("tp"), count_if(no & passed).alias("fp"),
        count_if(yes).alias("positives"), count_if(no).alias("negatives"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    return folded.select(
        "parameter", "operator", "threshold", "eligible_count", "pass_count",
        divide_or_null(tp, F.col("positives")).alias("positive_pass_rate"),
        divide_or_null(fp, F.col("negatives")).alias("negative_pass_rate"),
        divide_or_null(tp, tp + fp).alias("precision"),
        divide_or_null(tp, F.col("positives")).alias("recall"),
    ).withColumn(
        "f1", divide_or_null(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def timeout_sensitivity(rows: DataFrame, limits: Sequence[float] = (2.0, 3.0, 4.0, 5.0, 6.0)) -> DataFrame:
    """Replay other time limits from measured durations; rows that ran under a limit keep what
    was observed. Limits are a short literal list, exploded per row before the combined count."""
    tried = rows.withColumn("timeout_sec", F.explode(F.array(*[F.lit(float(v)) for v in limits])))
    observed = F.coalesce(F.abs(F.col("time_limit") - F.col("timeout_sec")) <= 1e-9, F.lit(False))
    late = F.when(observed, F.col("outcome") == "timeout").otherwise(
        F.coalesce(F.col("elapsed"), F.lit(0.0)) > F.col("timeout_sec")
    )
    made = F.when(observed, F.col("produced")).otherwise(F.col("selected_accepted") & ~F.col("late"))
    staged = tried.withColumn("observed", observed).withColumn("late", late).withColumn("made", made)
    counts = staged.groupBy("timeout_sec").agg(
        count_if(F.col("made")).alias("successful"), count_if(F.col("late")).alias("timeout_count"),
        F.bool_and("observed").alias("all_observed"), *_match_counts(F.col("expected"), F.col("made")),
    )
    mode = F.when(F.col("all_observed"), "observed production run").otherwise("offline measured-duration replay")
    return _with_match_scores(counts).withColumn("mode", mode).drop("all_observed")


def smallest_safe_timeout(sensitivity: DataFrame) -> DataFrame:
    safe = (F.col("timeout_count") == 0) & (F.col("false_positive") == 0) & (F.col("false_negative") == 0)
    seen = F.col("mode") == "observed production run"
    return sensitivity.agg(
        F.min(F.when(safe, F.col("timeout_sec"))).alias("candidate"),
        F.min(F.when(safe & seen, F.col("timeout_sec"))).alias("observed"),
    )


def reference_summary(rows: DataFrame, crop: Column) -> DataFrame:
    made = F.col("produced")
    return rows.groupBy("reference_id").agg(
        F.any_value(crop).alias("crop_type"), F.count(F.lit(1)).alias("pair_count"), count_if(made).alias("accepted_count"),
        (count_if(made) / F.count(F.lit(1))).alias("accepted_rate"),
        F.avg("correspondence_count").alias("mean_correspondences"),
        F.avg("inlier_ratio").alias("mean_inlier_ratio"),
        F.avg(F.when(made, F.col("confidence"))).alias("mean_confidence"),
    )


def crop_summary(summary: DataFrame) -> DataFrame:
    """Means of the per-reference figures by crop type (references weigh equally)."""
    return summary.groupBy("crop_type").agg(
        F.count(F.lit(1)).alias("reference_count"),
        *[F.avg(c).alias(c) for c in ("accepted_rate", "mean_correspondences", "mean_inlier_ratio")],
    )


def stage_outcomes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stage", "outcome").count()


def latency_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return value_statistics(rows, by, value, LATENCY_PROBS)


def root_cause(method: Column) -> Column:
    """Why the produced result differs from the diagnosis of the chosen method."""
    chosen = selected_accepted(method)
    late = (method != "dinov2") & (F.col("outcome") == "timeout")
    return (
        F.when(F.col("produced") == chosen, "consistent")
        .when(~F.col("reference_active"), "inactive_reference")
        .when((method == "dinov2") & F.col("hybrid_accepted"), "service_used_dinov2_config")
        .when(chosen & late, "local_refinement_timeout")
        .when(chosen, "service_result_missing_unknown")
        .otherwise("geometry_rejected_after_diagnostic")
    )


def selected_accepted(method: Column) -> Column:
    return (
        F.when(method == "hybrid", F.col("hybrid_accepted"))
        .when(method == "aliked_lightglue", F.col("local_accepted"))
        .otherwise(F.col("accepted"))
    )


def final_rejection(cause: Column, diagnosed: Column) -> Column:
    return (
        F.when(F.col("produced"), None)
        .when(cause == "local_refinement_timeout", "timeout")
        .when(cause == "inactive_reference", "inactive_reference")
        .otherwise(diagnosed)
    )


def service_consistency(rows: DataFrame) -> DataFrame:
    """Accepted rows per method, produced results, timeouts, and counts of each root cause."""
    causes = (
        "consistent", "inactive_reference", "service_used_dinov2_config", "local_refinement_timeout",
        "service_result_missing_unknown", "geometry_rejected_after_diagnostic",
    )
    return rows.agg(
        count_if(F.col("accepted")).alias("dinov2_accepted"), count_if(F.col("local_accepted")).alias("local_accepted"),
        count_if(F.col("hybrid_accepted")).alias("hybrid_accepted"),
        count_if(F.col("selected_accepted")).alias("selected_accepted"),
        count_if(F.col("produced")).alias("produced"),
        count_if((F.col("stage") != "dinov2") & (F.col("outcome") == "timeout")).alias("timeout_pairs"),
        *[count_if(F.col("root_cause") == c).alias(c) for c in causes],
    )
