"""Threshold sweeps, and choosing from them.

A decision only sees a sample through comparisons with the tried thresholds. So samples are
counted once per cell between thresholds, cells are exploded to the thresholds they pass, and
the cost of a sweep depends on the grid, not on the number of samples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from flightframe.functions.labels import MOVING, STATIONARY, UNKNOWN
from flightframe.operators.metrics import COUNTS, outcome_counts, with_scores
from flightframe.plans.scans import CHUNK, ranged_axis, scan
from flightframe.plans.settle import settle
from flightframe.policies import BoxMotionPolicy

# The tried thresholds.
STATIONARY_GRID = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0)
MOVING_GRID = (4.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0)
IOU_GRID = (0.0, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50)
SCORE_GRID = (0.0, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65)
MIN_SIZE_GRID = (0.40, 0.50, 0.60, 0.70)
MAX_SIZE_GRID = (1.5, 2.0, 2.5)
SENSITIVITY_STATIONARY = (2.0, 3.0, 4.0, 5.0)
SENSITIVITY_MOVING = (6.0, 8.0, 10.0, 12.0)
SENSITIVITY_IOU = (0.1, 0.2, 0.3, 0.5)
SENSITIVITY_SCORE = (0.25, 0.35, 0.5)
SCENE_FACTORS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
RATIO_FACTORS = (0.25, 0.5, 1.0, 1.5)
CONFIG = (
    "stationary_threshold", "moving_threshold", "min_iou", "min_association_score", "min_size_ratio", "max_size_ratio",
)


@dataclass(frozen=True)
class Gate:
    """``column op threshold`` must hold; ``name`` is the swept parameter."""

    name: str
    column: str
    op: str
    thresholds: tuple[float, ...]

    def passed(self) -> Column:
        tried = F.array(*[F.lit(t) for t in self.thresholds])
        value = F.col(self.column)
        return F.filter(tried, (lambda t: t <= value) if self.op == ">=" else (lambda t: value <= t))


BOX_GATES = (
    Gate("min_iou", "iou", ">=", IOU_GRID),
    Gate("min_association_score", "score", ">=", SCORE_GRID),
    Gate("min_size_ratio", "size_ratio", ">=", MIN_SIZE_GRID),
    Gate("max_size_ratio", "size_ratio", "<=", MAX_SIZE_GRID),
)


def _cell(value: Column, thresholds: Sequence[float]) -> Column:
    tried = F.array(*[F.lit(t) for t in sorted(set(thresholds))])
    return F.size(F.filter(tried, lambda t: t <= value)) + F.size(F.filter(tried, lambda t: t < value))


def gate_counts(samples: DataFrame, keep: Sequence[str], gates: Sequence[Gate], more: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Rows passing every combination of gate thresholds, as ``n`` per ``keep`` and parameters.

    ``more`` names further columns that stay comparable with their thresholds (as a value of
    the same cell). Combinations nothing passes have no row.
    """
    by_column: dict[str, list[float]] = {}
    for gate in gates:
        by_column.setdefault(gate.column, []).extend(gate.thresholds)
    for column, thresholds in (more or {}).items():
        by_column.setdefault(column, []).extend(thresholds)
    cells = {f"_c_{column}": _cell(F.col(column), thresholds) for column, thresholds in by_column.items()}
    counted = samples.withColumns(cells).groupBy(*keep, *cells).agg(
        F.count(F.lit(1)).alias("n"), *[F.min(column).alias(column) for column in by_column]
    )
    held = [*keep]
    waiting = list(gates)
    while waiting:
        gate = waiting.pop(0)
        still = {g.column for g in waiting} | set(more or {})
        rest = [c for c in by_column if c in still]
        counted = (
            counted.withColumn(gate.name, F.explode(gate.passed()))
            .groupBy(*held, gate.name, *[f"_c_{c}" for c in rest])
            .agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in rest])
        )
        held.append(gate.name)
    return counted.drop(*cells)


def config_grid(
    spark: SparkSession,
    stationary: Sequence[float] = STATIONARY_GRID,
    moving: Sequence[float] = MOVING_GRID,
    gates: Sequence[Gate] = BOX_GATES,
) -> DataFrame:
    """All configurations with stationary < moving; ``config_id`` counts them in nested order."""
    pairs = [(s, m) for s in stationary for m in moving if s < m]
    both = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for s, m in pairs])
    grid = spark.range(1).select(F.posexplode(both).alias("config_id", "p")).select(
        F.col("config_id").cast("long"), F.col("p.s").alias("stationary_threshold"), F.col("p.m").alias("moving_threshold")
    )
    for gate in gates:
        tried = F.array(*[F.lit(t) for t in gate.thresholds])
        grid = grid.select("*", F.posexplode(tried).alias("_i", gate.name)).withColumn(
            "config_id", F.col("config_id") * len(gate.thresholds) + F.col("_i")
        ).drop("_i")
    return grid


def band_sweep(
    samples: DataFrame,
    truth: str,
    residual: str,
    usable: Column,
    stationary: Sequence[float],
    moving: Sequence[float],
    gates: Sequence[Gate] = (),
) -> DataFrame:
    """Scores of every configuration: residual up to the lower threshold is stationary, from the
    upper one moving, between them and for unusable or gated rows unknown."""
    names = [gate.name for gate in gates]
    known = F.col(residual).isNotNull()
    for gate in gates:
        known = known & F.col(gate.column).isNotNull()
    decided = samples.where(usable & known & F.col(truth).isin(MOVING, STATIONARY))
    passed = settle(gate_counts(decided, [truth], gates, {residual: [*stationary, *moving]}))
    hits = lambda label: F.coalesce(F.sum(F.when(F.col(truth) == label, F.col("n"))), F.lit(0))

    def side(gate: Gate, moving_name: str, stationary_name: str) -> DataFrame:
        return passed.withColumn(gate.name, F.explode(gate.passed())).groupBy(*names, gate.name).agg(
            hits(MOVING).alias(moving_name), hits(STATIONARY).alias(stationary_name)
        )

    low = side(Gate("stationary_threshold", residual, "<=", tuple(stationary)), "false_stationary", "true_stationary")
    high = side(Gate("moving_threshold", residual, ">=", tuple(moving)), "true_moving", "false_moving")
    totals = samples.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col(truth) == MOVING, 1)).alias("moving_gt"),
        F.count(F.when(F.col(truth) == STATIONARY, 1)).alias("stationary_gt"),
    ).first()
    grid = config_grid(samples.sparkSession, stationary, moving, gates)
    zero = {name: F.coalesce(F.col(name), F.lit(0)) for name in ("true_moving", "false_moving", "true_stationary", "false_stationary")}
    counts = (
        grid.join(low, [*names, "stationary_threshold"], "left")
        .join(high, [*names, "moving_threshold"], "left")
        .withColumns(zero)
        .withColumns({name: F.lit(totals[name]) for name in ("total", "moving_gt", "stationary_gt")})
        .withColumn("moving_pred", F.col("true_moving") + F.col("false_moving"))
        .withColumn("stationary_pred", F.col("true_stationary") + F.col("false_stationary"))
        .withColumn("unknown_pred", F.col("total") - F.col("moving_pred") - F.col("stationary_pred"))
    )
    return with_scores(counts.select("config_id", "stationary_threshold", "moving_threshold", *names, *COUNTS))


def replayable(sample_valid: str = "homography_valid", edges: Sequence[str] = ("frame_edge", "projected_edge")) -> Column:
    good = F.col(sample_valid)
    for edge in edges:
        good = good & ~F.col(edge)
    return good


def box_decision(config: dict[str, Column] | None = None) -> Column:
    """The decision for one sample row under the configuration columns of the same row."""
    c = config or {name: F.col(name) for name in CONFIG}
    values = [F.col(n) for n in ("residual", "iou", "score", "size_ratio")]
    missing = values[0].isNull() | values[1].isNull() | values[2].isNull() | values[3].isNull()
    residual, overlap, score, size = values
    return (
        F.when(~replayable() | missing, UNKNOWN)
        .when(
            (overlap < c["min_iou"]) | (score < c["min_association_score"])
            | (size < c["min_size_ratio"]) | (size > c["max_size_ratio"]),
            UNKNOWN,
        )
        .when((residual <= c["stationary_threshold"]) & (overlap >= c["min_iou"]), STATIONARY)
        .when(residual >= c["moving_threshold"], MOVING)
        .otherwise(UNKNOWN)
    )


def replay_supported(policy: BoxMotionPolicy = BoxMotionPolicy()) -> Column:
    """Only gates at least as strict as those the data was collected with can be replayed."""
    return (
        (F.col("min_iou") >= policy.match_min_iou) & (F.col("min_association_score") >= policy.match_min_score)
        & (F.col("min_size_ratio") >= policy.min_size_ratio) & (F.col("max_size_ratio") <= policy.max_size_ratio)
    )


def threshold_sweep(samples: DataFrame, policy: BoxMotionPolicy = BoxMotionPolicy()) -> DataFrame:
    """The full box grid over ``gt, residual, iou, score, size_ratio`` and the validity flags."""
    swept = band_sweep(samples, "gt", "residual", replayable(), STATIONARY_GRID, MOVING_GRID, BOX_GATES)
    return swept.withColumn("replay_supported", replay_supported(policy))


def _with_configs(samples: DataFrame, configs: DataFrame) -> DataFrame:
    """Every sample under each configuration, which is the evaluation asked for."""
    return samples.crossJoin(configs)


def evaluate_configs(samples: DataFrame, configs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Direct evaluation of a few configurations (literal rows), for checks and profiles."""
    tried = _with_configs(samples, configs).withColumn("prediction", box_decision())
    return with_scores(tried.groupBy(*by).agg(*outcome_counts(F.col("gt"), F.col("prediction"))))


def scene_sweep(scenes: DataFrame, medians: Sequence[float], p90s: Sequence[float], spreads: Sequence[float], ratios: Sequence[float]) -> DataFrame:
    """Scene thresholds choose which of two answers counts; rows whose scene is unreliable are
    unknown."""
    solid = scenes.where(
        F.col("homography_valid") & F.col("quality_level").isNotNull() & ~F.col("quality_level").isin("", "low")
    ).select(
        "gt", "homography_result", "homography_bbox_result",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("background_ratio", "background_median", "background_p90", "grid_spread")],
    )
    keep = ["gt", "homography_result", "homography_bbox_result"]
    ratio = Gate("min_valid_background_ratio", "background_ratio", ">=", tuple(ratios))
    calm = (
        Gate("background_median_max", "background_median", "<=", tuple(medians)),
        Gate("background_p90_max", "background_p90", "<=", tuple(p90s)),
        Gate("grid_spread_max", "grid_spread", "<=", tuple(spreads)),
    )
    reliable = settle(gate_counts(solid, keep, [ratio]))
    low = settle(gate_counts(solid, keep, [ratio, *calm]))
    params = [g.name for g in (*calm, ratio)]
    grid = scenes.sparkSession.range(1).select(F.lit(0).alias("_z"))
    for gate in (*calm, ratio):
        grid = grid.withColumn(gate.name, F.explode(F.array(*[F.lit(t) for t in gate.thresholds])))
    grid = grid.drop("_z")
    # Reliable rows answer by box unless the scene is calm; calm rows swap that for the other answer.
    per_config = grid.join(
        reliable.select(ratio.name, *keep, "n", F.lit(False).alias("calm")), [ratio.name], "left"
    ).select(*params, *keep, "n", "calm")
    swapped = low.select(*params, *keep, "n", F.lit(True).alias("calm"))
    rows = per_config.unionByName(swapped)
    amount = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    is_calm = F.col("calm")

    def answered(gt: str, label: str) -> Column:
        truth = F.col("gt") == gt
        by_box = truth & (F.col("homography_bbox_result") == label)
        by_flow = truth & (F.col("homography_result") == label)
        return amount(~is_calm & by_box) - amount(is_calm & by_box) + amount(is_calm & by_flow)

    counts = rows.groupBy(*params).agg(
        answered(MOVING, MOVING).alias("tp_m"), answered(STATIONARY, MOVING).alias("false_moving"),
        answered(STATIONARY, STATIONARY).alias("tp_s"), answered(MOVING, STATIONARY).alias("false_stationary"),
        amount(is_calm).alias("homography_selected"),
        (amount(~is_calm) - amount(is_calm)).alias("homography_bbox_selected"),
    )
    totals = scenes.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gt") == MOVING, 1)).alias("m"),
        F.count(F.when(F.col("gt") == STATIONARY, 1)).alias("s"),
    ).first()
    share = lambda tp, fp, all_: F.when(tp + fp + all_ == 0, 0.0).otherwise(2 * tp / (tp + fp + all_))
    decided = F.col("tp_m") + F.col("false_moving") + F.col("tp_s") + F.col("false_stationary")
    whole = F.lit(float(max(totals["n"], 1)))
    return counts.select(
        *params,
        share(F.col("tp_m"), F.col("false_moving"), F.lit(totals["m"])).alias("moving_f1"),
        share(F.col("tp_s"), F.col("false_stationary"), F.lit(totals["s"])).alias("stationary_f1"),
        ((F.col("tp_m") + F.col("tp_s")) / whole).alias("strict_accuracy"),
        (decided / whole).alias("coverage"), (F.lit(totals["n"]) - decided).alias("unknown"),
        "false_moving", "false_stationary", "homography_selected", "homography_bbox_selected",
        (F.lit(totals["n"]) - F.col("homography_selected") - F.col("homography_bbox_selected")).alias("unknown_selected"),
    ).withColumn("macro_f1", (F.col("moving_f1") + F.col("stationary_f1")) / 2)


def _ranked_pool(sweep: DataFrame) -> DataFrame:
    supported = sweep.where("replay_supported")
    return sweep if supported.isEmpty() else supported


def leaderboards(sweep: DataFrame, k: int = 10) -> DataFrame:
    """Ten named orders, the first ``k`` of each; ties go to the earlier configuration."""
    col = F.col
    down = lambda *names: [-col(n) for n in names]
    always = F.lit(True)
    boards = [
        ("highest_macro_f1", always, down("macro_f1", "balanced_accuracy", "coverage")),
        ("highest_balanced_accuracy", always, down("balanced_accuracy", "macro_f1", "coverage")),
        ("highest_stationary_f1", always, down("stationary_f1", "macro_f1", "coverage")),
        ("highest_moving_f1", always, down("moving_f1", "macro_f1", "coverage")),
        *[
            (f"macro_f1_coverage_0{int(c * 100)}", col("coverage") >= c, down("macro_f1", "coverage", "balanced_accuracy"))
            for c in (0.50, 0.60, 0.70, 0.80)
        ],
        (
            "lowest_false_moving_recall070_coverage060", (col("moving_recall") >= 0.70) & (col("coverage") >= 0.60),
            [col("false_moving").cast("double"), *down("macro_f1", "coverage")],
        ),
        (
            "conservative_false_stationary_zero", col("false_stationary") == 0,
            down("macro_f1", "coverage", "moving_recall"),
        ),
    ]
    entries = F.array(
        *[
            F.when(test, F.struct(F.lit(name).alias("leaderboard"), F.array(*[o.cast("double") for o in order]).alias("o")))
            for name, test, order in boards
        ]
    )
    pool = _ranked_pool(sweep)
    listed = pool.select("*", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_b"))
    first = Window.partitionBy("_b.leaderboard").orderBy("_b.o", "config_id")
    return (
        listed.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        .select(F.col("_b.leaderboard").alias("leaderboard"), "rank", *sweep.columns)
    )


def select_profiles(sweep: DataFrame) -> DataFrame:
    """Balanced, Conservative and High Coverage configurations, in one pass over the sweep."""
    pool = _ranked_pool(sweep)
    row = F.struct(*sweep.columns)
    col = F.col
    key = lambda *parts: F.struct(*[p.cast("double").alias(f"k{i}") for i, p in enumerate(parts)], (-col("config_id")).alias("id"))
    best = lambda test, *parts: F.max_by(row, F.when(test, key(*parts)))
    cautious = (col("false_stationary") == 0) & (col("moving_recall") >= 0.50) & (col("coverage") >= 0.40)
    balanced = (col("macro_f1"), col("balanced_accuracy"), col("coverage"))
    picked = pool.agg(
        F.coalesce(best(col("coverage") >= 0.50, *balanced), best(F.lit(True), *balanced)).alias("Balanced"),
        F.coalesce(
            best(cautious, -col("false_moving"), col("macro_f1"), col("coverage")),
            best(F.lit(True), col("macro_f1"), -col("false_moving")),
        ).alias("Conservative"),
        best(F.lit(True), col("coverage"), col("macro_f1"), col("balanced_accuracy")).alias("High Coverage"),
    )
    long = picked.unpivot([], ["Balanced", "Conservative", "High Coverage"], "profile", "row")
    return long.where(F.col("row").isNotNull()).select("profile", "row.*")


_GOALS = ("macro_f1", "coverage", "false_moving", "false_stationary")


def pareto_frontier(sweep: DataFrame) -> DataFrame:
    """Configurations no other one beats on two scores and two error counts; equal ones are kept
    once, the earliest.

    Batches first drop what their own rows beat. The rest is dealt into 256 cells by the quartiles of the four goals. A
    cell whose best corner is beaten by the worst corner of another is ruled out whole; the rows of the others are
    compared, in blocks, with those cells only that reach below their worst corner.
    """
    unique = sweep.groupBy(*_GOALS).agg(F.min_by(F.struct(*sweep.columns), "config_id").alias("row"))
    # With equal counts and coverage only the best score can stay, and the other way round.
    unique = unique.groupBy("coverage", "false_moving", "false_stationary").agg(
        F.max("macro_f1").alias("macro_f1"), F.max_by("row", "macro_f1").alias("row")
    )
    unique = unique.groupBy("macro_f1", "false_moving", "false_stationary").agg(
        F.max("coverage").alias("coverage"), F.max_by("row", "coverage").alias("row")
    )
    slim = unique.select(*[F.col(g).cast("double").alias(g) for g in _GOALS], F.col("row.config_id").alias("config_id"))
    local = settle(slim.mapInPandas(_own_frontier, slim.schema))
    quartiles = local.agg(*[F.percentile_approx(g, [0.25, 0.5, 0.75], 1000).alias(g) for g in _GOALS]).first()
    place = F.lit(0)
    for goal in _GOALS:
        place = place * 4 + sum((F.when(F.col(goal) > cut, 1).otherwise(0) for cut in quartiles[goal] or ()), F.lit(0))
    celled = local.withColumn("cell", place.cast("int"))
    costs = [F.col(g) * s for g, s in zip(_GOALS, _SIGNS)]
    cells = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in costs]).alias("best"), F.array(*[F.max(c) for c in costs]).alias("worst")).collect()
    met = _facing_cells(cells)
    spark = sweep.sparkSession
    sizes = spark.createDataFrame([(c.cell, -(-c.n // _CELL_ROWS)) for c in cells], "cell int, blocks long")
    dealt = celled.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("config_id"), F.col("blocks")))
    packed = settle(dealt.groupBy("cell", "block").agg(F.flatten(F.collect_list(F.array(*costs))).alias("costs"), F.collect_list("config_id").alias("ids")))
    side = lambda p: packed.select(*[F.col(c).alias(f"{p}_{c}") for c in packed.columns])
    facing = spark.createDataFrame(met, "own_cell int, other_cell int")
    beaten = facing.join(side("own"), "own_cell").join(side("other").drop("other_ids"), "other_cell").select("own_costs", "own_ids", "other_costs").mapInPandas(_beaten, "config_id long")
    return sweep.join(celled.select("config_id").join(beaten.distinct(), "config_id", "left_anti"), "config_id", "left_semi")


_SIGNS, _CELL_ROWS = (-1.0, -1.0, 1.0, 1.0), 2048


def _facing_cells(cells: Sequence[Row]) -> list[tuple[int, int]]:
    """(cell, other) of the at most 256 cells: those not ruled out, each with the ones that may beat rows of it."""
    best, worst = (np.array([c[k] for c in cells], float).reshape(-1, len(_GOALS)) for k in ("best", "worst"))
    out = [
        ((worst <= own).all(1) & (worst < own).any(1)).any() for own in best
    ]
    pairs = []
    for i, cell in enumerate(cells):
        if out[i]:
            pairs.append((cell.cell, next(c.cell for c, w in zip(cells, worst) if (w <= best[i]).all() and (w < best[i]).any())))
            continue
        pairs += [(cell.cell, c.cell) for j, c in enumerate(cells) if not out[j] and (best[j] <= worst[i]).all()]
    return pairs


def _beaten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            own, other = (np.asarray(c, float).reshape(-1, len(_GOALS)) for c in (row.own_costs, row.other_costs))
            hit = np.zeros(len(own), bool)
            for low in range(0, len(own), 256):
                part = own[low : low + 256, None, :]
                hit[low : low + 256] = ((other[None] <= part).all(2) & (other[None] < part).any(2)).any(1)
            yield pd.DataFrame({"config_id": np.asarray(row.own_ids)[hit]})


def _own_frontier(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each batch that no row of the same batch beats."""
    for batch in batches:
        goals = batch[list(_GOALS)].to_numpy() * np.array(_SIGNS)
        order = np.lexsort(goals.T[::-1])
        kept: list[int] = []
        for i in order:
            front = goals[kept]
            if not len(kept) or not ((front <= goals[i]).all(axis=1) & (front < goals[i]).any(axis=1)).any():
                kept.append(i)
        yield batch.iloc[sorted(kept)]


# The metrics the sensitivity report averages.
SENSITIVITY_METRICS = (
    "stationary_recall", "false_stationary", "coverage", "false_moving", "moving_recall",
    "unknown_rate", "moving_precision", "stationary_precision", "macro_f1",
)


def parameter_sensitivity(sweep: DataFrame) -> DataFrame:
    """Mean metrics per value of each parameter, over all and over replayable configurations."""
    settings = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value")) for p in CONFIG])
    scopes = F.when(F.col("replay_supported"), F.array(F.lit("all_grid"), F.lit("replay_supported"))).otherwise(
        F.array(F.lit("all_grid"))
    )
    long = sweep.withColumn("scope", F.explode(scopes)).withColumn("_s", F.explode(settings))
    return long.groupBy("scope", "_s.parameter", "_s.value").agg(
        F.count(F.lit(1)).alias("config_count"), *[F.avg(m).alias(f"mean_{m}") for m in SENSITIVITY_METRICS]
    )


def group_folds(samples: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Fold of every group: round robin over the sorted distinct groups."""
    groups = settle(samples.select(group).distinct())
    count = groups.count()
    if count < 2:
        raise ValueError("at least two groups are required")
    k = min(max(2, folds), count)
    ordered, axis = ranged_axis(groups, [], [group])
    numbered = scan(ordered, axis, sums={"_n": F.lit(1)})
    return numbered.select(group, ((F.col("_n") - 1) % k + 1).cast("int").alias("fold"))


def cross_validate(
    samples: DataFrame, profiles: DataFrame, group: str = "pair_id", folds: int = 5
) -> DataFrame:
    """Train and validation scores per profile and fold. Counts are made once per fold; the
    training side is the total minus the fold, so no sample is copied per fold."""
    assigned = samples.join(group_folds(samples, group, folds), group)
    decided = _with_configs(assigned, profiles.select("profile", *CONFIG)).withColumn("prediction", box_decision())
    counts = settle(
        decided.groupBy("profile", "fold").agg(*outcome_counts(F.col("gt"), F.col("prediction")))
    )
    every = Window.partitionBy("profile")
    train = counts.select(
        "profile", "fold", F.lit("train").alias("split"), *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in COUNTS]
    )
    validation = counts.select("profile", "fold", F.lit("validation").alias("split"), *COUNTS)
    return with_scores(train.unionByName(validation))


def cross_validation_summary(validated: DataFrame) -> DataFrame:
    held = validated.where(F.col("split") == "validation")
    shown = ("macro_f1", "coverage", "stationary_f1", "moving_f1")
    return held.groupBy("profile").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in shown], *[F.stddev_pop(m).alias(f"{m}_std") for m in shown]
    )


def best_rows(sweep: DataFrame, coverages: Sequence[float] = (0.70, 0.80), k: int = 5) -> DataFrame:
    """The top ``k`` by macro F1, and the best one at each minimum coverage."""
    order = [F.desc("macro_f1"), F.desc("balanced_accuracy"), F.desc("coverage"), F.asc("config_id")]
    top = sweep.orderBy(*order).limit(k).withColumn("choice", F.lit("top"))
    for minimum in coverages:
        best = sweep.where(F.col("coverage") >= minimum).orderBy(*order).limit(1)
        top = top.unionByName(best.withColumn("choice", F.lit(f"coverage_{minimum:.2f}")))
    return top


def top_errors(samples: DataFrame, group: str, n: int = 20, key: str = "gt_index") -> DataFrame:
    """The ``n`` largest residuals of an outcome group per method."""
    score = F.coalesce(
        F.greatest("local_corrected_residual", "flow_residual", "bbox_center_residual"), F.lit(float("-inf"))
    )
    picked = samples.where(F.col("group") == group).withColumn("score", score)
    first = Window.partitionBy("method").orderBy(F.desc("score"), F.asc(key))
    return picked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def most_ambiguous(samples: DataFrame, n: int = 100, key: str = "gt_index") -> DataFrame:
    """Unknown answers nearest to 4 px; a missing residual and a zero both count as 4 px."""
    value = F.coalesce(F.nullif(F.col("local_corrected_residual"), F.lit(0.0)), F.lit(4.0))
    picked = samples.where(F.col("group") == "unknown").withColumn("distance", F.abs(value - 4.0))
    return picked.orderBy("distance", "method", key).limit(n)
