"""Best-first choices inside groups: one-to-one pairs, and items that exclude each other.

Small groups are folded over a sorted array. Groups above the size limit are solved by rounds of
joins and combined aggregates that give the same result under the same strict order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.plans.groups import hot_groups, split_hot
from flightframe.plans.settle import settle
from flightframe.policies import LIMITS


def greedy_one_to_one(
    candidates: DataFrame,
    group: Sequence[str],
    left: str,
    right: str,
    score: str,
    rows: int | None = None,
    settled: bool = False,
) -> DataFrame:
    """Take the best remaining pair until none is left; order is (-score, left, right). ``settled`` candidates
    are read where they are kept."""
    rows = LIMITS.fold_rows if rows is None else rows
    group = list(group)
    slim = candidates.select(*group, left, right, score)
    slim = slim if settled else settle(slim)
    hot = hot_groups(slim, group, rows)
    if hot is None:
        return _pair_fold(slim, group, left, right, score)
    small, large = split_hot(slim, hot, group)
    return _pair_fold(small, group, left, right, score).unionByName(_pair_rounds(large, group, left, right, score))


def _pair_fold(rows: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    entry = F.struct((-F.col(score)).alias("o"), F.col(left).alias("l"), F.col(right).alias("r"))
    lists = rows.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    taken = lambda acc, e: F.exists(acc, lambda t: (t["l"] == e["l"]) | (t["r"] == e["r"]))
    step = lambda acc, e: F.when(taken(acc, e), acc).otherwise(F.concat(acc, F.array(e)))
    chosen = F.aggregate("c", F.slice("c", 1, 0), step)
    return lists.select(*group, F.inline(chosen)).select(
        *group, F.col("l").alias(left), F.col("r").alias(right), (-F.col("o")).alias(score)
    )


def _pair_rounds(rows: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    entry = F.struct((-F.col(score)).alias("o"), F.col(left).alias("l"), F.col(right).alias("r"))
    open_pairs, done = settle(rows), None
    while not open_pairs.isEmpty():
        by_left = open_pairs.groupBy(*group, left).agg(F.min(entry).alias("best"))
        by_right = open_pairs.groupBy(*group, right).agg(F.min(entry).alias("best_right"))
        mutual = (
            by_left.withColumn(right, F.col("best.r"))
            .join(by_right, [*group, right])
            .where(F.col("best") == F.col("best_right"))
            .select(*group, left, right, (-F.col("best.o")).alias(score))
        )
        mutual = settle(mutual)
        done = mutual if done is None else done.unionByName(mutual)
        open_pairs = settle(
            open_pairs.join(mutual.select(*group, left), [*group, left], "left_anti").join(
                mutual.select(*group, right), [*group, right], "left_anti"
            )
        )
    return rows.limit(0).select(*group, left, right, score) if done is None else done


def keep_best(
    items: DataFrame,
    group: Sequence[str],
    item: str,
    rank: Column,
    clash: Callable[[Column, Column], Column],
    fields: Sequence[str],
    clashes: Callable[[DataFrame], DataFrame],
    rows: int | None = None,
) -> DataFrame:
    """Go through a group in ``rank`` order and keep an item unless it clashes with a kept one.

    ``clash(a, b)`` compares two structs of ``fields``. ``clashes(items)`` gives the clashing
    pairs of large groups as (group, a, b) by item id, in any direction.
    """
    rows = LIMITS.fold_rows if rows is None else rows
    group, fields = list(group), list(fields)
    slim = items.select(*group, item, *[f for f in fields if f != item], rank.alias("_rank"))
    hot = hot_groups(slim, group, rows)
    if hot is None:
        return _keep_fold(slim, group, item, clash, fields)
    small, large = split_hot(slim, hot, group)
    return _keep_fold(small, group, item, clash, fields).unionByName(
        _keep_rounds(settle(large), group, item, clashes)
    )


def _keep_fold(rows: DataFrame, group: list[str], item: str, clash, fields: list[str]) -> DataFrame:
    entry = F.struct("_rank", F.col(item).alias("_item"), F.struct(*fields).alias("v"))
    lists = rows.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    beaten = lambda acc, e: F.exists(acc, lambda k: clash(k["v"], e["v"]))
    step = lambda acc, e: F.when(beaten(acc, e), acc).otherwise(F.concat(acc, F.array(e)))
    kept = F.aggregate("c", F.slice("c", 1, 0), step)
    return lists.select(*group, F.explode(kept).alias("e")).select(*group, F.col("e._item").alias(item))


def _keep_rounds(rows: DataFrame, group: list[str], item: str, clashes) -> DataFrame:
    key = [*group, item]
    pairs = clashes(rows).select(*group, "a", "b")
    ranks = rows.select(*group, F.col(item).alias("a"), F.struct("_rank", item).alias("ra"))
    other = rows.select(*group, F.col(item).alias("b"), F.struct("_rank", item).alias("rb"))
    better = settle(
        pairs.join(ranks, [*group, "a"]).join(other, [*group, "b"]).where(F.col("ra") < F.col("rb"))
        .select(*group, "a", "b").distinct()
    )
    undecided, kept = rows.select(*key), None
    while not undecided.isEmpty():
        # An undecided item is kept once no better undecided item clashes with it.
        blocked = better.join(
            undecided.withColumnRenamed(item, "a"), [*group, "a"], "left_semi"
        ).select(*group, F.col("b").alias(item))
        chosen = settle(undecided.join(blocked, key, "left_anti"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        beaten = better.join(chosen.withColumnRenamed(item, "a"), [*group, "a"], "left_semi").select(
            *group, F.col("b").alias(item)
        )
        undecided = settle(undecided.join(chosen, key, "left_anti").join(beaten, key, "left_anti"))
    return rows.select(*key).limit(0) if kept is None else kept
