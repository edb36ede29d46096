"""Exact grouped percentiles (linear interpolation between neighbours).

Groups within the size limit use the built-in exact aggregate, which holds a group's distinct
values in one task. Larger groups never meet in one task: the interval that holds the wanted
rank is narrowed by counted passes until few enough rows are left in it to sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.plans.groups import hot_groups, split_hot
from flightframe.plans.settle import settle
from flightframe.policies import LIMITS

_CELLS = 1024


def grouped_percentiles(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, Column],
    probs: Sequence[float],
    rows: int | None = None,
    copies: Column | None = None,
) -> DataFrame:
    """One row per group: ``<name>`` is the array of percentiles of each named value. Values
    counted beforehand come with ``copies``."""
    rows = LIMITS.percentile_rows if rows is None else rows
    by = list(by)
    weight = F.lit(1).cast("long") if copies is None else copies
    data = df.select(*by, weight.alias("_w"), *[column.alias(name) for name, column in values.items()])
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    plain = lambda part: part.groupBy(*by).agg(*[F.percentile(name, wanted, *([] if copies is None else [F.col("_w")])).alias(name) for name in values])
    hot = hot_groups(data, by, rows)
    if hot is None:
        return plain(data)
    small, large = split_hot(data, hot, by)
    long = large.select(
        *by, "_w", F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in values])).alias("_e")
    ).select(*by, "_w", "_e.item", "_e.value").where(F.col("value").isNotNull())
    ranked = _ranked_values(long, [*by, "item"], probs, rows)
    wide = ranked.groupBy(*by).agg(
        *[F.max(F.when(F.col("item") == n, F.col("percentiles"))).alias(n) for n in values]
    )
    return plain(small).unionByName(wide.select(*by, *values))


def _ranked_values(data: DataFrame, by: list[str], probs: Sequence[float], rows: int) -> DataFrame:
    sizes = data.groupBy(*by).agg(
        F.sum("_w").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    position = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(
        F.flatten(
            F.array(*[F.array(F.floor(position(p)).cast("long"), F.ceil(position(p)).cast("long")) for p in probs])
        )
    )
    sizes = settle(sizes)
    targets = sizes.select(
        *by, F.explode(ranks).alias("rank"), "low", "high",
        F.lit(0).cast("long").alias("below"), F.col("n").alias("held"),
    )
    while True:
        targets = settle(targets)
        wide = targets.where((F.col("held") > rows) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        done = targets.where((F.col("held") <= rows) | (F.col("low") >= F.col("high")))
        cell = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * _CELLS)
        counted = (
            data.join(wide, by)
            .where(F.col("value").between(F.col("low"), F.col("high")))
            .withColumn("cell", cell)
            .groupBy(*by, "rank", "below", "cell")
            .agg(
                F.sum("_w").alias("inside"),
                F.min("value").alias("low"),
                F.max("value").alias("high"),
            )
        )
        upto = Window.partitionBy(*by, "rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        narrowed = (
            counted.withColumn("through", F.col("below") + F.sum("inside").over(upto))
            .where((F.col("rank") < F.col("through")) & (F.col("rank") >= F.col("through") - F.col("inside")))
            .select(
                *by, "rank", "low", "high",
                (F.col("through") - F.col("inside")).alias("below"), F.col("inside").alias("held"),
            )
        )
        targets = done.unionByName(narrowed)
    counted = (
        data.join(targets, by)
        .where(F.col("value").between(F.col("low"), F.col("high")))
        .groupBy(*by, "rank", "below", "value")
        .agg(F.sum("_w").alias("copies"))
    )
    upto = Window.partitionBy(*by, "rank").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counted.withColumn("through", F.col("below") + F.sum("copies").over(upto))
        .where((F.col("rank") < F.col("through")) & (F.col("rank") >= F.col("through") - F.col("copies")))
        .groupBy(*by)
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
        .join(sizes.select(*by, "n"), by)
    )
    def interpolated(p: float) -> Column:
        low, high = F.floor(position(p)).cast("long"), F.ceil(position(p)).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        exact = F.when(low == high, a).otherwise((high - position(p)) * a + (position(p) - low) * b)
        return F.when(a == b, a).otherwise(exact)

    return found.select(*by, F.array(*[interpolated(p) for p in probs]).alias("percentiles"))
