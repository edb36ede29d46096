"""Running values along an ordered axis, also for groups too large for one task.

An axis is a set of keys and a unique integer order. Groups within the size limit are plain
windows. If any group is larger, its rows are cut into chunks of about equal numbers of rows, whatever lies
between their order values: every chunk is one window group, chunk totals are carried over a table with
one row per chunk, and each chunk's rows add what was carried to them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.plans.groups import hot_groups
from flightframe.plans.settle import settle
from flightframe.policies import LIMITS

CHUNK = "_chunk"


@dataclass(frozen=True)
class Axis:
    keys: tuple[str, ...]
    order: str
    chunked: bool = False
    stored: bool = False

    def within(self, *more: str) -> "Axis":
        """The same order inside finer keys; chunks of the coarser keys stay valid."""
        return replace(self, keys=(*self.keys, *more))

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else list(self.keys)


def axis_of(
    df: DataFrame, keys: Sequence[str], order: str, rows: int | None = None
) -> tuple[DataFrame, Axis]:
    """Check group sizes and give ``df`` a chunk column if a group is above the limit. No chunk then has more
    than twice ``rows`` rows."""
    rows = LIMITS.window_rows if rows is None else rows
    keys = list(keys)
    hot = hot_groups(df, keys, rows)
    if hot is None:
        return df, Axis(tuple(keys), order)
    return _cut_by_rank(df, hot.withColumn("_pieces", F.ceil(F.col("group_rows") / F.lit(rows)).cast("int")), keys, order, rows), Axis(tuple(keys), order, chunked=True)


def _cut_by_rank(df: DataFrame, hot: DataFrame, keys: list[str], order: str, rows: int) -> DataFrame:
    """``df`` with the number of the chunk of each row. Sketches of the large groups give their quantiles, every
    row finds its place among them by halving, and chunks are counted; a sketch that was too coarse is taken anew."""
    pieces = hot.agg(F.max("_pieces")).first()[0]
    large = df.join(hot.select(*keys), keys, "left_semi").select(*keys, F.col(order).alias("_at"))
    steps = [1 << k for k in range((pieces - 1).bit_length() - 1, -1, -1)]
    accuracy = max(1000, 10 * pieces)
    while True:
        marks = large.groupBy(*keys).agg(F.percentile_approx("_at", [i / pieces for i in range(1, pieces)], accuracy).alias("_marks"))
        marks = settle(marks.join(hot.select(*keys, "_pieces"), keys))
        passed = lambda at, k: (k <= F.size("_marks")) & (F.get("_marks", k - 1) < F.col(at))
        place = lambda at: F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda k, s: F.when(F.coalesce(passed(at, k + s), F.lit(False)), k + s).otherwise(k))
        # A group of fewer pieces than the largest takes several quantiles together.
        chunk = lambda at: F.floor(place(at) * F.col("_pieces") / F.lit(pieces)).cast("long")
        fullest = large.join(marks, keys).groupBy(*keys, chunk("_at").alias(CHUNK)).count().agg(F.max("count")).first()[0]
        if fullest <= 2 * rows:
            return df.join(marks, keys, "left").withColumn(CHUNK, F.coalesce(chunk(order), F.lit(0)).cast("long")).drop("_marks", "_pieces")
        accuracy *= 10


def ranged_axis(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Axis]:
    """An axis over any sortable columns: chunks are the partitions of a stored range sort. Scans are meant to
    start from the stored rows."""
    stored = settle(
        df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id().cast("long"))
    )
    return stored.withColumn("_order", F.struct(*order)), Axis(tuple(keys), "_order", chunked=True, stored=True)


def scan(
    df: DataFrame,
    axis: Axis,
    *,
    before: Mapping[str, Column] | None = None,
    upto: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns along ``axis``.

    ``before``: the last non-null value strictly before the row; ``upto``: the last non-null
    value up to and including the row; ``sums``: the sum up to and including the row.
    """
    before, upto, sums = dict(before or {}), dict(upto or {}), dict(sums or {})
    carried = {**before, **upto}
    values = {f"_v_{name}": column for name, column in {**carried, **sums}.items()}
    staged = df.withColumns(values)
    if axis.chunked and not axis.stored:
        # Both branches below read the rows, so chained scans would double their work each time.
        staged = settle(staged)
    window = Window.partitionBy(*axis.parts).orderBy(axis.order) if axis.parts else Window.orderBy(axis.order)
    prior = window.rowsBetween(Window.unboundedPreceding, -1)
    current = window.rowsBetween(Window.unboundedPreceding, 0)
    running = {
        **{name: F.last(f"_v_{name}", ignorenulls=True).over(prior) for name in before},
        **{name: F.last(f"_v_{name}", ignorenulls=True).over(current) for name in upto},
        **{name: F.sum(f"_v_{name}").over(current) for name in sums},
    }
    local = staged.withColumns(running)
    if not axis.chunked:
        return local.drop(*values)

    edges = staged.groupBy(*axis.parts).agg(
        *[
            F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col(axis.order))).alias(f"_e_{name}")
            for name in carried
        ],
        *[F.sum(f"_v_{name}").alias(f"_e_{name}") for name in sums],
    )
    across = Window.partitionBy(*axis.keys) if axis.keys else Window.partitionBy(F.lit(0))
    earlier = across.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    heads = edges.select(
        *axis.parts,
        *[F.last(f"_e_{name}", ignorenulls=True).over(earlier).alias(f"_h_{name}") for name in carried],
        *[F.sum(f"_e_{name}").over(earlier).alias(f"_h_{name}") for name in sums],
    )
    joined = local.join(heads, axis.parts, "left")
    merged = {
        **{name: F.coalesce(F.col(name), F.col(f"_h_{name}")) for name in carried},
        **{
            name: F.when(F.col(f"_h_{name}").isNull(), F.col(name)).otherwise(
                F.coalesce(F.col(name), F.lit(0)) + F.col(f"_h_{name}")
            )
            for name in sums
        },
    }
    return joined.withColumns(merged).drop(*values, *[f"_h_{name}" for name in {**carried, **sums}])
