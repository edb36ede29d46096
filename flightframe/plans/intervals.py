"""Points joined with the intervals that hold them, by equality.

An interval is cut into the fewest aligned ranges whose lengths are powers of two, at most two per length. A
point lies in one range of each length, and in at most one of an interval's, so looking its ranges
up finds every interval once, however many there are. Numbers are counted between the outermost bounds of the
intervals, what lies beyond shares the ends, and open ends reach there, so the lengths are as many as these bounds ask for. An
interval open on both sides holds every point, also an unknown one, and has a range of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.plans.settle import settle

_FAR = 1 << 61
ALWAYS = -1
_RANGE = "array<struct<level:int,node:bigint>>"


def _clamped(value: Column) -> Column:
    """Whole numbers; the outermost ones share the ends."""
    return F.greatest(F.lit(-_FAR), F.least(value.cast("long"), F.lit(_FAR - 1)))


@dataclass(frozen=True)
class Span:
    """The numbers that bounds of intervals lie between, with one more at each end for all that is beyond."""

    low: int = -_FAR
    high: int = _FAR - 1

    @property
    def bits(self) -> int:
        return (self.high - self.low + 2).bit_length()

    def placed(self, value: Column) -> Column:
        """Numbers from 0 on, in the same order."""
        return F.greatest(F.lit(self.low - 1), F.least(_clamped(value), F.lit(self.high + 1))) - F.lit(self.low - 1)


def span_of(intervals: DataFrame, start: str, stop: str) -> Span:
    bounds = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), _clamped(F.col(c))) for c in (start, stop)]))
    found = intervals.agg(F.min(F.array_min(bounds)).alias("low"), F.max(F.array_max(bounds)).alias("high")).first()
    return Span(0, 0) if found.low is None else Span(found.low, found.high)


def ranges_of(start: Column, stop: Column, span: Span = Span()) -> Column:
    """The ranges of an interval, both ends inclusive, as an array of (level, node); none if stop is before start."""
    low = F.when(start.isNull(), F.lit(0).cast("long")).otherwise(span.placed(start))
    high = F.when(stop.isNull(), F.lit(span.high - span.low + 2).cast("long")).otherwise(span.placed(stop)) + 1
    shift = lambda value, k: F.call_function("shiftright", value, k)
    node = lambda k, n: F.struct(k.cast("int").alias("level"), n.alias("node"))

    def at(k: Column) -> Column:
        # First whole range of this length, and the end of the last one.
        first = shift(low, k) + F.when(F.call_function("shiftleft", shift(low, k), k) == low, 0).otherwise(1)
        end = shift(high, k)
        return F.array(
            F.when((first % 2 == 1) & (first < end), node(k, first)), F.when((end % 2 == 1) & (first < end), node(k, end - 1)))

    found = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(span.bits)), at)), lambda r: r.isNotNull())
    always = F.array(F.struct(F.lit(ALWAYS).alias("level"), F.lit(0).cast("long").alias("node")))
    return F.when(start.isNull() & stop.isNull(), always).otherwise(found).cast(_RANGE)


def ranges_at(point: Column, levels: Sequence[int], span: Span = Span()) -> Column:
    """The ranges of the given lengths that hold a point; an unknown point only has the one of all points."""
    own = [F.struct(F.lit(k).alias("level"), F.shiftright(span.placed(point), k).alias("node")) for k in levels if k >= 0]
    always = F.array(F.struct(F.lit(ALWAYS).alias("level"), F.lit(0).cast("long").alias("node"))).cast(_RANGE)
    return F.when(point.isNull(), always).otherwise(F.concat(always, F.array(*own).cast(_RANGE))) if own else always


class IntervalIndex:
    """Intervals by their ranges, written once, with the lengths that occur (at most 65)."""

    def __init__(self, intervals: DataFrame, keys: Sequence[str], start: str, stop: str) -> None:
        self.keys = list(keys)
        self.span = span_of(intervals, start, stop)
        cut = intervals.withColumn("_range", F.explode(ranges_of(F.col(start), F.col(stop), self.span)))
        renamed = cut.withColumnsRenamed({k: f"_i_{k}" for k in self.keys})
        self.rows = settle(renamed.withColumn("_i_level", F.col("_range.level")).withColumn("_i_node", F.col("_range.node")).drop("_range"))
        self.levels = sorted(r[0] for r in self.rows.select("_i_level").distinct().collect())

    def holding(self, points: DataFrame, at: str) -> DataFrame:
        """Every point with each interval of its keys that holds it; also for a stream of points."""
        spread = points.withColumn("_range", F.explode(ranges_at(F.col(at), self.levels, self.span)))
        match = (F.col("_range.level") == F.col("_i_level")) & (F.col("_range.node") == F.col("_i_node"))
        for key in self.keys:
            match = match & (F.col(key) == F.col(f"_i_{key}"))
        # Sizes estimated before the ranges are laid out say nothing of the index, so it must not be broadcast by them.
        return spread.join(self.rows.hint("merge"), match).drop("_range", "_i_level", "_i_node", *[f"_i_{k}" for k in self.keys])
