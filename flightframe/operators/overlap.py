"""Joins of boxes that meet inside a frame.

Frames within the size limit join on their key. In larger frames boxes are put into grids of several cell
sizes: a box's level is the first one whose cells are as wide as the box, so it lies in four cells
of it at most, and of each coarser one. Two boxes are compared on the coarser of their two levels, in the one
cell that holds the first corner of their overlap, so once. Both sides are salted, so that a
cell's boxes are shared out over as many tasks as the frame's size asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.boxes import Box
from flightframe.plans.groups import hot_groups, split_hot
from flightframe.policies import LIMITS

_EDGE = 2.0**50


def meeting(a: Box, b: Box) -> Column:
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def join_meeting_boxes(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_box: Box,
    right_box: Box,
    *,
    how: str = "inner",
    salt_by: Sequence[str] = (),
    cell_px: float = 64.0,
    rows: int | None = None,
) -> DataFrame:
    """Pairs of a left and a right row of the same keys whose boxes meet (touching counts).

    ``left_box`` and ``right_box`` name columns that exist on one side only. ``how`` may be
    ``left`` (left rows without a partner appear once with nulls) or ``left_anti`` (only those);
    ``salt_by`` then names the columns that identify a left row within its keys.
    """
    rows = LIMITS.join_rows if rows is None else rows
    keys = list(keys)
    plain = lambda a, b: _on_keys(a, b, keys, meeting(left_box, right_box), how)
    hot = hot_groups(left.select(*keys).unionAll(right.select(*keys)), keys, rows)
    if hot is None:
        return plain(left, right)
    left_small, left_hot = split_hot(left, hot, keys)
    right_small, right_hot = split_hot(right, hot, keys)
    named = list(salt_by) or [c for c in left.columns if c not in keys]
    fan = F.ceil(F.sqrt(F.col("group_rows") / F.lit(rows))).cast("int")
    pieces = hot.select(*keys, fan.alias("_fan"))
    a = left_hot.join(pieces, keys).withColumn("_la", _level(left_box, cell_px)).withColumn("_sa", F.pmod(F.xxhash64(*named), F.col("_fan")).cast("int"))
    b = right_hot.join(pieces, keys).withColumn("_lb", _level(right_box, cell_px)).withColumn("_sb", F.pmod(F.xxhash64(*right_box), F.col("_fan")).cast("int"))
    # At most 46 levels, whatever the boxes.
    levels = sorted(r[0] for r in a.select("_la").union(b.select("_lb")).distinct().collect() if r[0] is not None)
    others = F.explode(F.sequence(F.lit(0), F.col("_fan") - 1))
    a = _celled(a, left_box, "_la", levels, cell_px).withColumn("_sb", others).drop("_fan")
    b = _celled(b, right_box, "_lb", levels, cell_px).withColumn("_sa", others).drop("_fan")
    width = F.lit(cell_px) * F.pow(F.lit(2.0), "_l")
    owner = (F.col("_gx") == _cell(F.greatest(left_box.x1, right_box.x1), width)) & (
        F.col("_gy") == _cell(F.greatest(left_box.y1, right_box.y1), width)
    )
    pairs = a.join(b, [*keys, "_l", "_gx", "_gy", "_sa", "_sb"])
    pairs = pairs.where((F.col("_l") == F.greatest("_la", "_lb")) & meeting(left_box, right_box) & owner)
    pairs = pairs.drop("_l", "_gx", "_gy", "_sa", "_sb", "_la", "_lb")
    result = plain(left_small, right_small)
    if how == "inner":
        return result.unionByName(pairs)
    paired = pairs.select(*keys, *named).distinct()
    alone = left_hot.join(paired, [*keys, *named], "left_anti")
    if how == "left_anti":
        return result.unionByName(alone)
    return result.unionByName(pairs).unionByName(alone, allowMissingColumns=True)


def _far(value: Column) -> Column:
    return F.least(F.greatest(value.cast("double"), F.lit(-_EDGE)), F.lit(_EDGE))


def _cell(value: Column, width: Column) -> Column:
    return F.floor(_far(value) / width).cast("long")


def _level(b: Box, cell_px: float) -> Column:
    """The first level whose cells are no narrower than the box."""
    side = F.greatest(_far(b.x2) - _far(b.x1), _far(b.y2) - _far(b.y1))
    return F.when(side <= cell_px, 0).otherwise(F.ceil(F.log2(side / cell_px))).cast("int")


def _celled(df: DataFrame, b: Box, own: str, levels: Sequence[int], cell_px: float) -> DataFrame:
    """The cells of each box on its own and all coarser levels that occur."""
    above = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col(own))
    width = F.lit(cell_px) * F.pow(F.lit(2.0), "_l")
    covered = lambda low, high: F.explode(F.when(low <= high, F.sequence(_cell(low, width), _cell(high, width))))
    return df.withColumn("_l", F.explode(above)).withColumn("_gx", covered(b.x1, b.x2)).withColumn("_gy", covered(b.y1, b.y2))


def _on_keys(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    match = condition
    for key in keys:
        match = match & (F.col(key) == F.col(f"_r_{key}"))
    joined = left.join(renamed, match, how)
    return joined if how == "left_anti" else joined.drop(*[f"_r_{key}" for key in keys])
