"""Box geometry as column expressions. A box is four double columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.functions.numbers import divide, finite_number
from flightframe.functions.steps import Step, with_steps, worked_out


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, ("x1", "y1", "x2", "y2"))]


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{name}") for name in ("x1", "y1", "x2", "y2")])


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.width) * F.greatest(F.lit(0.0), b.height)


def intersection(a: Box, b: Box) -> Column:
    width = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    height = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def diagonal(b: Box) -> Column:
    return F.hypot(b.width, b.height)


def center_distance(x: Column, y: Column, b: Box) -> Column:
    cx, cy = b.center
    return F.hypot(x - cx, y - cy)


def ordered(b: Box) -> Column:
    finite = [~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))) for c in b]
    good = (b.x2 > b.x1) & (b.y2 > b.y1)
    for check in finite:
        good = good & check
    return F.coalesce(good, F.lit(False))


def clip(b: Box, width: Column, height: Column) -> Box:
    within = lambda value, high: F.least(F.greatest(value, F.lit(0.0)), high.cast("double"))
    return Box(within(b.x1, width), within(b.y1, height), within(b.x2, width), within(b.y2, height))


def contains(b: Box, x: Column, y: Column) -> Column:
    return x.between(b.x1, b.x2) & y.between(b.y1, b.y2)


def touches_edge(b: Box, width: Column, height: Column, tolerance: float = 1.0) -> Column:
    return (
        (b.x1 <= tolerance) | (b.y1 <= tolerance)
        | (b.x2 >= width - tolerance) | (b.y2 >= height - tolerance)
    )


def visible_ratio(b: Box, width: Column, height: Column) -> Column:
    return divide(area(clip(b, width, height)), area(b))


def inner_crop(b: Box, ratio: float) -> Box:
    return Box(
        b.x1 + b.width * ratio, b.y1 + b.height * ratio,
        b.x2 - b.width * ratio, b.y2 - b.height * ratio,
    )


def parse_box(text: Column) -> Column:
    """``[a,b,c,d]`` as a struct, or null unless there are four finite ordered numbers."""
    return worked_out(_box_steps(text))["box"]


def with_parsed_box(df: DataFrame, text: Column, name: str = "box") -> DataFrame:
    """``df`` with ``parse_box`` as a column: the text is taken apart once, each number is tried once."""
    return with_steps(df, _box_steps(text), "parsed_").withColumnRenamed("parsed_box", name)


def _box_steps(text: Column) -> list[Step]:
    def judged(v) -> dict[str, Column]:
        b = Box(*[v(f"n{i}") for i in range(4)])
        good = (v("count") == 4) & F.coalesce((b.x2 > b.x1) & (b.y2 > b.y1), F.lit(False))
        return {"box": F.when(good, F.struct(*b.named()))}

    return [
        lambda v: {"parts": F.split(F.regexp_extract(text, r"^\s*[\[(](.*)[\])]\s*$", 1), ",")},
        lambda v: {"count": F.size(v("parts")), **{f"t{i}": F.get(v("parts"), F.lit(i)) for i in range(4)}},
        lambda v: {f"n{i}": finite_number(v(f"t{i}")) for i in range(4)}, judged,
    ]


def box_text(b: Box) -> Column:
    return F.format_string("[%.6f,%.6f,%.6f,%.6f]", *b)
