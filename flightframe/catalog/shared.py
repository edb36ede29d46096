"""Pieces the registered queries and their SQL statements share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.catalog.views import FRAME_H, FRAME_W, ctes, view

__all__ = ["DET", "FRAME_H", "FRAME_W", "SCORES", "ctes", "div", "iou_sql", "rounded", "scores_sql", "scored", "size", "view"]

SCORES = (
    "strict_accuracy", "decided_only_accuracy", "coverage", "moving_precision", "moving_recall", "moving_f1",
    "stationary_precision", "stationary_recall", "stationary_f1", "macro_f1", "balanced_accuracy", "unknown_rate",
)
COUNTS = (
    "total", "moving_gt", "stationary_gt", "moving_pred", "stationary_pred", "unknown_pred",
    "true_moving", "false_moving", "true_stationary", "false_stationary",
)

# Detections of the box view, after class mapping, confidence and clipping.
DET = ctes("v_boxes") + f""", det as (select * from (select *,
  case class_id when 0 then 'tasit' when 1 then 'insan' when 2 then 'uap' when 3 then 'uai' end as cls,
  least(greatest(x1, 0e0), {FRAME_W}e0) as cx1, least(greatest(y1, 0e0), {FRAME_H}e0) as cy1,
  least(greatest(x2, 0e0), {FRAME_W}e0) as cx2, least(greatest(y2, 0e0), {FRAME_H}e0) as cy2 from v_boxes) b
  where cls is not null and conf between 0.25 and 1 and x2 > x1 and y2 > y1 and cx2 > cx1 and cy2 > cy1)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so sums taken in another order still compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def size() -> tuple[Column, Column]:
    return F.lit(FRAME_W), F.lit(FRAME_H)


def div(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0e0 else ({a}) * 1e0 / ({b}) end"


def iou_sql(a: str, b: str, p: str = "", q: str = "") -> str:
    inter = (
        f"greatest(0, least({a}.{p}x2, {b}.{q}x2) - greatest({a}.{p}x1, {b}.{q}x1)) * "
        f"greatest(0, least({a}.{p}y2, {b}.{q}y2) - greatest({a}.{p}y1, {b}.{q}y1))"
    )
    area = lambda t, r: f"({t}.{r}x2 - {t}.{r}x1) * ({t}.{r}y2 - {t}.{r}y1)"
    return f"({inter}) / ({area(a, p)} + {area(b, q)} - {inter})"


def counts_sql(gt: str, pred: str, n: str = "1") -> str:
    total = lambda test: f"cast(coalesce(sum(case when {test} then {n} end), 0) as bigint)"
    m, s = f"{gt} = 'moving'", f"{gt} = 'stationary'"
    pm, ps = f"{pred} = 'moving'", f"{pred} = 'stationary'"
    tests = ("true", m, s, pm, ps, f"{pred} = 'unknown'", f"{m} and {pm}", f"{s} and {pm}", f"{s} and {ps}", f"{m} and {ps}")
    return ", ".join(f"{total(t)} as {c}" for t, c in zip(tests, COUNTS))


def scores_sql(counted: str, keep: Sequence[str], more: Sequence[str] = ()) -> str:
    """Select of counts and rounded scores from a table of the ten counts."""
    decided, correct = "(moving_pred + stationary_pred)", "(true_moving + true_stationary)"
    base = f"""select *, {div(correct, 'total')} as strict_accuracy, {div(correct, decided)} as decided_only_accuracy,
  {div(decided, 'total')} as coverage, {div('true_moving', 'moving_pred')} as moving_precision,
  {div('true_moving', 'moving_gt')} as moving_recall, {div('true_stationary', 'stationary_pred')} as stationary_precision,
  {div('true_stationary', 'stationary_gt')} as stationary_recall, {div('unknown_pred', 'total')} as unknown_rate from {counted}"""
    f1 = lambda k: div(f"2 * {k}_precision * {k}_recall", f"{k}_precision + {k}_recall")
    mid = f"select *, {f1('moving')} as moving_f1, {f1('stationary')} as stationary_f1, (moving_recall + stationary_recall) / 2 as balanced_accuracy, strict_accuracy * coverage as balanced_score from ({base}) s1"
    full = f"select *, (moving_f1 + stationary_f1) / 2 as macro_f1 from ({mid}) s2"
    columns = [*keep, *COUNTS, *[f"round({s}, 6) as {s}" for s in (*SCORES, *more)]]
    return f"select {', '.join(columns)} from ({full}) s3"


def scored(df: DataFrame, keep: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    return rounded(df.select(*keep, *COUNTS, *SCORES, *more))
