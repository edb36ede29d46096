"""Size checks: which groups are too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.plans.settle import settle


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """Keys of groups above ``rows`` with their sizes, or None when there is no such group.

    The count is combined before its shuffle, and at most (all rows / ``rows``) keys come back.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    hot = sizes.where(F.col("group_rows") > rows)
    if hot.isEmpty():
        return None
    return settle(hot)


def split_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` without and with the hot groups."""
    marks = hot.select(*keys)
    return df.join(marks, list(keys), "left_anti"), df.join(marks, list(keys), "left_semi")
