"""Safe numbers: text to double, non-finite to null, divisions that give zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number and truth spellings.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
TRUE_WORDS = ("1", "true", "yes")


def nullif_nonfinite(value: Column) -> Column:
    # Not a number sorts above all numbers.
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), nullif_nonfinite(F.trim(text).try_cast("double")))


def first_number(*texts: Column) -> Column:
    return F.coalesce(*[finite_number(text) for text in texts])


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*TRUE_WORDS), F.lit(False))


def divide(numerator: Column, denominator: Column) -> Column:
    """Zero when the denominator is zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def divide_or_null(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def harmonic(precision: Column, recall: Column) -> Column:
    return divide(2 * precision * recall, precision + recall)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def rotation_degrees(m10: Column, m00: Column) -> Column:
    return F.degrees(F.atan2(m10, m00))


def angle_error_degrees(first: Column, second: Column) -> Column:
    """Absolute difference wrapped to [0, 180]."""
    return F.abs(F.pmod(first - second + 180.0, F.lit(360.0)) - 180.0)
