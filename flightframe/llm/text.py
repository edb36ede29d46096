"""Column expressions over texts whose words are runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def trimmed(text: Column) -> Column:
    """The text without white space around it; null counts as empty."""
    return F.coalesce(F.trim(text, F.lit(GAP_CHARS)), F.lit(""))


def words(text: Column) -> Column:
    """The words in order; an empty array without any."""
    return F.filter(F.split(trimmed(text), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, GAP))).cast("long")
