"""Quality rules for texts and annotation files, compiled from tables of thresholds into one projection.

What a rule takes for granted is said by the languages it holds for: frequent words are those of four languages,
and a text of a language that writes without spaces is measured in characters, not in words.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.llm.store import column
from flightframe.llm.text import GAP_CHARS, words

# Frequent words of the four languages of the texts.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "on", "be", "by", "this",
    "le", "la", "les", "de", "des", "du", "et", "que", "un", "une", "pour", "dans",
    "el", "los", "las", "en", "y", "se", "del", "por", "con", "una", "es",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "nicht", "auf",
)
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A text is rejected where ``measure`` is below ``least`` or above ``most`` times ``of`` (1 if None). The rule holds for
    the languages in ``only`` (all if None, also unknown ones) but those in ``never``."""

    measure: str
    of: str | None
    least: float | None
    most: float | None
    only: tuple[str, ...] | None = None
    never: tuple[str, ...] = ()


# Languages of the frequent words, and languages written without spaces.
LISTED = ("en", "fr", "es", "de")
UNSPACED = ("zh", "ja", "th", "lo", "km", "my")
RULES = (
    Rule("n_words", None, 50, None, never=UNSPACED),
    Rule("n_repeat_words", "n_words", None, 0.5),
    Rule("word_chars", "n_words", 2, None),
    Rule("word_chars", "n_words", None, 14, only=LISTED),
    Rule("word_chars", None, 200, None, only=UNSPACED),
    Rule("n_symbols", "n_words", None, 0.25, never=UNSPACED),
    Rule("n_symbols", "word_chars", None, 0.1, only=UNSPACED),
    Rule("n_stop_words", "n_words", 0.02, None, only=LISTED),
    Rule("n_dup_lines", "n_lines", None, 0.4),
)
#: Annotation files in XML: marks in moderation, something between them, and not one line over and over.
ANNOTATION_RULES = (
    Rule("word_chars", None, 40, None),
    Rule("n_symbols", "word_chars", 0.01, 0.4),
    Rule("n_dup_lines", "n_lines", None, 0.9),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _again(placed: str) -> Column:
    """Places of runs that occur twice or more, from (hash, place) sorted by hash."""
    same = lambda s, k: F.coalesce(s.h == F.get(placed, k).h, F.lit(False))
    return F.filter(F.transform(placed, lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s.i)), lambda i: i.isNotNull())


def measured(files: DataFrame, xml: str = "xml") -> DataFrame:
    """``files`` with the columns of MEASURES. Words in repeated runs of three are told by 64-bit hashes
    of the runs: sorted where any repeats, and the union of the repeated runs' places is counted."""
    text = F.coalesce(column(xml).cast("string"), F.lit(""))
    # A generator hands its output on as finished values, so each is worked out once.
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(GAP_CHARS)) != "")
    staged = once(files, "_quality_words", words(text))
    n = F.size("_quality_words")
    word = lambda i: F.get("_quality_words", i)
    runs = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    staged = once(staged, "_quality_runs", F.coalesce(runs, F.array().cast("array<bigint>")))
    unlike = F.size(F.array_distinct("_quality_runs")) == F.size("_quality_runs")
    placed = F.when(~unlike, F.sort_array(F.transform("_quality_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    staged = once(staged, "_quality_placed", F.coalesce(placed, F.array().cast("array<struct<h:bigint,i:int>>")))
    staged = once(staged, "_quality_places", F.sort_array(_again("_quality_placed")))
    gaps = F.transform("_quality_places", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get("_quality_places", k - 1))))
    staged = once(staged, "_quality_lines", lines)
    summed = lambda values: F.aggregate(values, F.lit(0), lambda total, x: total + x)
    stops = F.filter("_quality_words", lambda w: F.lower(w).isin(*STOP_WORDS))
    values = {
        "n_words": n, "word_chars": F.aggregate("_quality_words", F.lit(0), lambda total, w: total + F.char_length(w)),
        "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size("_quality_lines"), "n_dup_lines": F.size("_quality_lines") - F.size(F.array_distinct("_quality_lines")),
        "n_repeat_words": summed(gaps), "n_stop_words": F.size(stops),
    }
    return staged.select(*[column(c) for c in files.columns if c not in values], *[v.cast("long").alias(k) for k, v in values.items()])


def failed_rules(rules: Sequence[Rule], language: Column | None = None) -> Column:
    """Names of the measures out of bounds. A share of nothing is no failure: the compared side is multiplied out."""
    known = F.lit(LISTED[0]) if language is None else language

    def broken(rule: Rule) -> Column:
        value, whole = F.col(rule.measure), F.col(rule.of) if rule.of else F.lit(1)
        tests = [value < whole * F.lit(rule.least)] if rule.least is not None else []
        tests += [value > whole * F.lit(rule.most)] if rule.most is not None else []
        test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        if rule.only is not None:
            test = test & F.coalesce(known.isin(*rule.only), F.lit(False))
        if rule.never:
            test = test & ~F.coalesce(known.isin(*rule.never), F.lit(False))
        return F.when(test, F.lit(rule.measure))

    return F.array_distinct(F.filter(F.array(*[broken(r) for r in rules]), lambda m: m.isNotNull()))


def judged(files: DataFrame, xml: str = "xml", rules: Sequence[Rule] = RULES, language: str | None = None) -> DataFrame:
    """``files`` with its measures, ``failed`` (measures whose rule it breaks) and ``kept`` (none).

    ``language`` names the column of the text's language; where it is null or unknown, rules for certain languages do not
    hold. Without such a column all texts are taken for ones of a listed language. Annotation files are judged by ANNOTATION_RULES. One projection of built-in functions: no shuffle,
    no Python. A null text counts as empty and fails on its length; ties, repeated rows and null ids change
    nothing, as each row is judged alone. A column named like a measure is replaced by it. An empty table gives an
    empty result.
    """
    told = files if language is None else files.withColumn("_quality_language", column(language).cast("string"))
    measures = measured(told, xml)
    known = None if language is None else F.col("_quality_language")
    return measures.withColumn("failed", failed_rules(rules, known)).withColumn("kept", F.size("failed") == 0).drop("_quality_language")
