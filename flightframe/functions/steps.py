"""Values that build on each other, each worked out once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values by name, from the values of the steps before.
Step = Callable[[Callable[[str], Column]], Mapping[str, Column]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def worked_out(steps: Sequence[Step], known: Mapping[str, Column] | None = None) -> Column:
    """The last step's values as a struct, inside one expression. Spark does not compile it: ``with_steps`` is for tables."""
    known, (step, *rest) = dict(known or {}), steps
    values = step(known.__getitem__)
    if not rest:
        return F.struct(*[c.alias(n) for n, c in values.items()])
    known.update(values)
    return let(F.struct(*[c.alias(n) for n, c in known.items()]), lambda s: worked_out(rest, {n: s[n] for n in known}))


def with_steps(df: DataFrame, steps: Sequence[Step], prefix: str) -> DataFrame:
    """``df`` with the last step's values, named with ``prefix``. A generator hands each step's values on as finished ones
    and is compiled, so no step repeats another."""
    columns, values = df.columns, {}
    for step in steps:
        values = step(lambda n: F.col(f"{prefix}{n}"))
        df = df.select("*", F.inline(F.array(F.struct(*[c.alias(f"{prefix}{n}") for n, c in values.items()]))))
    return df.select(*columns, *[f"{prefix}{n}" for n in values])
