"""Long expressions that are named several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns set, by way of a generator of one row.

    The optimizer puts a plain projection's expressions in place of every later use of their names, filters
    included, and a chain of regular expressions then runs many times a row. It does not do so across a generator.
    """
    keep = [c for c in df.columns if c not in columns]
    made = df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.select(*df.columns, *[n for n in columns if n not in df.columns])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value found once, for use inside functions on arrays, where no column can hold it."""
    return F.element_at(F.transform(F.array(value), use), 1)
