"""Evaluate a costly expression once.

Column expressions are trees: a value used three times is written, optimised and (through
filter push-down) evaluated three times. These helpers give such a value a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, below which no later filter is pushed."""
    fields = [c.alias(n) for n, c in columns.items()]
    keep = [c for c in rows.columns if c not in columns]
    return rows.select(*keep, F.inline(F.array(F.struct(*fields))))
