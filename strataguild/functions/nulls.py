"""Null rules shared by the operators.

Text tests and set membership never return null here, and an aggregate either
skips nulls or lets one null make the whole result null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(col: Column, pattern: str) -> Column:
    """Case-insensitive regular expression test; a null text does not match."""
    return F.coalesce(col.rlike("(?i)" + pattern), F.lit(False))


def in_set(col: Column, values: Iterable) -> Column:
    """Membership test that is false, not null, for a null value."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_in_set(col: Column, values: Iterable) -> Column:
    """Exclusion test that keeps null values."""
    return ~in_set(col, values)


def to_number(col: Column) -> Column:
    """Text to double; text that is not a number becomes null."""
    return col.try_cast("double")


def null_tokens(col: Column, tokens: Iterable[str]) -> Column:
    """Turn the listed texts into null."""
    tokens = list(tokens)
    return F.when(~F.coalesce(col.isin(tokens), F.lit(False)), col) if tokens else col


def propagate(agg: Column, col: Column) -> Column:
    """Aggregate result that is null as soon as one input of the group is null."""
    return F.when(F.count(col) == F.count(F.lit(1)), agg)
