"""Row selection, cleaning and ordered labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataguild.functions.scalar import level_rank


def snake(name: str) -> str:
    """Column name in lower case with single underscores."""
    out = "".join(c.lower() if c.isalnum() else "_" for c in name)
    return "_".join(part for part in out.split("_") if part)


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def pick(
    df: DataFrame,
    *columns: str,
    span: tuple[str, str] | None = None,
    prefixes: Sequence[str] = (),
    rename: dict[str, str] | None = None,
) -> DataFrame:
    """Select by name, by a range of neighbouring columns, by prefix, and with new names."""
    names = list(columns)
    if span is not None:
        a, b = df.columns.index(span[0]), df.columns.index(span[1])
        names += df.columns[a : b + 1]
    names += [c for c in df.columns if any(c.startswith(p) for p in prefixes)]
    new = {old: name for name, old in (rename or {}).items()}
    names += [c for c in new if c not in names]
    seen = list(dict.fromkeys(names))
    return df.select(*[F.col(f"`{c}`").alias(new.get(c, c)) for c in seen])


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in the given order.

    Taken as the smallest (order, row) record, so a frequent key is reduced before
    it is shuffled.  Order columns should identify rows; nulls sort first.
    """
    rest = [c for c in df.columns if c not in key]
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    record = F.struct(*keys, *[F.col(c) for c in rest])
    picked = df.groupBy(*key).agg(F.min(record).alias("_r"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def with_levels(df: DataFrame, column: str, levels: Sequence[str], rank: str) -> DataFrame:
    """Add the rank of an ordered label; labels outside the list get a null label and rank."""
    pos = level_rank(F.col(column), levels)
    return df.withColumn(rank, pos).withColumn(column, F.when(F.col(rank).isNotNull(), F.col(column)))


def arrange(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.orderBy(*columns)
