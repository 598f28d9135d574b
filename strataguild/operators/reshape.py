"""Unions and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_sources(parts: Sequence[tuple[str, DataFrame]], tag: str = "source") -> DataFrame:
    """Union tables of the same columns and say where each row came from."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts]
    return reduce(DataFrame.unionByName, tagged)


def stack_loose(*parts: DataFrame) -> DataFrame:
    """Union tables whose columns differ; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    names_to: str,
    values_to: str,
    strip: str = "",
) -> DataFrame:
    """One row per listed column; ``strip`` is removed from the front of its name."""
    long = df.unpivot(list(ids), list(columns), names_to, values_to)
    if strip:
        long = long.withColumn(names_to, F.regexp_replace(names_to, "^" + strip, ""))
    return long


def to_wide(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, levels: Sequence[str]
) -> DataFrame:
    """One column per listed level."""
    return df.groupBy(*ids).pivot(names_from, list(levels)).agg(F.max(values_from))


def add_count_row(
    df: DataFrame, label: str, columns: Sequence[str], cutoff: float = 0.05, name: str = "# Significant"
) -> DataFrame:
    """Append a row that counts, per column, the values below the cutoff."""
    below = [F.sum(F.when(F.col(c) < cutoff, 1.0).otherwise(0.0)).alias(c) for c in columns]
    total = df.agg(*below).select(F.lit(name).alias(label), *columns)
    return df.select(label, *columns).unionByName(total)


def events_from_matrix(df: DataFrame, name: str, run_columns: Sequence[str]) -> DataFrame:
    """Wide replicate matrix (one time column per run) to (run, name, t, death_year)."""
    long = df.unpivot([name], list(run_columns), "_col", "t").where(F.col("t").isNotNull())
    runs = F.map_from_arrays(
        F.array(*[F.lit(c) for c in run_columns]),
        F.sequence(F.lit(1), F.lit(len(run_columns))),
    )
    return long.select(
        F.element_at(runs, F.col("_col")).alias("run"),
        F.col(name),
        F.col("t").cast("double").alias("t"),
        death_year(F.col("t")).alias("death_year"),
    )


def death_year(t: Column) -> Column:
    """Times are rounded up to whole years."""
    return F.ceil(t).cast("int")
