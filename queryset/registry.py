"""Registration of queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

# Column kinds: whole number, text, truth value, and doubles at 4, 6 or 9 decimals.
SPARK_TYPES = {"i": "bigint", "s": "string", "b": "boolean"}
SQL_TYPES = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}
DECIMALS = {"c": 4, "d": 6, "p": 9}


def _spark_column(name: str, kind: str) -> Column:
    if kind in SPARK_TYPES:
        return F.col(name).cast(SPARK_TYPES[kind]).alias(name)
    # Adding zero turns a negative zero into zero.
    return (F.round(F.col(name).cast("double"), DECIMALS[kind]) + F.lit(0.0)).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind in SQL_TYPES:
        return f'CAST("{name}" AS {SQL_TYPES[kind]}) AS "{name}"'
    return f'round(CAST("{name}" AS DOUBLE), {DECIMALS[kind]}) + CAST(0 AS DOUBLE) AS "{name}"'


def query(name: str, columns: str, sql: str | None = None, ctes: str = ""):
    """Register a query.  ``columns`` reads like ``"region:s n:i mass:d"``."""
    spec = [tuple(c.split(":")) for c in columns.split()]

    def wrap(build: Callable[["Tables"], DataFrame]):
        from queryset.views import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir)).select(*[_spark_column(*c) for c in spec])

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            head = f"WITH RECURSIVE {ctes} " if ctes else ""
            TWINS[name] = f"{head}SELECT {', '.join(_sql_column(*c) for c in spec)} FROM ({sql}) AS twin"
        return build

    return wrap
