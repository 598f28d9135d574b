"""Delimited text and Parquet, with null tokens set per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataguild.functions.nulls import null_tokens
from strataguild.operators.rows import snake


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[tuple[str, str]],
    na: Sequence[str] = ("NA",),
    strip: bool = True,
    sep: str = ",",
) -> DataFrame:
    """Delimited file with a header, read against an explicit column list.

    ``columns`` lists (name, Spark type) in file order, so an unnamed trailing column
    gets its name here.  Each text equal to a token in ``na`` is null, for every type,
    and text that does not parse as its type is null too.  Names come out in
    snake case.  A byte order mark and CRLF line ends are accepted.
    """
    text = T.StructType([T.StructField(snake(c), T.StringType()) for c, _ in columns])
    raw = (
        spark.read.schema(text)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", strip)
        .option("ignoreTrailingWhiteSpace", strip)
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
        .csv(path)
    )
    out = []
    for field, (_, kind) in zip(text.fieldNames(), columns):
        # The reader returns null for an empty field; keep it empty unless "" is a token.
        col = F.coalesce(F.col(field), F.lit(""))
        if strip:
            col = F.trim(col)
        col = null_tokens(col, na)
        out.append((col if kind == "string" else col.try_cast(kind)).alias(field))
    return raw.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Hand-off table between plans, one folder per statistic where asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def read_stage(spark: SparkSession, path: str, **parts: str) -> DataFrame:
    """A staged table, or only the named parts of one: ``read_stage(spark, path, statistic="median")``.

    A table without its commit marker was not written to the end and is an error.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    marker = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        raise FileNotFoundError(f"{path} holds no committed table")
    table = spark.read.parquet(path)
    for name, value in parts.items():
        table = table.where(F.col(name) == value)
    return table
