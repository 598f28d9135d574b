"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataguild.session import checkpoint_folder, settle

__all__ = ["checkpoint_folder", "settle", "read", "drop_folder", "release_memory", "raw_text", "words_of", "map_batches", "WORD_BYTES"]

#: Fixed by the word rule: digits, ASCII letters (lower-cased) and all bytes of other characters belong to words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of tables that no later step reads, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def raw_text(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b"").cast("binary"))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, in order."""
    return text.translate(WORD_BYTES).split()


def release_memory() -> None:
    """Give freed memory back to the system: a worker that Spark keeps for later tasks would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, step: Callable, schema: str) -> DataFrame:
    """Apply ``step(batch) -> dict of columns`` to every Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                del out, batch
            release_memory()

    return df.mapInArrow(run, schema)
