"""Where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a measured table that may be sent to every executor.
BROADCAST_ROWS = 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session whose tasks run inside the driver may do without one and gets a fresh local folder; elsewhere
    executors could not read what others have written, so a missing name is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strataguild-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute a derived table once and keep it in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Compute a wide or long table once and keep it as compressed columns in the shared checkpoint folder."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def marked(kept: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table, marked for broadcast only if its counted rows are few."""
    few = kept.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(kept) if few else kept


def measured(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Settle a table and mark it for broadcast only if its counted rows are few.

    Above the bound the table is returned unmarked, and joins with it shuffle.
    """
    return marked(settle(df), max_rows)
