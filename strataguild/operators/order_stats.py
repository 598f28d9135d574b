"""Ordered work inside groups of any size.

Running totals inside a group are taken in two steps: totals per bucket, run over the list
of buckets, and rows inside one bucket.  Buckets are the parts of a range partitioning, so
they are even whatever the values look like; equal values are counted before they are
shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataguild.session import settle

# Ranks per lookup slice, and the most slices one group is cut into.
SLICE_RANKS = 64
MAX_SLICES = 1 << 22


def value_histogram(
    df: DataFrame, by: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """One row per group and distinct value with its count ``n``; null values are left out."""
    count = F.sum(weight).cast("bigint") if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(count.alias("n"))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    specs: Sequence[tuple[str, str, str]],
    totals: Sequence[tuple[str, str]] = (),
    inclusive: bool = False,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add running aggregates along ``order`` inside each group.

    ``specs`` lists (new column, source column, "sum" or "max"), each with a source of
    its own; ``totals`` lists (new column, source column) whose group sum is repeated on
    every row.  ``ties`` orders rows of equal ``order``.  Rows with a null ``order``
    must be filtered out before.

    A bucket is what a group has in one part of a range partitioning: its bounds come
    from a sample of the data, so buckets are even whatever the values look like, and a
    group has one bucket per part at most.
    """
    agg = {"sum": F.sum, "max": F.max}
    # Kept, because a second run of the same plan could draw other bounds.
    rows = settle(df.repartitionByRange(*by, order, *ties).withColumn("_bkt", F.spark_partition_id()))
    # Totals per bucket, then run over the buckets of a group: a list as long as there are parts.
    per_bucket = rows.groupBy(*by, "_bkt").agg(
        *[agg[how](src).alias(src) for _, src, how in specs],
        *[F.sum(src).alias(f"_t{i}") for i, (_, src) in enumerate(totals)],
    )
    over_buckets = Window.partitionBy(*by)
    earlier = over_buckets.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    # The carried-in totals lead each bucket as one extra row, so no join is needed.
    lead = per_bucket.select(
        *by,
        "_bkt",
        *[agg[how](src).over(earlier).alias(src) for _, src, how in specs],
        *[F.sum(f"_t{i}").over(over_buckets).alias(f"_t{i}") for i in range(len(totals))],
        F.lit(0).alias("_kind"),
    )
    both = rows.withColumn("_kind", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_bkt").orderBy("_kind", order, *ties)
    frame = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = {
        name: F.coalesce(F.sum(src).over(frame), F.lit(0)) if how == "sum" else F.max(src).over(frame)
        for name, src, how in specs
    }
    out = both.select(
        *df.columns,
        "_kind",
        *[col.alias(name) for name, col in so_far.items()],
        *[F.max(f"_t{i}").over(upto).alias(name) for i, (name, _) in enumerate(totals)],
    )
    return out.where(F.col("_kind") == 1).drop("_kind")


def with_positions(
    hist: DataFrame, by: Sequence[str], value: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``n_before`` and ``n_total`` to a value histogram."""
    return running(hist, by, value, [("n_before", "n", "sum")], [("n_total", "n")], ties=ties)


def _slice_width(total: Column) -> Column:
    return F.greatest(
        F.lit(SLICE_RANKS), F.ceil(total / F.lit(float(MAX_SLICES)))
    ).cast("bigint")


def values_at_ranks(
    positions: DataFrame, requests: DataFrame, by: Sequence[str], value: str
) -> DataFrame:
    """Look up the value that sits at a 1-based rank of its group.

    ``positions`` has ``by``, the value, ``n``, ``n_before`` and ``n_total``;
    ``requests`` has ``by``, ``rank``, ``n_total`` and any payload columns.  Both
    sides are cut into short slices of the rank axis and merged in rank order, so a
    large group is spread over many tasks and nothing is paired up.
    """
    payload = [c for c in requests.columns if c not in {*by, "n_total"}]
    width = _slice_width(F.col("n_total"))
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    marks = (
        positions.withColumn("_w", width)
        .withColumn(
            "_s", F.explode_outer(F.sequence(F.floor(first / F.col("_w")), F.floor(last / F.col("_w"))))
        )
        .select(
            *by,
            "_s",
            F.greatest(first, F.col("_s") * F.col("_w")).alias("_pos"),
            F.lit(0).alias("_kind"),
            F.col(value).alias("_value"),
        )
    )
    asked = requests.select(
        *by,
        F.floor((F.col("rank") - 1) / width).alias("_s"),
        (F.col("rank") - 1).alias("_pos"),
        F.lit(1).alias("_kind"),
        *payload,
    )
    merged = marks.unionByName(asked, allowMissingColumns=True)
    w = (
        Window.partitionBy(*by, "_s")
        .orderBy("_pos", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        merged.withColumn(value, F.last("_value", ignorenulls=True).over(w))
        .where(F.col("_kind") == 1)
        .select(*by, *payload, value)
    )
