"""Exact values at wanted ranks of groups of any size and spread.

A mergeable summary (Spark's rank-bounded percentile sketch) proposes edges inside a long group; rows are counted
between the edges exactly, and only the stretches that hold a wanted rank go on.  Stretches that are still long get a
summary of their own.  What remains is short, so that a task may sort it.  The summaries only say where to cut: counts
are exact, so an inaccurate one costs another round, never a wrong value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataguild.operators.joins import same_keys
from strataguild.session import marked, measured, settle

# Rows of one group that a task may sort.
SHORT = 1 << 17
# Edges of a summary, one less than a power of two, and its accuracy.
EDGES = 63
ACCURACY = 10_000


def edge_shares(probs: Sequence[float]) -> list[float]:
    """Where a summary is asked for edges: close around the wanted shares, then evenly in the gaps."""
    margin = 2.0 / ACCURACY
    near = {min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)}
    near = set(sorted(near)[: EDGES - 1]) if len(near) >= EDGES else near
    even = [(i + 1) / (EDGES + 1) for i in range(EDGES)]
    for i in range(EDGES):
        if len(near) < EDGES:
            near.add(even[(i * 26) % EDGES])
    return sorted(near)


def stretch(value: Column, edges: Column) -> Column:
    """Number of the stretch that a value lies in: odd on an edge, even between edges."""
    steps = F.array(*[F.lit((EDGES + 1) >> (i + 1)) for i in range((EDGES + 1).bit_length() - 1)])
    passed = F.aggregate(steps, F.lit(0), lambda acc, s: acc + F.when(value >= F.get(edges, acc + s - 1), s).otherwise(F.lit(0)))
    on_edge = F.when(value == F.get(edges, passed - 1), 1).otherwise(0)
    return (2 * passed - on_edge).cast("bigint")


def narrowed(
    rows: DataFrame, by: Sequence[str], value: str, wants: str, probs: Sequence[float], weight: str | None = None, short: int = SHORT
) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Rounds of (rows, tasks): short stretches of ``by`` and ``_seg`` that hold wanted ranks, with the rows to look in.

    ``rows`` must be settled: it is read several times.  ``wants`` is SQL for an array of (key, rank) from ``_total``.
    Tasks have ``_rows`` (``short`` at most), ``_before``, ``_total`` and the wanted ranks ``_want``.
    """
    key = [*by, "_seg"]
    live = rows.withColumn("_seg", F.lit(0).cast("bigint"))
    amount = (lambda: F.sum(weight).cast("bigint")) if weight else (lambda: F.count(F.lit(1)))
    sizes = live.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), amount().alias("_total"))
    tasks = sizes.select(*key, "_rows", F.lit(0).cast("bigint").alias("_before"), "_total", F.expr(wants).alias("_want"))
    while True:
        tasks = settle(tasks)
        yield live, tasks.where(F.col("_rows") <= short)
        if tasks.where(F.col("_rows") > short).isEmpty():
            return
        long = marked(tasks.where(F.col("_rows") > short))
        hot = same_keys(live, long.select(*key), key, "left_semi")
        edges = measured(hot.groupBy(*key).agg(F.percentile_approx(value, edge_shares(probs), F.lit(ACCURACY)).alias("_edges")))
        placed = same_keys(hot, edges, key).withColumn("_at", stretch(F.col(value), F.col("_edges"))).drop("_edges")
        counts = settle(placed.groupBy(*key, "_at").agg(amount().alias("_n")))
        # As many rows a group as there are stretches.
        earlier = Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        run = counts.withColumn("_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        run = same_keys(run, long.drop("_rows"), key).withColumn("_before", F.col("_before") + F.col("_run"))
        inside = lambda w: (w["rank"] > F.col("_before")) & (w["rank"] <= F.col("_before") + F.col("_n"))  # noqa: B023, E731
        run = run.withColumn("_want", F.filter("_want", inside)).where(F.size("_want") > 0)
        kept = measured(run.select(*key, "_at", "_before", "_total", "_want"))
        further = (F.col("_seg") * (2 * EDGES + 2) + F.col("_at")).alias("_seg")
        hits = same_keys(placed, kept.select(*key, "_at"), [*key, "_at"], "left_semi")
        live = settle(hits.select(*by, further, value, *([weight] if weight else [])).groupBy(*key, value).agg(amount().alias("_w")))
        weight, probs = "_w", ()
        amount = lambda: F.sum("_w").cast("bigint")
        left = live.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
        tasks = same_keys(left, kept.select(*by, further, "_before", "_total", "_want"), key)


def at_ranks(live: DataFrame, tasks: DataFrame, by: Sequence[str], value: str, weight: str | None) -> DataFrame:
    """``by``, ``_total``, key and value of every wanted rank in short stretches."""
    key = [*by, "_seg"]
    few = marked(tasks.drop("_rows"))
    amount = F.sum(weight).cast("bigint") if weight else F.count(F.lit(1))
    hits = same_keys(live, few.select(*key), key, "left_semi")
    fine = same_keys(hits.groupBy(*key, value).agg(amount.alias("_c")), few, key)
    upto = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = fine.withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
    here = lambda w: (w["rank"] > F.col("_end") - F.col("_c")) & (w["rank"] <= F.col("_end"))
    picked = fine.select(*by, "_total", F.explode_outer(F.filter("_want", here)).alias("w"), value)
    return picked.where(F.col("w").isNotNull()).select(*by, "_total", F.col("w.key").alias("_key"), value)


def values_of_wanted(
    rows: DataFrame, by: Sequence[str], value: str, wants: str, probs: Sequence[float], weight: str | None = None, short: int = SHORT
) -> DataFrame:
    """All wanted values: ``by``, ``_total``, ``_key`` and the value."""
    parts = []
    for i, (live, tasks) in enumerate(narrowed(rows, by, value, wants, probs, weight, short)):
        parts.append(at_ranks(live, tasks, by, value, weight if i == 0 else "_w"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
