"""Joins: null-safe keys, interval overlap, lookups and survivors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataguild.session import BROADCAST_ROWS, settle

# Quantile stretches of an age axis: two to this power at most; finer cells cut them evenly.
MOST_COARSE = 10


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; key columns appear once.

    ``how`` is inner, left, left_semi, left_anti or full.
    """
    if not keys:
        raise ValueError("join keys are missing")
    other = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys])
    out = left.join(other, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how == "full":
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"_k_{k}")) for k in keys})
    return out.drop(*[f"_k_{k}" for k in keys])


def enrich(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefix: str
) -> DataFrame:
    """Left join on differently named keys; the right columns get a prefix first."""
    other = right.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in right.columns])
    return left.join(other, left[left_key] == other[f"{prefix}{right_key}"], "left")


def lookup_join(df: DataFrame, key: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Left join to a literal dimension table."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(key, on, "left")


def _overlaps(fad: Column, lad: Column, hi: Column, lo: Column, closed: bool) -> Column:
    return (lad <= hi) & (fad >= lo) if closed else (lad < hi) & (fad > lo)


def _cell(x: Column, edges: Column, steps: Sequence[int], fine: int) -> Column:
    """Cell of a position: which quantile stretch it lies in, cut evenly into ``2**fine`` cells."""
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda acc, s: acc + F.when(x >= F.get(edges, acc + s - 1), s).otherwise(0))
    low, high = F.get(edges, at - 1), F.get(edges, at)
    share = F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
    # Beyond the outer edges, or between infinite ones, a stretch is not cut.
    part = F.coalesce(F.when(share.between(0.0, 1.0), F.floor(share * float(1 << fine))), F.lit(0))
    return at.cast("bigint") * (1 << fine) + F.least(part, F.lit((1 << fine) - 1)).cast("bigint")


def _cover(first: str, last: str, depth: int) -> Column:
    """The fewest nodes of a binary tree over ``2**depth`` cells that make up the cells ``first..last``."""
    left = f"((({first}) + shiftleft(1L, k) - 1) div shiftleft(1L, k))"
    right = f"((({last}) + 1) div shiftleft(1L, k))"
    node = lambda i: f"shiftleft(1L, {depth} - k) + {i}"
    pair = f"""array(CASE WHEN {left} < {right} AND {left} % 2 = 1 THEN {node(left)} END,
                     CASE WHEN {left} < {right} AND {right} % 2 = 1 THEN {node(f"{right} - 1")} END)"""
    return F.expr(f"filter(flatten(transform(sequence(0, {depth}), k -> {pair})), x -> x IS NOT NULL)")


def _path(cell: str, levels: Sequence[int], depth: int) -> Column:
    """The nodes above a cell at the given levels (0 for the cell itself)."""
    return F.array(*[F.expr(f"shiftleft(1L, {depth - k}) + shiftright({cell}, {k})") for k in levels])


def overlap_join(
    spans: DataFrame,
    intervals: DataFrame,
    first: str = "fad",
    last: str = "lad",
    hi: str = "hi",
    lo: str = "lo",
    closed: bool = False,
) -> DataFrame:
    """Each span paired with every interval it overlaps.

    Ages count backwards: ``first`` >= ``last`` and ``hi`` >= ``lo``.  Open overlap
    is ``last < hi and first > lo``; closed overlap uses <= and >=.  Rows with a null end overlap nothing.

    Two ranges meet if the later of their lower ends lies in the other range.  So ranges
    become the few nodes of a binary tree that cover them, lower ends the nodes above
    them, and every pair meets in exactly one node by an equi-join.  The tree's cells
    follow the quantiles of the interval ends and their number.  Nodes that many spans
    meet in are dealt over several tasks by a hash of the span.
    """
    known = intervals.where(F.col(hi).isNotNull() & F.col(lo).isNotNull())
    total = known.count()
    depth = max(1, math.ceil(math.log2(2 * max(1, total))))
    coarse = min(depth, MOST_COARSE)
    shares = [(i + 1) / (1 << coarse) for i in range((1 << coarse) - 1)]
    ends = known.select(F.explode(F.array(F.col(lo).cast("double"), F.col(hi).cast("double"))).alias("x"))
    # Taken once, so that both sides see the same cells: a short array, whatever the number of intervals.
    found = ends.agg(F.percentile_approx("x", shares, F.lit(100 << coarse))).first()[0]
    edges = F.lit(found or [0.0] * len(shares))
    steps = [1 << (coarse - 1 - i) for i in range(coarse)]

    def placed(df: DataFrame, top: str, bottom: str, low: str, high: str) -> DataFrame:
        known = df.where(F.col(top).isNotNull() & F.col(bottom).isNotNull())
        cell = lambda x: _cell(x.cast("double"), edges, steps, depth - coarse)
        return known.withColumn(low, cell(F.least(top, bottom))).withColumn(high, cell(F.greatest(top, bottom)))

    kinds = lambda points, ranges: F.array(
        F.struct(F.lit(1).alias("k"), points.alias("n")), F.struct(F.lit(2).alias("k"), ranges.alias("n"))
    )
    right = placed(intervals, hi, lo, "_il", "_ih")
    right = right.withColumn("_set", F.explode(kinds(_cover("_il", "_ih", depth), _path("_il", range(depth + 1), depth))))
    right = right.select(*intervals.columns, F.col("_set.k").alias("_kind"), F.explode("_set.n").alias("_node"))
    right = settle(right)
    # Spans look only at the levels at which intervals have nodes.
    level = F.expr(f"{depth + 1} - length(bin(_node))")
    used = right.where("_kind = 1").agg(F.array_sort(F.collect_set(level))).first()[0]
    left = placed(spans, first, last, "_sl", "_sh")
    left = left.withColumn("_set", F.explode(kinds(_path("_sl", used, depth) if used else F.array().cast("array<bigint>"), _cover("_sl", "_sh", depth))))
    left = left.select(*spans.columns, F.col("_set.k").alias("_kind"), F.explode("_set.n").alias("_node"))

    on = ["_kind", "_node"]
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = left.join(F.broadcast(right), on)
    else:
        both = _dealt_join(left, right, on, [F.col(c) for c in spans.columns])
    keep = _overlaps(F.col(first), F.col(last), F.col(hi), F.col(lo), closed)
    span_low, low = F.least(first, last), F.least(hi, lo)
    # Each pair is reported by the range that holds the later of the lower ends.
    own = F.when(F.col("_kind") == 1, span_low >= low).otherwise(low > span_low)
    return both.where(keep & own).drop("_kind", "_node")


def _dealt_join(left: DataFrame, right: DataFrame, on: Sequence[str], row: Sequence[Column]) -> DataFrame:
    """Inner join in which keys with more left rows than a task's even share are cut by a hash of the row."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = settle(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    share = F.lit(max(1, (counts.agg(F.sum("_n")).first()[0] or 0) // (4 * tasks)))
    # At most four keys a task have so many rows.
    hot = F.broadcast(counts.where(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / share).cast("int").alias("_cuts")))
    cuts = F.coalesce(F.col("_cuts"), F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_cut", F.pmod(F.xxhash64(*row), cuts).cast("int")).drop("_cuts")
    copies = right.join(hot, on, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("_cuts")
    return dealt.join(copies, [*on, "_cut"]).drop("_cut")


def present_only(df: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(present.select(*on), list(on), "left_semi")


def per_run(pool: DataFrame, runs: DataFrame) -> DataFrame:
    """Every pool row once for each run of ``runs``."""
    listed = runs.select("run").distinct().agg(F.array_sort(F.collect_set("run")).alias("_runs"))
    return pool.withColumn("run", F.explode(F.lit(listed.scalar())))


def survivors(members: DataFrame, dead: DataFrame, name: str = "name") -> DataFrame:
    """(run, name) rows without those that died in the same run."""
    return members.join(dead.select("run", name), ["run", name], "left_anti")


def alive_in_year(pool: DataFrame, dead: DataFrame, year: int, name: str = "name") -> DataFrame:
    """Pool rows whose death year lies after the given year (or that never die)."""
    gone = dead.where(F.col("death_year") <= year).select(name)
    return pool.join(gone, [name], "left_anti")


def alive_by_year(pool: DataFrame, dead: DataFrame, runs: DataFrame, last: int, name: str = "name") -> DataFrame:
    """Number ``n`` and ``mean`` value of the pool rows alive in every run, guild and year 0..``last``.

    Deaths become a table of changes: what is left of a guild after each year with a death.  A year takes the last
    change up to it, so the work grows with deaths and years and not with their product.  A name is dead from its first
    death year on; guilds without survivors give no row.
    """
    amounts = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    base = per_run(pool.groupBy("guild").agg(*amounts), runs)
    first = dead.groupBy("run", name).agg(F.min("death_year").alias("year"))
    lost = first.join(pool.select(name, "guild", "value"), name).groupBy("run", "guild", "year").agg(*amounts)
    changes = base.withColumn("year", F.lit(0)).unionByName(lost.withColumns({"n": -F.col("n"), "total": -F.col("total")}))
    # A run and guild have a row per year at most.
    upto = Window.partitionBy("run", "guild").orderBy("year").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    states = changes.select("run", "guild", "year", F.struct(F.sum("n").over(upto).alias("n"), F.sum("total").over(upto).alias("total")).alias("s"))
    asked = base.select("run", "guild", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("year"))
    both = states.withColumn("ask", F.lit(0)).unionByName(asked.withColumn("ask", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("run", "guild").orderBy("year", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.withColumn("s", F.last("s", ignorenulls=True).over(order)).where("ask = 1 AND s.n > 0")
    return known.select("run", "guild", "year", F.col("s.n").alias("n"), (F.col("s.total") / F.col("s.n")).alias("mean"))


def against_baseline(df: DataFrame, baseline: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the baseline of their group next to them."""
    return same_keys(df, baseline, list(on), "left")
