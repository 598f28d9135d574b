"""Two-sample rank-sum tests between groups, multiplicity adjustment, region tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataguild.functions.normal import two_sided_p
from strataguild.functions.scalar import stars
from strataguild.operators.joins import same_keys
from strataguild.operators.order_stats import running, value_histogram
from strataguild.operators.rank_search import SHORT
from strataguild.operators.reshape import add_count_row, to_wide
from strataguild.session import marked, settle

EXACT_BELOW = 50


def level_counts(
    df: DataFrame, value: str, group: str, levels: Sequence[str], by: Sequence[str], totals: bool = False
) -> DataFrame:
    """Distinct values of each partition with one count per level and counts before them.

    Columns: ``by``, value, ``c0..ck`` counts, ``b0..bk`` counts of smaller values and,
    where asked for, ``t0..tk`` partition totals.
    """
    known = df.where(F.col(value).isNotNull() & F.col(group).isin(list(levels)))
    hist = known.groupBy(*by, value).agg(
        *[F.count(F.when(F.col(group) == lv, 1)).alias(f"c{i}") for i, lv in enumerate(levels)]
    )
    k = range(len(levels))
    return running(
        hist,
        by,
        value,
        [(f"b{i}", f"c{i}", "sum") for i in k],
        [(f"t{i}", f"c{i}") for i in k] if totals else [],
    )


def _part_sums(by: Sequence[str], names: Sequence[str], kinds: Sequence[pa.DataType], k: int):
    """Arrow function: rows of a part in value order -> what each group has in it.

    Rows are ``by``, the value ``_v``, ``_lv`` and ``_c``.  Out come counts per level ``_n`` and, for every two
    levels, ``_u``: values of the first above those of the second in this part, ties halved, and ``_t``: the tie terms.
    """
    at_once = max(1, (1 << 19) // (k * k))

    def changes(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for c in columns:
            codes = batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, open_ = TaskContext.get().partitionId(), None, None

        def emit(groups: Sequence) -> pa.RecordBatch:
            columns = [pa.concat_arrays([g[0][i] for g in groups]).cast(t) for i, t in enumerate(kinds)]
            columns.append(pa.array([part] * len(groups), pa.int32()))
            columns += [pa.array([g[1].ravel() for g in groups], pa.list_(pa.float64()))]
            columns += [pa.array([g[j].ravel() for g in groups], pa.list_(pa.float64())) for j in (2, 3)]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_n", "_u", "_t"])

        def summed(batch: pa.RecordBatch) -> list:
            """Groups that end in these rows; the last one stays open."""
            nonlocal open_
            new_group = changes(batch, by)
            new_value = new_group | changes(batch, ["_v"])
            place = np.cumsum(new_value) - 1
            c = np.zeros((place[-1] + 1, k))
            c[place, batch.column("_lv").to_numpy()] = batch.column("_c").to_numpy()
            heads = place[np.flatnonzero(new_group)]
            keys = [[batch.column(i).slice(int(at), 1) for i in range(len(by))] for at in np.flatnonzero(new_group)]
            same = open_ is not None and changes(
                pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(open_[0], keys[0])], names=list(by)), by
            ).sum() == 1
            before = np.cumsum(c, axis=0) - c
            starts = np.repeat(before[heads], np.diff(np.append(heads, len(c))), axis=0)
            before -= starts
            if same:
                before[: heads[1] if len(heads) > 1 else len(c)] += open_[1]
            n = np.add.reduceat(c, heads, axis=0)
            u = np.add.reduceat(c[:, :, None] * (before + c / 2)[:, None, :], heads, axis=0)
            pooled = c[:, :, None] + c[:, None, :]
            t = np.add.reduceat(pooled * pooled * pooled - pooled, heads, axis=0)
            groups = [list(g) for g in zip(keys, n, u, t, strict=True)]
            done = []
            if same:
                groups[0] = [open_[0], *(x + y for x, y in zip(open_[1:], groups[0][1:], strict=True))]
            elif open_ is not None:
                done.append(open_)
            open_ = groups.pop()
            return done + groups

        for batch in batches:
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            while batch.num_rows > at_once + k:
                new = np.flatnonzero(changes(batch.slice(0, at_once + k), [*by, "_v"]))
                cut = int(new[-1])
                if found := summed(batch.slice(0, cut)):
                    yield emit(found)
                batch = batch.slice(cut)
            waiting = batch
        if waiting is not None and waiting.num_rows:
            found = summed(waiting)
            yield emit([*found, open_])

    return run


def _pair_sums(df: DataFrame, value: str, group: str, levels: Sequence[str], by: Sequence[str], pairs: str) -> DataFrame:
    """``by, ia, ib, n_a, n_b, stat, _ties`` of every wanted pair.

    Counts per value and level are sorted into parts; a part sums its own pairs, and values of earlier parts are all
    smaller, so only its counts per level are needed for the pairs that reach over parts.
    """
    k = len(levels)
    known = df.where(F.col(value).isNotNull() & F.col(group).isin(list(levels)))
    level = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(group)).cast("int") - 1
    hist = known.groupBy(*by, F.col(value).alias("_v"), level.alias("_lv")).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    rows = hist.repartitionByRange(*by, "_v").sortWithinPartitions(*by, "_v")
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in by]
    names = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{names}_part int, _n array<double>, _u array<double>, _t array<double>"
    parts = settle(rows.mapInArrow(_part_sums(by, list(by), kinds, k), schema))
    two = F.array(*[F.struct(F.lit(i).alias("ia"), F.lit(j).alias("ib")) for i in range(k) for j in range(i + 1, k)])
    at = lambda c, i: F.get(c, i)
    ia, ib = F.col("ia"), F.col("ib")
    each = parts.select(*by, "_part", "_n", "_u", "_t", F.inline(two)).select(
        *by, "_part", "ia", "ib", at("_n", ia).alias("_a"), at("_n", ib).alias("_b"), at("_u", ia * k + ib).alias("_u"), at("_t", ia * k + ib).alias("_t")
    )
    # A group has one row a part at most.
    earlier = Window.partitionBy(*by, "ia", "ib").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_u", F.col("_u") + F.col("_a") * F.coalesce(F.sum("_b").over(earlier), F.lit(0.0)))
    sums = each.groupBy(*by, "ia", "ib").agg(
        F.sum("_a").cast("bigint").alias("n_a"), F.sum("_b").cast("bigint").alias("n_b"), F.sum("_u").alias("stat"), F.sum("_t").alias("_ties")
    )
    sums = sums.where("n_a > 0 AND n_b > 0")
    if pairs == "all":
        return sums
    # Neighbours among the levels that occur in this partition.
    nearest = F.min("ib").over(Window.partitionBy(*by, "ia"))
    return sums.withColumn("_next", nearest).where("ib = _next").drop("_next")


def level_name(index: str, levels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in levels]), F.col(index))


def rank_sum_laws(sizes: DataFrame) -> DataFrame:
    """``n_a, n_b, _law`` of every pair of sample sizes below ``EXACT_BELOW``: the chance of each U from 0 to n_a * n_b.

    The largest of the pooled values is one of a's with chance n_a / (n_a + n_b) and then beats all of b's; so the law
    of (n_a, n_b) is a mix of those of (n_a - 1, n_b), shifted, and (n_a, n_b - 1).  One row per distinct n_a carries
    the laws of all its n_b along, whatever the number of tests.
    """
    asked = sizes.select(F.col("n_a").cast("int"), F.col("n_b").cast("int")).distinct()
    one = F.array(F.lit(1.0))

    def next_row(before: Column, a: Column) -> Column:
        def law(b: Column, row: Column) -> Column:
            won = F.concat(F.array_repeat(F.lit(0.0), b), F.get(before, b))
            lost = F.concat(F.get(row, b - 1), F.array_repeat(F.lit(0.0), a))
            return F.zip_with(won, lost, lambda x, y: (x * a + y * b) / (a + b))

        return F.aggregate(F.sequence(F.lit(1), F.col("_most")), F.array(one), lambda row, b: F.concat(row, F.array(law(b, row))))

    start = F.transform(F.sequence(F.lit(0), F.col("_most")), lambda _: one)
    rows = asked.groupBy("n_a").agg(F.max("n_b").alias("_most"), F.collect_set("n_b").alias("_asked"))
    # As many rows as sizes below the bound.
    rows = rows.withColumn("_laws", F.aggregate(F.sequence(F.lit(1), F.col("n_a")), start, next_row))
    out = rows.select("n_a", "_laws", F.explode("_asked").alias("n_b"))
    return out.select(F.col("n_a").cast("bigint"), F.col("n_b").cast("bigint"), F.get("_laws", F.col("n_b")).alias("_law"))


def exact_rank_sum_p(law: Column, stat: Column) -> Column:
    """Two-sided p of U under its law; the law is symmetric, so the nearer tail counts twice."""
    last = F.size(law) - 1
    u = F.round(stat).cast("int")
    tail = F.aggregate(F.slice(law, 1, F.least(u, last - u) + 1), F.lit(0.0), lambda acc, x: acc + x)
    return F.least(F.lit(1.0), tail * 2.0)


def pairwise_rank_sum(
    df: DataFrame,
    value: str,
    group: str,
    levels: Sequence[str],
    by: Sequence[str] = (),
    pairs: str = "all",
    adjust: str = "none",
    family: Sequence[str] = (),
    exact: str = "auto",
    keep_dot: bool = True,
) -> DataFrame:
    """Two-sided rank-sum test of each wanted level pair within each partition.

    Rows are reduced to counts per distinct value and level; the pair sums are taken
    from running counts inside parts, so pairs of rows never arise and only the sums
    of a part are shuffled after its rows.  ``pairs`` is "all" or "adjacent".  ``exact="auto"``
    uses the exact law where both sizes are below 50 and values are untied.
    """
    by = list(by)
    sums = _pair_sums(df, value, group, levels, by, pairs)
    d = lambda name: F.col(name).cast("double")
    na, nb = d("n_a"), d("n_b")
    n = na + nb
    sigma = F.sqrt(na * nb / 12.0 * ((n + 1.0) - F.col("_ties") / (n * (n - 1.0))))
    centred = d("stat") - na * nb / 2.0
    z = (centred - F.signum(centred) * 0.5) / sigma
    p = F.when(sigma > 0, two_sided_p(z))
    if exact == "auto":
        small = (F.col("n_a") < EXACT_BELOW) & (F.col("n_b") < EXACT_BELOW) & (F.col("_ties") == 0)
        sums = settle(sums.withColumn("_p", p).withColumn("_small", F.coalesce(small, F.lit(False))))
        # At most one law per pair of sizes below the bound.
        laws = F.broadcast(settle(rank_sum_laws(sums.where("_small"))))
        own = (sums["n_a"] == laws["n_a"]) & (sums["n_b"] == laws["n_b"]) & F.col("_small")
        sums = sums.join(laws.select("n_a", "n_b", "_law"), own, "left").drop(laws["n_a"]).drop(laws["n_b"])
        p = F.when(F.col("_small"), exact_rank_sum_p(F.col("_law"), d("stat"))).otherwise(F.col("_p"))
    out = sums.select(
        *by,
        level_name("ia", levels).alias("group_a"),
        level_name("ib", levels).alias("group_b"),
        "n_a",
        "n_b",
        "stat",
        p.alias("p"),
    )
    if adjust == "holm":
        out = p_adjust(out, "p", family)
        out = out.withColumn("stars", stars(F.col("p_adj"), blank_dot=not keep_dot))
    return out


def p_adjust(df: DataFrame, p: str = "p", family: Sequence[str] = (), name: str = "p_adj") -> DataFrame:
    """Holm step-down adjustment within each family; null p-values do not count.

    Equal p-values are counted, stepped down as one and get the same adjusted value: the first of them is scaled the
    most, and the others can't fall below it.
    """
    # A table of tests is costly to compute, so it is computed once.
    df = settle(df)
    counts = settle(value_histogram(df, family, p))
    if counts.limit(SHORT + 1).count() <= SHORT:
        upto = Window.partitionBy(*family).orderBy(p)
        before = F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.sum("n").over(Window.partitionBy(*family)) - before
        stepped = counts.withColumn("_score", left * F.col(p)).withColumn("_top", F.max("_score").over(upto))
    else:
        ranked = running(counts, family, p, [("_before", "n", "sum")], [("_m", "n")])
        scored = ranked.withColumn("_score", (F.col("_m") - F.col("_before")) * F.col(p))
        stepped = running(scored, family, p, [("_top", "_score", "max")], inclusive=True)
    adjusted = marked(settle(stepped.select(*family, p, F.least(F.lit(1.0), F.col("_top")).alias(name))))
    return same_keys(df, adjusted, [*family, p], "left").select(*df.columns, name)


def among_region_table(
    tests: DataFrame, guild: str, guild_levels: Sequence[str], adjust_name: str = "p_adj"
) -> DataFrame:
    """Pair table: one row per region pair, one adjusted-p column per guild, counts last.

    The adjustment runs over all pairs and guilds together.
    """
    adjusted = p_adjust(tests, "p", (), adjust_name)
    labelled = adjusted.withColumn("pair", F.concat_ws(" - ", "group_a", "group_b"))
    wide = to_wide(labelled, ["pair"], guild, adjust_name, guild_levels)
    return add_count_row(wide, "pair", list(guild_levels))
