"""Permutation test for the difference of one percentile between two groups.

Shuffling the labels of a pair only decides which positions of the pooled, sorted
values each group takes, and its percentile needs just two of those positions.
Replicates draw those positions directly from their exact joint law.  The default
mode draws how many of a group lie below a place near the percentile and walks from
there, one position and one whole number at a time, so that other SQL engines can
repeat it; its cost grows with the root of the pair's size.  ``draws="beta"`` costs
the same for ten rows and for ten billion.  Few distinct positions are looked up in
the running counts, however many replicates there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataguild.functions.seeded import PRIME, finished, fold_in, key_state, mix31
from strataguild.operators.joins import same_keys
from strataguild.operators.order_stats import running, values_at_ranks
from strataguild.operators.quantiles import quantiles
from strataguild.operators.rank_search import ACCURACY, edge_shares, stretch
from strataguild.operators.rank_tests import level_name
from strataguild.session import marked, measured, settle, stored

BLOCK = 250
WALK_BLOCK = 5000
# Standard deviations of the first draw that are listed; the chance beyond is below 1e-300.
REACH = 40
# Differences are compared after rounding, so equal differences stay equal.
DIGITS = 9
# Bits of a key (31 in all) that are left after each pass over the dealt rows.
KEY_BITS = (24, 12)


def position_sampler(tau: float):
    """Pandas UDF: (seed, n_a, n_b, reps) -> flat array of four pooled ranks per replicate.

    The ranks are those of the two order statistics around ``tau`` in each group.
    Group members are uniform points on (0, 1): the two order statistics are beta
    variables, and the other group's members below them are binomial.
    """

    @F.pandas_udf("array<bigint>")
    def draw(seed: pd.Series, n_a: pd.Series, n_b: pd.Series, reps: pd.Series) -> pd.Series:
        import numpy as np

        def edges(g, n, r):
            k = int(np.floor((n - 1) * tau)) + 1
            low = g.beta(k, n - k + 1, r)
            if k == n:
                return k, k, low, low
            return k, k + 1, low, low + (1.0 - low) * g.beta(1, n - k, r)

        def share(part, whole):
            return np.clip(np.divide(part, whole, out=np.zeros_like(part), where=whole > 0), 0.0, 1.0)

        def others_below(g, k, k2, n, low, high, c1, c2):
            """Members of a group with known k-th (k2-th) points that lie below c1 and c2."""
            head = np.full(len(low), k - 1)
            first = g.binomial(head, share(np.minimum(c1, low), low))
            more = g.binomial(
                head - first,
                share(np.minimum(c2, low) - np.minimum(c1, low), low - np.minimum(c1, low)),
            )
            tail = np.full(len(low), n - k2)
            over = g.binomial(tail, share(np.maximum(c1 - high, 0.0), 1.0 - high))
            rest = g.binomial(
                tail - over,
                share(np.maximum(c2, high) - np.maximum(c1, high), 1.0 - np.maximum(c1, high)),
            )
            known = [low] if k2 == k else [low, high]
            at1 = first + over + sum((x < c1).astype(np.int64) for x in known)
            at2 = first + more + over + rest + sum((x < c2).astype(np.int64) for x in known)
            return at1, at2

        out = []
        for s, na, nb, r in zip(seed, n_a, n_b, reps):
            na, nb, r = int(na), int(nb), int(r)
            g = np.random.Generator(np.random.PCG64(int(s) % (1 << 63)))
            ka, ka2, u1, u2 = edges(g, na, r)
            kb, kb2, v1, v2 = edges(g, nb, r)
            b1, b2 = others_below(g, kb, kb2, nb, v1, v2, u1, u2)
            a1, a2 = others_below(g, ka, ka2, na, u1, u2, v1, v2)
            ranks = np.stack([ka + b1, ka2 + b2, kb + a1, kb2 + a2], axis=1)
            out.append(ranks.astype(np.int64).ravel())
        return pd.Series(out)

    return draw


def below_law(n_a: int, n_b: int, first: int):
    """Values and running chances of how many of group a are among the ``first`` pooled positions."""
    import numpy as np

    n = n_a + n_b
    mean = first * n_a / n
    spread = REACH * (np.sqrt(mean * (n_b / n) * (n - first) / max(1, n - 1)) + 1)
    low, high = max(0, first - n_b, int(mean - spread)), min(n_a, first, int(mean + spread) + 1)
    x = np.arange(low, high + 1, dtype=float)
    ratio = (n_a - x[:-1]) * (first - x[:-1]) / ((x[:-1] + 1) * (n_b - first + x[:-1] + 1))
    logs = np.concatenate(([0.0], np.cumsum(np.log(ratio))))
    p = np.exp(logs - logs.max())
    return np.arange(low, high + 1), np.cumsum(p) / p.sum()


def walked_ranks(tau: float, state: int, n_a: int, n_b: int, first_rep: int, reps: int):
    """Four pooled ranks a replicate: of the two order statistics around ``tau`` in group a and in group b.

    A draw from ``below_law`` says how many of a are among the first positions; from there the labels of further
    positions are drawn one by one upwards, and those of the positions passed downwards, until all four are met.
    """
    import numpy as np

    def order(n: int) -> tuple[int, int]:
        k = int(np.floor((n - 1) * tau)) + 1
        return k, min(k + 1, n)

    wanted = [*order(n_a), *order(n_b)]
    start, n = wanted[0] + wanted[2], n_a + n_b
    own = fold_in(np.int64(state), np.arange(first_rep, first_rep + reps, dtype=np.int64))
    u = (finished(fold_in(own, 1)) * PRIME + finished(fold_in(own, 2))).astype(float) / float(PRIME * PRIME)
    values, chances = below_law(n_a, n_b, start)
    below = values[np.minimum(np.searchsorted(chances, u), len(values) - 1)].astype(np.int64)
    ranks = np.zeros((reps, 4), np.int64)

    def note(rows, of_a, count, at):
        """Positions of group members whose number is a wanted one."""
        for i, k in enumerate(wanted):
            hit = (of_a if i < 2 else ~of_a) & (count == k)
            ranks[rows[hit], i] = at[hit]

    for up, key in ((True, 3), (False, 4)):
        states = fold_in(own, key)
        rows, at, a, step = np.arange(reps), np.full(reps, start, np.int64), below.copy(), 0
        while True:
            b = at - a
            live = (a < wanted[1]) | (b < wanted[3]) if up else (a >= wanted[0]) | (b >= wanted[2])
            rows, at, a, b = rows[live], at[live], a[live], b[live]
            if not len(rows):
                break
            step += 1
            w = finished(fold_in(states[rows], step))
            if up:
                of_a = w * (n - at) < (n_a - a) * PRIME
                at, a = at + 1, a + of_a
                note(rows, of_a, np.where(of_a, a, at - a), at)
            else:
                of_a = w * at < a * PRIME
                note(rows, of_a, np.where(of_a, a, b), at)
                at, a = at - 1, a - of_a
    return ranks


def walk_sampler(tau: float):
    """Pandas UDF: (state, n_a, n_b, first replicate, replicates) -> flat array of four pooled ranks per replicate."""

    @F.pandas_udf("array<bigint>")
    def draw(state: pd.Series, n_a: pd.Series, n_b: pd.Series, first: pd.Series, reps: pd.Series) -> pd.Series:
        rows = zip(state, n_a, n_b, first, reps, strict=True)
        return pd.Series([walked_ranks(tau, int(s), int(a), int(b), int(f), int(r)).ravel() for s, a, b, f, r in rows])

    return draw


def _wanted_pairs(levels: Sequence[str], pairs: str) -> Column:
    """One row per wanted pair (a, b) of the levels that have an entry in the array ``_l``."""
    pos = F.sequence(F.lit(0), F.lit(len(levels) - 1))
    cross = F.flatten(
        F.transform(pos, lambda i: F.transform(pos, lambda j: F.struct(i.alias("a"), j.alias("b"))))
    )

    def wanted(p):
        both = (p["a"] < p["b"]) & F.get("_l", p["a"]).isNotNull() & F.get("_l", p["b"]).isNotNull()
        if pairs == "all":
            return both
        between = F.slice("_l", p["a"] + 2, p["b"] - p["a"] - 1)
        return both & ~F.exists(between, lambda x: x.isNotNull())

    return F.explode(F.filter(cross, wanted))


def percentile_differences(
    df: DataFrame,
    value: str,
    group: str,
    levels: Sequence[str],
    by: Sequence[str] = (),
    tau: float = 0.9,
    pairs: str = "all",
) -> DataFrame:
    """Observed difference of the tau-quantile (a minus b) for each wanted pair, with sizes."""
    by = list(by)
    known = df.where(F.col(group).isin(list(levels)))
    q = quantiles(known, [*by, group], value, (("q", tau),))
    cell = F.struct("n", "q")
    arr = [F.max(F.when(F.col(group) == lv, cell)) for lv in levels]
    # Tests need two groups; a global partition is a group of its own.
    wide = q.groupBy(*by).agg(F.array(*arr).alias("_l"))
    out = wide.withColumn("_p", _wanted_pairs(levels, pairs))
    a, b = F.get("_l", F.col("_p.a")), F.get("_l", F.col("_p.b"))
    return out.select(
        *by,
        F.col("_p.a").alias("ia"),
        F.col("_p.b").alias("ib"),
        a["n"].alias("n_a"),
        b["n"].alias("n_b"),
        (a["q"] - b["q"]).alias("diff"),
    )


def _near_shares(tau: float) -> list[float]:
    """Where a summary is asked for edges: ever closer to ``tau``."""
    return edge_shares([min(1.0, max(0.0, tau + d / (1 << j))) for j in range(5, 13) for d in (-1, 1)])


def _named(df: DataFrame, by: Sequence[str], levels: Sequence[str], *rest) -> DataFrame:
    return df.select(
        *by, level_name("ia", levels).alias("group_a"), level_name("ib", levels).alias("group_b"), *rest
    )


def pairwise_percentile_test(
    df: DataFrame,
    value: str,
    group: str,
    levels: Sequence[str],
    by: Sequence[str] = (),
    tau: float = 0.9,
    r: int = 5000,
    seed: int = 1234,
    pairs: str = "all",
    draws: str = "walk",
) -> DataFrame:
    """Share of r label permutations whose absolute difference reaches the observed one.

    ``draws`` is "walk" (repeatable in SQL, for pairs below 2^32 rows) or "beta".
    """
    if not by:
        one = pairwise_percentile_test(
            df.withColumn("_all", F.lit(1)), value, group, levels, ["_all"], tau, r, seed, pairs, draws
        )
        return one.drop("_all")
    by = list(by)
    key = [*by, "ia", "ib"]
    k = range(len(levels))
    level = F.coalesce(*[F.when(F.col(group) == lv, F.lit(i)) for i, lv in enumerate(levels)])
    known = df.where(F.col(value).isNotNull() & F.col(group).isin(list(levels)))
    # Read three times: for edges, for the counts between them and for the values near a wanted rank.
    rows = stored(known.select(*by, level.alias("_lv"), value))
    edges = measured(rows.groupBy(*by).agg(F.percentile_approx(value, _near_shares(tau), F.lit(ACCURACY)).alias("_edges")))
    level_sizes = [F.count(F.when(F.col("_lv") == i, 1)).alias(f"c{i}") for i in k]
    at = stretch(F.col(value), F.col("_edges")).alias("_at")
    counts = settle(same_keys(rows, edges, by).select(*by, "_lv", at).groupBy(*by, "_at").agg(*level_sizes))
    # As many rows a partition as there are stretches.
    earlier = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.withColumns({f"b{i}": F.coalesce(F.sum(f"c{i}").over(earlier), F.lit(0)) for i in k}))
    sizes = counts.groupBy(*by).agg(F.array(*[F.nullif(F.sum(f"c{i}"), F.lit(0)) for i in k]).alias("_l"))
    tested = sizes.withColumn("_p", _wanted_pairs(levels, pairs)).select(*by, F.col("_p.a").alias("ia"), F.col("_p.b").alias("ib"), "_l")
    tested = settle(tested.select(*key, F.get("_l", F.col("ia")).alias("n_a"), F.get("_l", F.col("ib")).alias("n_b")))

    block = {"walk": WALK_BLOCK, "beta": BLOCK}[draws]
    blocks = tested.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit((r - 1) // block))))
    blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "_blk")
    count = F.least(F.lit(block), F.lit(r) - F.col("_blk") * block)
    if draws == "walk":
        drawn = walk_sampler(tau)(key_state([F.col(c) for c in key], seed, "hash"), "n_a", "n_b", F.col("_blk") * block + 1, count)
    else:
        drawn = position_sampler(tau)(F.xxhash64(F.lit(seed), *key, "_blk"), "n_a", "n_b", count)
    four = lambda i: F.struct(*[F.get("_r", i * 4 + j).alias(f"_p{j}") for j in range(4)])
    reps = blocks.withColumn("_r", drawn).select(
        *key, "n_a", "n_b", F.inline(F.transform(F.sequence(F.lit(0), (F.size("_r") / 4).cast("int") - 1), four))
    )
    # Replicates that took the same positions have the same difference.
    reps = settle(reps.groupBy(*key, "n_a", "n_b", *[f"_p{j}" for j in range(4)]).agg(F.count(F.lit(1)).alias("_reps")))
    positions = F.explode(F.array(*[F.col(f"_p{j}") for j in range(4)]))
    asked = reps.select(*key, (F.col("n_a") + F.col("n_b")).alias("n_total"), positions.alias("rank")).distinct()
    # A level alone, for the observed percentile, is a pair with itself.
    low, weight = lambda n: F.floor((n - 1) * tau) + 1, lambda n: (n - 1) * tau - F.floor((n - 1) * tau)
    alone = sizes.select(*by, F.posexplode("_l").alias("ia", "n_total")).where(F.col("n_total").isNotNull())
    alone = settle(same_keys(alone, tested.select(*by).distinct(), by, "left_semi"))
    n = F.col("n_total")
    own = alone.select(*by, "ia", F.col("ia").alias("ib"), n, F.explode(F.array(low(n), F.least(low(n) + 1, n))).alias("rank"))
    asked = asked.unionByName(own.distinct())
    spans = measured(
        asked.groupBy(*key).agg(
            F.min("rank").alias("_lo"), F.max("rank").alias("_hi"), F.first("n_total").alias("n_total")
        )
    )

    # Only the stretch of pooled positions that some replicate asks for goes on.
    ia, ib = F.col("ia"), F.col("ib")
    both = lambda x: F.get(f"_{x}", ia) + F.when(ia == ib, F.lit(0)).otherwise(F.get(f"_{x}", ib))
    inside = (both("c") > 0) & (both("b") < F.col("_hi")) & (both("b") + both("c") >= F.col("_lo"))
    listed = lambda d, *rest: d.select(*by, *rest, *[F.array(*[F.col(f"{x}{i}") for i in k]).alias(f"_{x}") for x in "cb"])
    hit = same_keys(listed(counts, "_at"), spans, by).where(inside).select(*by, "_at").distinct()
    hit = measured(same_keys(counts.select(*by, "_at", *[F.col(f"b{i}").alias(f"_before{i}") for i in k]), hit, [*by, "_at"], "left_semi"))
    # Edges around all of them: rows outside need no search.
    reach = same_keys(hit.groupBy(*by).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")), edges, by)
    reach = measured(
        reach.select(
            *by, "_edges", F.get("_edges", F.expr("int((_first + 1) div 2 - 1)")).alias("_low"), F.get("_edges", F.expr("int(_last div 2)")).alias("_high")
        )
    )
    within = F.coalesce(F.col(value) >= F.col("_low"), F.lit(True)) & F.coalesce(F.col(value) <= F.col("_high"), F.lit(True))
    near = same_keys(rows, reach, by).where(within).select(*by, "_lv", value, at)
    place = [*by, "_at"]
    near = same_keys(near, hit.select(*place), place, "left_semi").groupBy(*place, value).agg(*level_sizes)
    near = same_keys(running(near, place, value, [(f"b{i}", f"c{i}", "sum") for i in k]), hit, place)
    near = near.withColumns({f"b{i}": F.col(f"b{i}") + F.col(f"_before{i}") for i in k})
    near = same_keys(listed(near, value), spans, by).where(inside)
    near = near.select(*key, value, both("c").alias("n"), both("b").alias("n_before"), "n_total")
    found = measured(values_at_ranks(near, asked, key, value))

    level_found = same_keys(found.where(ia == ib).drop("ib"), alone, [*by, "ia"])
    at_rank = lambda rank: F.max(F.when(F.col("rank") == rank, F.col(value)))
    level_found = level_found.groupBy(*by, "ia", "n_total").agg(at_rank(low(n)).alias("_l"), at_rank(F.least(low(n) + 1, n)).alias("_h"))
    q = settle(level_found.select(*by, "ia", (F.col("_l") + (F.col("_h") - F.col("_l")) * weight(n)).cast("double").alias("_q")))
    observed = same_keys(tested, q.withColumnRenamed("_q", "_qa"), [*by, "ia"])
    observed = same_keys(observed, q.select(*by, ia.alias("ib"), F.col("_q").alias("_qb")), [*by, "ib"])
    observed = measured(observed.select(*key, (F.col("_qa") - F.col("_qb")).alias("diff")))
    for j in range(4):
        reps = same_keys(reps, found.select(*key, F.col("rank").alias(f"_p{j}"), F.col(value).alias(f"_v{j}")), [*key, f"_p{j}"])
    q_a = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * weight(F.col("n_a"))
    q_b = F.col("_v2") + (F.col("_v3") - F.col("_v2")) * weight(F.col("n_b"))
    reached = F.round(F.abs(q_a - q_b), DIGITS) >= F.round(F.abs(F.col("diff")), DIGITS)
    out = same_keys(reps, observed, key).groupBy(*key, "n_a", "n_b", "diff").agg(
        F.sum(F.when(reached, F.col("_reps")).otherwise(0)).alias("hits"), F.sum("_reps").alias("r")
    )
    return _named(out, by, levels, "n_a", "n_b", "diff", "hits", (F.col("hits") / F.col("r")).alias("p"))


def permutation_key(row_id, rep):
    """Order in which a replicate deals the rows of a pair: a quadratic integer mix."""
    return mix31([row_id, rep], seed=0)


def pairwise_percentile_test_dealt(
    df: DataFrame,
    value: str,
    group: str,
    levels: Sequence[str],
    row_id: str,
    by: Sequence[str] = (),
    tau: float = 0.9,
    r: int = 20,
    pairs: str = "all",
) -> DataFrame:
    """The same test with every row dealt in every replicate, repeatable in any SQL engine.

    Replicate ``rep`` sorts the rows of a pair by an integer mix of (row id, rep) and
    gives the first ``n_a`` to group a; rows with equal keys are taken in value order.
    The work is rows x r, so this mode is for checking at small r; only counts of the
    dealt rows, and the few near the last row of a or near the percentile, are kept.
    """
    by = list(by)
    key = [*by, "ia", "ib"]
    level = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(group)) - 1
    known = df.where(F.col(value).isNotNull() & F.col(group).isin(list(levels)))
    # Read in every pass below; rows of replicates are never kept, only counts of them.
    rows = stored(known.select(*by, level.cast("int").alias("_lv"), F.col(row_id).alias("_row"), F.col(value).alias("_value")))
    named = rows.withColumn("_name", level_name("_lv", levels))
    observed = measured(percentile_differences(named, "_value", "_name", levels, by, tau, pairs))
    # A row takes part in every pair of its level.
    sides = observed.select(*key, F.explode(F.array("ia", "ib")).alias("_lv"))

    def dealt(state: DataFrame, *fields: str) -> DataFrame:
        """Rows of every pair and replicate with their keys, beside what is known of the replicate."""
        deals = state.groupBy(*key).agg(F.collect_list(F.struct("rep", *fields)).alias("_deals"))
        taking = same_keys(rows, measured(same_keys(sides, deals, key)), [*by, "_lv"])
        listed = taking.select(*key, "_row", "_value", F.inline("_deals"))
        # Keys are not negative; rows without an id come first.
        return listed.withColumn("_key", F.coalesce(permutation_key(F.col("_row"), F.col("rep")), F.lit(-1)))

    # The key of the last row that a takes, by its leading bits first.
    each = [*key, "rep"]
    state = observed.select(*key, "n_a", F.explode(F.sequence(F.lit(1), F.lit(r))).alias("rep"), F.lit(0).cast("bigint").alias("_before"))
    here = (F.col("_before") < F.col("n_a")) & (F.col("_before") + F.col("_n") >= F.col("n_a"))
    at = None
    for bits in KEY_BITS:
        spread = dealt(state, "n_a", "_before", *([] if at is None else ["_at"]))
        if at is not None:
            spread = spread.where(F.shiftright("_key", at) == F.col("_at"))
        counts = settle(spread.groupBy(*each, "n_a", "_before", F.shiftright("_key", bits).alias("_at")).agg(F.count(F.lit(1)).alias("_n")))
        # A replicate has as many rows as there are leading bits.
        earlier = Window.partitionBy(*each).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        state, at = measured(counts.where(here).select(*each, "n_a", "_before", "_at")), bits
    near = dealt(state, "n_a", "_before", "_at").where(F.shiftright("_key", at) == F.col("_at"))
    near = near.groupBy(*each, "n_a", "_before", "_key", "_value").agg(F.count(F.lit(1)).alias("_n"))
    near = running(near, each, "_key", [("_earlier", "_n", "sum")], ties=["_value"]).withColumn("_before", F.col("_before") + F.col("_earlier"))
    taken = F.col("n_a") - F.col("_before")
    last = measured(near.where(here).select(*each, F.col("_key").alias("_last"), F.col("_value").alias("_at_last"), taken.alias("_taken"), "_n"))

    # Counts between edges near the percentile say where the wanted ranks of either side lie.
    pooled = same_keys(rows, marked(sides), [*by, "_lv"])
    edges = measured(pooled.groupBy(*key).agg(F.percentile_approx("_value", _near_shares(tau), F.lit(ACCURACY)).alias("_edges")))
    last = measured(same_keys(last, edges, key))
    ahead = (F.col("_key") < F.col("_last")) | ((F.col("_key") == F.col("_last")) & (F.col("_value") < F.col("_at_last")))
    tied = (F.col("_key") == F.col("_last")) & (F.col("_value") == F.col("_at_last"))
    amounts = [F.struct(F.lit(True).alias("in_a"), F.col("_taken").alias("_w")), F.struct(F.lit(False).alias("in_a"), (F.col("_n") - F.col("_taken")).alias("_w"))]
    split = last.select(*each, F.col("_at_last").alias("_value"), stretch(F.col("_at_last"), F.col("_edges")).alias("_at"), F.inline(F.array(*amounts)))
    split = settle(split.where("_w > 0"))
    one = F.lit(1).cast("bigint").alias("_w")

    def sided(known: DataFrame, *fields: str) -> DataFrame:
        """Every dealt row with its side and stretch, without the rows that equal the last one."""
        found = same_keys(dealt(known, "_last", "_at_last", *fields).where(~tied), edges, key)
        return found.select(*each, "_value", *fields, ahead.alias("in_a"), stretch(F.col("_value"), F.col("_edges")).alias("_at"), one)

    side = [*each, "in_a"]
    counts = sided(last).groupBy(*side, "_at").agg(F.sum("_w").alias("_w")).unionByName(split.drop("_value"))
    counts = settle(counts.groupBy(*side, "_at").agg(F.sum("_w").alias("_w")))
    # As many rows a side as there are stretches.
    earlier = Window.partitionBy(*side).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_w").over(earlier), F.lit(0)), "_total": F.sum("_w").over(Window.partitionBy(*side))})
    low = F.floor((F.col("_total") - 1) * tau) + 1
    ranks = {"_low": low, "_high": F.least(low + 1, F.col("_total"))}
    holds = lambda k: (F.col(k) > F.col("_before")) & (F.col(k) <= F.col("_before") + F.col("_w"))
    hits = counts.withColumns(ranks).where(holds("_low") | holds("_high")).drop("_w")
    hits = measured(hits)
    asked = F.struct("in_a", "_at")
    wanted = measured(same_keys(last, hits.groupBy(*each).agg(F.collect_list(asked).alias("_asked")), each))
    found = sided(wanted, "_asked").where(F.array_contains("_asked", asked)).drop("_asked")
    place = [*side, "_at"]
    found = found.unionByName(same_keys(split, hits.select(*place), place, "left_semi"))
    found = found.groupBy(*place, "_value").agg(F.sum("_w").alias("_w"))
    found = running(found, place, "_value", [("_earlier", "_w", "sum")])
    found = same_keys(found, hits, place).withColumn("_before", F.col("_before") + F.col("_earlier"))
    found = found.groupBy(*side, "_total").agg(*[F.max(F.when(holds(k), F.col("_value"))).alias(f"{k}_value") for k in ranks])
    weight = (F.col("_total") - 1) * tau - F.floor((F.col("_total") - 1) * tau)
    q = found.withColumn("q", F.col("_low_value") + (F.col("_high_value") - F.col("_low_value")) * weight)
    reps = q.groupBy(*each).agg((F.max(F.when(F.col("in_a"), F.col("q"))) - F.max(F.when(~F.col("in_a"), F.col("q")))).alias("_d"))
    both = same_keys(reps, observed, key)
    hit = F.round(F.abs(F.col("_d")), DIGITS) >= F.round(F.abs(F.col("diff")), DIGITS)
    tested = both.groupBy(*key, "n_a", "n_b", "diff").agg(
        F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.count(F.lit(1)).alias("r")
    )
    return _named(tested, by, levels, "n_a", "n_b", "diff", "hits", (F.col("hits") / F.col("r")).alias("p"))
