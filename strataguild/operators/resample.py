"""Seeded resampling with replacement.

A draw is a whole number computed from its key, read as a position in the sorted
values of its group.  Nothing depends on row order or partitioning.

A resample at full size is never laid out.  How many of its draws fall into each block
of positions is found by splitting their number in halves again and again; draws inside
a block are made where the block's values are, and only sums and wanted values leave it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataguild.functions.seeded import PRIME, draw_rank, draw_states, finish_sums, fold_in, key_state, opened
from strataguild.operators.joins import same_keys
from strataguild.operators.order_stats import value_histogram, values_at_ranks, with_positions
from strataguild.operators.quantiles import RESAMPLE, interpolated, resample_summary
from strataguild.operators.summaries import inverse_variance
from strataguild.session import settle

DRAW_BLOCK = 1 << 16
# Positions of a block of a resample, about; draws that one task splits at once; coin flips in a random word.
POSITIONS = 1 << 10
SPLIT_DRAWS = 1 << 24
FLIPS = 24
# Blocks that travel in one row, as a power of two; replicates of a row at most; draws that are made at once, about.
RUN = 5
REPLICATES = 1 << 10
DRAWS_AT_ONCE = 1 << 15
# Trims used when averaging each statistic over replicates.
META_TRIMS = {"y0": 0.0, "y5": 0.05, "y25": 0.25, "y50": 0.5, "y75": 0.75, "y95": 0.95, "y100": 1.0}


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a short table of work items over the cluster before it is blown up."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def _numbered(df: DataFrame, name: str, last: Column) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), last)))


def _draws(items: DataFrame, by: Sequence[str], keys: Sequence[str], count: str, seed: int, rng: str) -> DataFrame:
    """One row per draw 1..count of every work item, with the rank it picks."""
    states = draw_states([F.col(c) for c in (*by, *keys)], seed, rng)
    # The shuffle that spreads the blocks also fixes the states.
    blocks = items.withColumns(states).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / DRAW_BLOCK)))
    )
    blocks = _spread(blocks, *by, *keys, "_b")
    start = F.col("_b") * DRAW_BLOCK
    draws = blocks.withColumn(
        "draw", F.explode_outer(F.sequence(start + 1, F.least(start + DRAW_BLOCK, F.col(count).cast("bigint"))))
    )
    ranked = draws.withColumn("rank", draw_rank(F.col("draw"), F.col("n_total")))
    return ranked.drop("_b", "draw", *states)


def subsample(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sizes: Sequence[int],
    reps: int,
    seed: int = 1234,
    rng: str = "hash",
) -> DataFrame:
    """Summary of ``reps`` samples of each size from every group.

    Adds ``species`` (group size), ``sample`` (size) and ``rep``.
    """
    pos = with_positions(value_histogram(df, by, value), by, value)
    sized = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"))
    items = sized.withColumn("sample", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    items = _numbered(items, "rep", F.lit(reps))
    draws = _draws(items, by, ["sample", "rep"], "sample", seed, rng)
    drawn = values_at_ranks(pos, draws.withColumn("species", F.col("n_total")), by, value)
    # A sample has at most max(sizes) rows, so it may stay in one task.
    out = resample_summary(drawn, [*by, "species", "sample", "rep"], value, "builtin")
    return out.drop("n")


def _heads(states: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Heads among the coin flips ``first`` to ``last - 1`` of every node; ``first`` starts a word and is below ``last``."""
    words = -(-last // FLIPS) - first // FLIPS
    ends = np.cumsum(words)
    sums = np.repeat(opened(states) + first // FLIPS - (ends - words), words).astype(np.uint64)
    sums += np.arange(len(sums), dtype=np.uint64)
    finish_sums(sums)
    sums &= (1 << FLIPS) - 1
    # The last word of a node may hold flips beyond its draws.
    sums[ends - 1] &= ((1 << np.where(last % FLIPS, last % FLIPS, FLIPS)) - 1).astype(np.uint64)
    return np.add.reduceat(np.bitwise_count(sums), ends - words, dtype=np.int64)


def split(state: int, node: int, draws: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes ``levels`` below a node that get any of its draws, and their draws, each half by a coin flip a draw."""
    nodes, m = np.array([node], np.int64), np.array([draws], np.int64)
    for _ in range(levels):
        left = _heads(fold_in(np.int64(state), nodes), np.zeros_like(m), m)
        nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
        m = np.stack([left, m - left], axis=1).ravel()
        nodes, m = nodes[m > 0], m[m > 0]
    return nodes, m


def block_runs(items: DataFrame, by: Sequence[str], split_draws: int = SPLIT_DRAWS) -> DataFrame:
    """``by, rep, _first, _before, _m``: draws of every replicate in stretches of blocks, and in all blocks before them.

    ``items`` have ``by``, ``rep``, ``n_total``, ``_levels`` (a group has two to that power blocks) and ``_tree``, the
    state of the replicate's coin flips.  More than ``split_draws`` draws are halved in slices, a level at a time; the
    rest is split where it is.  A row holds at most two to the power ``RUN`` blocks, in a stretch that starts at a
    multiple of their number.
    """
    key = [*by, "rep"]
    nodes = items.select(*key, "_tree", "_levels", F.lit(1).cast("bigint").alias("_node"), F.col("n_total").alias("_m"))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    names = ", ".join(f"`{k}` {kinds[k]}" for k in key)

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(*[batch.column(c).to_pylist() for c in ("_tree", "_node", "_m", "_slice")], strict=True)
            whole = lambda x: np.array([x], np.int64)
            ones = [
                int(_heads(fold_in(whole(t), n), whole(s * split_draws), whole(min(m, (s + 1) * split_draws)))[0])
                for t, n, m, s in parts
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (*key, "_tree", "_levels", "_node", "_m")] + [pa.array(ones, pa.int64())],
                names=[*key, "_tree", "_levels", "_node", "_m", "_left"],
            )

    done = None
    while (most := nodes.where(f"_levels > 0 AND _m > {split_draws}").agg(F.max("_levels")).first()[0]) is not None and most:
        long = nodes.where(f"_levels > 0 AND _m > {split_draws}")
        rest = nodes.where(f"NOT (_levels > 0 AND _m > {split_draws})")
        done = rest if done is None else done.unionByName(rest)
        slices = _spread(long.withColumn("_slice", F.explode(F.expr(f"sequence(0L, (_m - 1) div {split_draws})"))), *key, "_slice")
        schema = f"{names}, _tree bigint, _levels int, _node bigint, _m bigint, _left bigint"
        halves = slices.mapInArrow(flip, schema).groupBy(*key, "_tree", "_levels", "_node", "_m").agg(F.sum("_left").alias("_left"))
        sides = F.array(
            F.struct((F.col("_node") * 2).alias("_node"), F.col("_left").alias("_m")),
            F.struct((F.col("_node") * 2 + 1).alias("_node"), (F.col("_m") - F.col("_left")).alias("_m")),
        )
        nodes = halves.select(*key, "_tree", (F.col("_levels") - 1).alias("_levels"), F.inline(sides)).where("_m > 0")
        nodes = settle(nodes.select(*key, "_tree", "_levels", "_node", "_m"))
    nodes = nodes if done is None else done.unionByName(nodes)
    # A replicate has one node, or one for every slice.
    earlier = Window.partitionBy(*key).orderBy(F.expr("shiftleft(_node, _levels)")).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, first, before, lists = [], [], [], []
            parts = zip(*[batch.column(c).to_pylist() for c in ("_tree", "_node", "_m", "_levels", "_before")], strict=True)
            for i, (t, n, m, k, b) in enumerate(parts):
                leaves, draws = split(t, n, m, k)
                counts = np.zeros(1 << k, np.int64)
                counts[leaves - (n << k)] = draws
                # The leading one of a leaf's number tells its level; without it, it is the block's place.
                start, width = (n << k) - (1 << (n << k).bit_length() - 1), 1 << min(k, RUN)
                rows = counts.reshape(-1, width)
                at += [i] * len(rows)
                first += range(start, start + len(counts), width)
                before += (b + np.cumsum(rows.sum(axis=1)) - rows.sum(axis=1)).tolist()
                lists += list(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(at, pa.int64())) for c in key]
                + [pa.array(first, pa.int64()), pa.array(before, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                names=[*key, "_first", "_before", "_m"],
            )

    schema = f"{names}, _first bigint, _before bigint, _m array<bigint>"
    return _spread(nodes, *key, "_node").mapInArrow(descend, schema)


def block_counts(items: DataFrame, by: Sequence[str], split_draws: int = SPLIT_DRAWS) -> DataFrame:
    """``by, rep, _block, _m``: draws of every replicate in every block that gets any."""
    runs = block_runs(items, by, split_draws).select(*by, "rep", "_first", F.posexplode("_m").alias("_i", "_m"))
    return runs.where("_m > 0").select(*by, "rep", (F.col("_first") + F.col("_i")).alias("_block"), "_m")


def _run_values(pos: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by, _run, _starts, _values``: first positions of the runs of equal values, and these, in every row of blocks.

    Block ``j`` of ``b`` stands for the positions whose shares of the group overlap ``[j / b, (j + 1) / b)``.
    """
    blocks = "shiftleft(1L, _levels)"
    first = f"shiftright((n_before * {blocks}) div n_total, {RUN})"
    last = f"shiftright(((n_before + n) * {blocks} - 1) div n_total, {RUN})"
    runs = pos.withColumn("_run", F.explode(F.expr(f"sequence({first}, {last})")))
    start = F.greatest(F.col("n_before"), F.expr(f"shiftleft(_run, {RUN}) * n_total div {blocks}"))
    entry = F.struct(start.alias("s"), F.col(value).cast("double").alias("v"))
    # One entry a position at most, and a block has a set number of positions.
    return runs.groupBy(*by, "_run").agg(F.collect_list(entry).alias("_r")).select(
        *by, "_run", F.col("_r.s").alias("_starts"), F.col("_r.v").alias("_values")
    )


def _block_draws(states: tuple[int, int], block: int, levels: int, total: int, reps: np.ndarray, draws: np.ndarray) -> Iterator[tuple]:
    """Some replicates at a time: their first and last number, where their draws begin, and the places drawn in the block."""
    number = (1 << levels) + block
    open_ = [opened(fold_in(fold_in(np.int64(s), reps), number)) for s in states]
    ends = np.cumsum(draws)
    # The places of a block are numbered from the first that overlaps it.
    shift = (block * total) % (1 << levels)
    i = 0
    while i < len(reps):
        done = ends[i] - draws[i]
        j = max(i + 1, int(np.searchsorted(ends, done + DRAWS_AT_ONCE, side="right")))
        m = draws[i:j]
        begins = ends[i:j] - m - done
        order = np.arange(ends[j - 1] - done, dtype=np.uint64)
        high, low = (np.repeat(o[i:j] - begins + 1, m).astype(np.uint64) for o in open_)
        for part in (high, low):
            part += order
            finish_sums(part)
        high *= PRIME
        high += low
        np.floor_divide(high, np.uint64(total), out=low)
        low *= np.uint64(total)
        high -= low
        high += np.uint64(shift)
        high >>= np.uint64(levels)
        yield i, j, begins, high.view(np.int64)
        i = j


def _block_sums(states, block: int, levels: int, total: int, held, reps, draws, wants, shift: float):
    """Sums of the draws that fall into a block and of their squares, for each of some replicates, and wanted values.

    ``held`` has the value of every place of the block; ``wants`` has (replicate's number, key, rank in the block).
    """
    centred = held - shift
    squares = centred * centred
    sums, picks = np.empty((2, len(reps))), []
    wanted = sorted(wants)
    for i, j, begins, places in _block_draws(states, block, levels, total, reps, draws):
        sums[0, i:j] = np.add.reduceat(centred.take(places, mode="clip"), begins)
        sums[1, i:j] = np.add.reduceat(squares.take(places, mode="clip"), begins)
        last, ordered = None, None
        while wanted and wanted[0][0] < j:
            r, key, rank = wanted.pop(0)
            if r != last:
                last, ordered = r, np.sort(places[begins[r - i] : begins[r - i] + draws[r]])
            picks.append((r, key, float(held[ordered[rank - 1]])))
    return sums, picks


def _held(starts: np.ndarray, values: np.ndarray, first: int, last: int) -> np.ndarray:
    """The value at each of the places ``first`` to ``last``, from runs of equal values that start at ``starts``."""
    inside = slice(int(np.searchsorted(starts, first, side="right")) - 1, int(np.searchsorted(starts, last, side="right")))
    begins = np.maximum(starts[inside], first)
    return np.repeat(values[inside], np.diff(np.append(begins, last + 1)))


def _block_places(block: int, levels: int, total: int) -> tuple[int, int]:
    """First and last place that overlaps a block."""
    return block * total >> levels, ((block + 1) * total - 1) >> levels


def _drawn_sums(state_high: int, state_low: int, block: int, levels: int, total: int, starts, values, reps, draws, wants, shift: float) -> list[dict]:
    """Sums and wanted values of the draws that fall into a block, for each of some replicates."""
    held = _held(np.asarray(starts), np.asarray(values), *_block_places(block, levels, total))
    asked = [(i, w["key"], w["rank"]) for i, want in enumerate(wants) for w in want]
    sums, picks = _block_sums((state_high, state_low), block, levels, total, held, np.asarray(reps, np.int64), draws, asked, shift)
    out = [{"rep": r, "s1": float(a), "s2": float(b), "picks": []} for r, a, b in zip(reps, *sums, strict=True)]
    for i, key, x in picks:
        out[i]["picks"].append({"key": key, "value": x})
    return out


def _wanted_ranks(total: int) -> list[tuple[str, int]]:
    """Key and rank of the two order statistics around every quantile of a resample."""
    low = {name: int(np.floor((total - 1) * p)) + 1 for name, p in RESAMPLE}
    return [(f"{name}/{side}", k if side == "low" else min(k + 1, total)) for name, k in low.items() for side in ("low", "high")]


def _run_sums(states, run: int, levels: int, total: int, starts, values, rep, first, before, lengths, counts, shift: float):
    """Replicates, their sums over a row of blocks and their wanted values there.

    ``rep``, ``first``, ``before`` and ``lengths`` describe stretches of blocks, ``counts`` their draws one after another.
    """
    order = np.argsort(starts, kind="stable")
    starts, values = starts[order], values[order]
    reps, place = np.unique(rep, return_inverse=True)
    ends = np.cumsum(lengths)
    at = np.repeat(first - (run << RUN), lengths) + np.arange(len(counts)) - np.repeat(ends - lengths, lengths)
    so_far = np.cumsum(counts) - counts
    earlier = so_far + np.repeat(before - so_far[ends - lengths], lengths)
    draws, passed = (np.zeros((int(at.max()) + 1, len(reps)), np.int64) for _ in range(2))
    draws[at, np.repeat(place, lengths)] = counts
    passed[at, np.repeat(place, lengths)] = earlier
    ranks = _wanted_ranks(total)
    sums, picks = np.zeros((2, len(reps))), [[] for _ in reps]
    for i, m in enumerate(draws):
        own = np.flatnonzero(m)
        if not len(own):
            continue
        block, b = (run << RUN) + i, passed[i][own]
        wants = [(int(r), key, int(k - b[r])) for key, k in ranks for r in np.flatnonzero((k > b) & (k <= b + m[own]))]
        held = _held(starts, values, *_block_places(block, levels, total))
        found, picked = _block_sums(states, block, levels, total, held, reps[own], m[own], wants, shift)
        sums[:, own] += found
        for r, key, x in picked:
            picks[own[r]].append({"key": key, "value": x})
    return reps, sums, picks


def bootstrap(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    reps: int,
    seed: int = 1234,
    rng: str = "hash",
    positions: int = POSITIONS,
    split_draws: int = SPLIT_DRAWS,
) -> DataFrame:
    """Summary of ``reps`` resamples of each group at its full size ``species``.

    The draws of a replicate are multinomial over equally likely blocks of at most about
    ``positions`` positions.  A block is read once for all replicates; shuffled are its counts
    of draws and, for each replicate and row of blocks, one pair of sums, never the draws.
    """
    pos = with_positions(value_histogram(df, by, value), by, value)
    pos = settle(pos.select(*by, value, "n", "n_before", "n_total"))
    sized = pos.groupBy(*by).agg(
        F.max("n_total").alias("n_total"), (F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("_shift")
    )
    levels = F.expr(f"CASE WHEN n_total <= {positions} THEN 0 ELSE length(bin((n_total - 1) div {positions})) END").cast("int")
    states = {f"_{name}": key_state([F.col(c) for c in by], seed + i, rng) for i, name in enumerate(("high", "low", "tree"))}
    sized = settle(sized.withColumn("_levels", levels).withColumns(states))
    items = _numbered(sized.select(*by, "n_total", "_levels", "_tree"), "rep", F.lit(reps))
    # The replicate is folded into the state, so that its coin flips are its own.
    items = items.withColumn("_tree", F.expr("(_tree * 48271 + rep % 2147483647 + 11) % 2147483647"))
    items = items.withColumn("_tree", F.expr("((_tree * _tree) % 2147483647 * 69621 + 7919) % 2147483647"))
    runs = settle(block_runs(_spread(items, *by, "rep"), by, split_draws))

    stretch = F.struct("rep", "_first", "_before", "_m").alias("_s")
    runs = runs.select(*by, F.expr(f"shiftright(_first, {RUN})").alias("_run"), F.expr(f"rep div {REPLICATES}").alias("_set"), stretch)
    per_run = runs.groupBy(*by, "_run", "_set").agg(F.collect_list("_s").alias("_reps"))
    values = same_keys(_run_values(same_keys(pos, sized.select(*by, "_levels"), by), by, value), sized, by)
    work = same_keys(values, per_run, [*by, "_run"])
    place = {c: i for i, c in enumerate(work.columns)}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(place[c])[i]  # noqa: B023, E731
                listed = get("_reps").values
                rep, first, before = (listed.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "_first", "_before"))
                m = listed.field("_m")
                reps, found, picks = _run_sums(
                    (get("_high").as_py(), get("_low").as_py()), get("_run").as_py(), get("_levels").as_py(), get("n_total").as_py(),
                    get("_starts").values.to_numpy(), get("_values").values.to_numpy(),
                    rep, first, before, m.value_lengths().to_numpy(), m.flatten().to_numpy(), get("_shift").as_py(),
                )
                keys = [pa.repeat(get(c), len(reps)) for c in (*by, "n_total", "_shift")]
                rest = [pa.array(v, t) for v, t in zip((reps, *found, picks), sums.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(keys + rest, names=[*by, "n_total", "_shift", *sums])

    pick = pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())]))
    sums = {"rep": pa.int32(), "s1": pa.float64(), "s2": pa.float64(), "picks": pick}
    names = ", ".join(f"`{c}` {work.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{names}, n_total bigint, _shift double, rep int, s1 double, s2 double, picks array<struct<key:string,value:double>>"
    drawn = work.repartition(*by, "_run", "_set").mapInArrow(draw, schema)
    total = drawn.groupBy(*by, "n_total", "_shift", "rep").agg(
        F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.flatten(F.collect_list("picks")).alias("_p")
    )
    total = total.select(
        *by, F.col("n_total").alias("species"), "rep", F.map_from_entries("_p").alias("_v"), F.col("n_total").alias("n"),
        (F.col("_shift") + F.col("s1") / F.col("n_total")).alias("avg"),
        F.when(F.col("n_total") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n_total")) / (F.col("n_total") - 1)))).alias("stddev"),
    )
    keys = [*by, "species", "rep"]
    kept = interpolated(total, [*keys, "avg", "stddev"], RESAMPLE)
    return kept.select(*keys, *[name for name, _ in RESAMPLE], "avg", "stddev")


def _trimmed(ordered: Column, trim: float) -> Column:
    """Trimmed mean of a sorted array; a trim of one half or more gives the median."""
    n = F.size(ordered)
    cut = F.least(F.floor(n * trim), F.floor((n - 1) / 2)).cast("int")
    kept = F.slice(ordered, cut + 1, n - 2 * cut)
    return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x) / F.size(kept)


def resample_meta(summary: DataFrame, by: Sequence[str], min_n: int) -> DataFrame:
    """Statistics over replicates: trimmed means, spread of the means, weighted mean.

    ``by`` names the group columns, with the sample size where there is one; groups of
    fewer than ``min_n`` rows are left out.
    """
    keys = [*by, "species"]
    kept = summary.where(F.col("species") >= min_n)
    # A group has one row per replicate, a count set by the caller, so its sorted
    # replicates fit in one short array.
    arrays = kept.groupBy(*keys).agg(
        F.stddev_samp("avg").alias("raw_sd"),
        F.avg("avg").alias("raw_mean"),
        F.collect_list(F.struct(F.col("avg").alias("x"), inverse_variance(F.col("stddev")).alias("w"))).alias("_xw"),
        *[F.array_sort(F.collect_list(name)).alias(f"_{name}") for name, _ in RESAMPLE],
    )
    weighted = F.filter("_xw", lambda r: r["w"].isNotNull() & r["x"].isNotNull())
    sum_of = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda acc, r: acc + f(r))
    out = arrays.withColumn("_xw", weighted).withColumns(
        {
            "_sw": sum_of(F.col("_xw"), lambda r: r["w"]),
            "wtd_mean": sum_of(F.col("_xw"), lambda r: r["w"] * r["x"]) / sum_of(F.col("_xw"), lambda r: r["w"]),
        }
    )
    spread = sum_of(F.col("_xw"), lambda r: r["w"] * F.pow(r["x"] - F.col("wtd_mean"), F.lit(2.0)))
    return out.select(
        *keys,
        "raw_sd",
        "raw_mean",
        *[_trimmed(F.col(f"_{name}"), META_TRIMS[name]).alias(name) for name, _ in RESAMPLE],
        "wtd_mean",
        (spread / (F.col("_sw") - 1)).alias("wtd_var"),
    )
