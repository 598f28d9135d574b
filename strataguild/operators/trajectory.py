"""Quantiles of the survivors of each run in each year.

Every guild's pool of values is shared by all runs; a run only removes names from
it.  The distinct values of a guild are numbered in order, and the wanted survivor
is found digit by digit of that number.  One step looks at the survivors per digit and
year of a (run, guild, leading digits) cell, a table of bounded size, so a step does
not grow with the pool, and a pool of 256^L distinct values takes L steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.operators.joins import same_keys
from strataguild.operators.order_stats import running, value_histogram
from strataguild.operators.reshape import stack_loose
from strataguild.session import settle

BASE = 256

_ASKED = (("p_no", "int"), ("side", "int"), ("year", "int"), ("rank", "bigint"), ("weight", "double"))
_STEP_SCHEMA = "run int, guild string, prefix bigint, " + ", ".join(f"{c} {t}" for c, t in _ASKED)


def _step_kernel(years: list[int], probs: list[float], first: bool):
    """One digit step inside a (run, guild, prefix) cell.

    Input rows are of three kinds: pool counts per digit, deaths per digit and year,
    and the ranks asked for.  The first step derives the ranks from the survivors.
    """

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        base = 256  # BASE, kept local so that the kernel carries everything it needs
        run, guild, prefix = pdf["run"].iloc[0], pdf["guild"].iloc[0], int(pdf["prefix"].iloc[0])
        kind = pdf["kind"].to_numpy()
        grid = np.asarray(years)
        size = np.zeros(base, dtype=np.int64)
        for digits, counts in zip(pdf["digits"][kind == 0], pdf["counts"][kind == 0]):
            size[np.asarray(digits, dtype=np.int64)] = np.asarray(counts, dtype=np.int64)
        dead = np.zeros((len(grid) + 1, base), dtype=np.int64)
        gone = pdf[kind == 1]
        # A death counts from the first grid year that is not before it.
        at = np.searchsorted(grid, gone["year"].to_numpy(dtype=np.int64), side="left")
        np.add.at(dead, (at, gone["digit"].to_numpy(dtype=np.int64)), gone["n"].to_numpy(dtype=np.int64))
        alive = size[None, :] - np.cumsum(dead[: len(grid)], axis=0)
        upto = np.cumsum(alive, axis=1)
        if first:
            total = upto[:, -1]
            rows = np.flatnonzero(total > 0)
            parts = []
            for i, p in enumerate(probs):
                h = (total[rows] - 1) * p
                low = np.floor(h).astype(np.int64) + 1
                high = np.minimum(low + 1, total[rows])
                for side, rank in ((0, low), (1, high)):
                    parts.append((np.full(len(rows), i), np.full(len(rows), side), rows, rank, h - np.floor(h)))
            if not parts:
                return pd.DataFrame(columns=["run", "guild", "prefix", "p_no", "side", "year", "rank", "weight"])
            p_no, side, row, rank, weight = (np.concatenate(x) for x in zip(*parts))
        else:
            ask = pdf[kind == 2]
            p_no = ask["p_no"].to_numpy(dtype=np.int64)
            side = ask["side"].to_numpy(dtype=np.int64)
            row = np.searchsorted(grid, ask["year"].to_numpy(dtype=np.int64))
            rank = ask["rank"].to_numpy(dtype=np.int64)
            weight = ask["weight"].to_numpy(dtype=float)
        digit = (upto[row] < rank[:, None]).sum(axis=1)
        before = np.where(digit > 0, upto[row, np.maximum(digit - 1, 0)], 0)
        return pd.DataFrame(
            {
                "run": run,
                "guild": guild,
                "prefix": prefix * base + digit,
                "p_no": p_no,
                "side": side,
                "year": grid[row],
                "rank": rank - before,
                "weight": weight,
            }
        )

    return step


def survivor_quantiles(
    pool: DataFrame,
    events: DataFrame,
    runs: DataFrame,
    probs: Sequence[tuple[str, float]],
    years: Sequence[int],
    name: str = "name",
    guild: str = "guild",
    value: str = "value",
) -> DataFrame:
    """Quantiles of the pool values alive after each listed year, per run and guild.

    ``events`` has run, name and ``death_year``; a name without an event in a run
    survives it.  ``runs`` lists every run.  A guild without survivors has no row.
    """
    years = sorted(int(y) for y in years)
    known = pool.where(F.col(value).isNotNull()).select(
        F.col(name).alias("name"), F.col(guild).alias("guild"), F.col(value).cast("double").alias("value")
    )
    hist = value_histogram(known, ["guild"], "value").withColumn("_one", F.lit(1))
    numbered = settle(
        running(hist, ["guild"], "value", [("no", "_one", "sum")]).select("guild", "value", "n", "no")
    )
    most = numbered.agg(F.max("no")).first()[0]
    digits = 1
    while most is not None and BASE**digits <= most:
        digits += 1

    dead = events.where(F.col("death_year") <= years[-1]).select("run", F.col(name).alias("name"), "death_year")
    pool_no = same_keys(known, numbered, ["guild", "value"]).select("name", "guild", "no")
    deaths = (
        dead.join(pool_no, "name")
        .groupBy(F.col("run").cast("int").alias("run"), "guild", "no", F.col("death_year").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if digits > 1:
        deaths = settle(deaths)

    def cut(df: DataFrame, level: int) -> DataFrame:
        """Leading digits and the digit of this level."""
        unit = BASE ** (digits - 1 - level)
        number = F.floor(F.col("no") / F.lit(unit)).cast("bigint")
        return df.withColumns(
            {"prefix": F.floor(number / BASE).cast("bigint"), "digit": F.pmod(number, F.lit(BASE)).cast("int")}
        )

    cell = ["run", "guild", "prefix"]
    asked = None
    for level in range(digits):
        # At most BASE digits below a prefix: a short list per (guild, prefix).
        below = F.array_sort(F.collect_list(F.struct("digit", "n")))
        sizes = (
            cut(numbered, level)
            .groupBy("guild", "prefix", "digit")
            .agg(F.sum("n").alias("n"))
            .groupBy("guild", "prefix")
            .agg(below.alias("_d"))
            .select("guild", "prefix", F.col("_d.digit").alias("digits"), F.col("_d.n").alias("counts"))
        )
        died = cut(deaths, level).groupBy(*cell, "digit", "year").agg(F.sum("n").alias("n"))
        if asked is None:
            # Every run starts with the whole pool; one short list per guild.
            whole = sizes.agg(F.collect_list(F.struct(*sizes.columns)).alias("_all")).scalar()
            parts = [runs.select("run", F.inline(whole)), died]
        else:
            cells = asked.select(*cell).distinct()
            parts = [same_keys(cells, sizes, ["guild", "prefix"]), same_keys(died, cells, cell, "left_semi"), asked]
        both = stack_loose(*[part.withColumn("kind", F.lit(i)) for i, part in enumerate(parts)])
        both = both.withColumns({c: F.lit(None).cast(t) for c, t in _ASKED if c not in both.columns})
        kernel = _step_kernel(years, [p for _, p in probs], asked is None)
        asked = both.groupBy(*cell).applyInPandas(kernel, _STEP_SCHEMA)
        if level < digits - 1:
            asked = settle(asked)

    found = same_keys(asked.withColumnRenamed("prefix", "no"), numbered.select("guild", "no", "value"), ["guild", "no"])
    out = []
    for i, (label, _) in enumerate(probs):
        mine = F.col("p_no") == i
        low = F.max(F.when(mine & (F.col("side") == 0), F.col("value")))
        high = F.max(F.when(mine & (F.col("side") == 1), F.col("value")))
        weight = F.max(F.when(mine, F.col("weight")))
        out.append((low + (high - low) * weight).alias(label))
    return found.groupBy("run", "guild", "year").agg(*out)
