"""Exact grouped quantiles and summaries built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataguild.operators.joins import same_keys
from strataguild.operators.order_stats import value_histogram, values_at_ranks, with_positions
from strataguild.operators.rank_search import SHORT, values_of_wanted
from strataguild.session import measured, settle

FIVE = (("q0", 0.0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q100", 1.0))
# Probabilities of the resampling summary.
RESAMPLE = (
    ("y0", 0.0),
    ("y5", 0.05),
    ("y25", 0.25),
    ("y50", 0.5),
    ("y75", 0.75),
    ("y95", 0.95),
    ("y100", 1.0),
)
BOX_REACH = 1.5


def _wanted(total: str, probs: Sequence[tuple[str, float]]) -> str:
    """SQL array of (key, rank) for the two order statistics around every quantile."""
    items = []
    for name, p in probs:
        low = f"(cast(floor(({total} - 1) * {p!r}D) AS bigint) + 1)"
        items.append(f"named_struct('key', '{name}/low', 'rank', {low})")
        items.append(f"named_struct('key', '{name}/high', 'rank', least({low} + 1, {total}))")
    return f"array({', '.join(items)})"


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[tuple[str, float]],
    method: str = "rescan",
    weight: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one named column per probability, plus ``n``.

    The input is computed once.  ``rescan`` keeps its rows and shuffles only those near a
    wanted rank; ``histogram`` counts equal values first, for inputs of few distinct ones.
    ``builtin`` keeps a group in one task and is for groups whose size is bounded by a
    parameter, such as a draw count.
    """
    if method == "builtin":
        if weight is not None:
            args = [F.array(*[F.lit(p) for _, p in probs]), F.col(weight)]
            total = F.sum(weight).cast("bigint")
        else:
            args = [F.array(*[F.lit(p) for _, p in probs])]
            total = F.count(value)
        found = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
            total.alias("n"), F.percentile(F.col(value), *args).alias("_q")
        )
        return found.select(*by, "n", *[F.col("_q")[i].alias(name) for i, (name, _) in enumerate(probs)])
    return interpolated(order_statistics(df, by, value, probs, method, weight), by, probs)


def order_statistics(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[tuple[str, float]],
    method: str = "rescan",
    weight: str | None = None,
    short: int = SHORT,
) -> DataFrame:
    """Group size ``n`` and a map from "name/low" and "name/high" to the values at those ranks."""
    if method == "histogram":
        df, weight = value_histogram(df, by, value, weight), "n"
    elif method != "rescan":
        raise ValueError(f"unknown method {method!r}")
    rows = settle(df.where(F.col(value).isNotNull()).select(*by, value, *([weight] if weight else [])))
    picked = values_of_wanted(rows, by, value, _wanted("_total", probs), [p for _, p in probs], weight, short)
    # Two entries per quantile and group.
    return picked.groupBy(*by).agg(
        F.max("_total").alias("n"), F.map_from_entries(F.collect_list(F.struct("_key", value))).alias("_v")
    )


def interpolated(found: DataFrame, by: Sequence[str], probs: Sequence[tuple[str, float]]) -> DataFrame:
    """Quantile columns from the map of order statistics."""
    out = []
    for name, p in probs:
        low, high, h = f"_v['{name}/low']", f"_v['{name}/high']", f"((n - 1) * {p!r}D)"
        out.append(F.expr(f"double({low} + ({high} - {low}) * ({h} - floor({h})))").alias(name))
    return found.select(*by, "n", *out)


def five_number(df: DataFrame, by: Sequence[str], value: str, method: str = "rescan") -> DataFrame:
    return quantiles(df, by, value, FIVE, method)


def resample_summary(df: DataFrame, by: Sequence[str], value: str, method: str = "rescan") -> DataFrame:
    """Seven quantiles, mean ``avg`` and standard deviation ``stddev`` per group."""
    moments = [F.avg(value).alias("avg"), F.stddev_samp(value).alias("stddev")]
    if method == "builtin":
        probs = F.array(*[F.lit(p) for _, p in RESAMPLE])
        one = df.groupBy(*by).agg(
            F.count(value).alias("n"), F.percentile(F.col(value), probs).alias("_q"), *moments
        )
        return one.select(
            *by, "n", *[F.col("_q")[i].alias(name) for i, (name, _) in enumerate(RESAMPLE)], "avg", "stddev"
        )
    q = quantiles(df, by, value, RESAMPLE, method)
    return same_keys(q, df.groupBy(*by).agg(*moments), by)


def central_interval(df: DataFrame, by: Sequence[str], value: str, method: str = "rescan") -> DataFrame:
    """Mean with central 95% and 50% intervals."""
    # Tail probabilities of the two intervals.
    probs = (("low_ci", 0.025), ("upp_ci", 0.975), ("low_ci_50", 0.25), ("upp_ci_50", 0.75))
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return same_keys(mean, quantiles(df, by, value, probs, method).drop("n"), by)


def boxplot_stats(df: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Hinges and whiskers per group, and the rows that lie beyond the whiskers."""
    probs = (("lower", 0.25), ("middle", 0.5), ("upper", 0.75))
    hinges = quantiles(df, by, value, probs)
    reach = BOX_REACH * (F.col("upper") - F.col("lower"))
    fences = measured(
        hinges.withColumn("_lo", F.col("lower") - reach).withColumn("_hi", F.col("upper") + reach)
    )
    rows = same_keys(df.where(F.col(value).isNotNull()), fences, by)
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    kept = ["n", "lower", "middle", "upper"]
    stats = rows.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in kept],
        F.min(F.when(inside, F.col(value))).alias("ymin"),
        F.max(F.when(inside, F.col(value))).alias("ymax"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers"),
    )
    return stats, rows.where(~inside).select(*df.columns)


def trimmed_mean(df: DataFrame, by: Sequence[str], value: str, trim: float) -> DataFrame:
    """Mean without the lowest and highest ``trim`` share of each group.

    A trim of one half or more gives the median.
    """
    if trim >= 0.5:
        return quantiles(df, by, value, (("trimmed_mean", 0.5),), method="histogram").drop("n")
    hist = with_positions(value_histogram(df, by, value), by, value)
    cut = F.floor(F.col("n_total") * trim)
    kept = F.greatest(
        F.lit(0),
        F.least(F.col("n_before") + F.col("n"), F.col("n_total") - cut)
        - F.greatest(F.col("n_before"), cut),
    )
    return hist.groupBy(*by).agg((F.sum(kept * F.col(value)) / F.sum(kept)).alias("trimmed_mean"))


def hdi(df: DataFrame, by: Sequence[str], value: str, mass: float = 0.95) -> DataFrame:
    """Shortest interval that holds the given share of each group, the lowest one on ties."""
    pos = with_positions(value_histogram(df, by, value), by, value)
    # A start at the first copy of a value reaches least far, so one start per value is enough.
    ask = pos.select(
        *by,
        (F.col("n_before") + 1 + F.floor(F.col("n_total") * mass)).cast("bigint").alias("rank"),
        "n_total",
        F.col(value).alias("_low"),
    ).where(F.col("rank") <= F.col("n_total"))
    found = values_at_ranks(pos, ask, by, value)
    best = F.min(F.struct((F.col(value) - F.col("_low")).alias("w"), F.col("_low"), F.col(value).alias("_high")))
    return (
        found.groupBy(*by)
        .agg(best.alias("_b"))
        .select(*by, F.col("_b._low").alias("low"), F.col("_b._high").alias("upp"))
    )
