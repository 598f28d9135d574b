"""Grouped summaries that are plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataguild.functions.nulls import propagate
from strataguild.functions.scalar import normal_interval, trunc
from strataguild.operators.joins import same_keys
from strataguild.operators.quantiles import quantiles
from strataguild.session import measured, settle


def group_counts(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def with_group_size(df: DataFrame, by: Sequence[str], name: str = "species") -> DataFrame:
    """Repeat the group's row count on each of its rows.

    Counts are taken first and joined back, so a large group stays spread out.
    """
    return same_keys(df, group_counts(df, by, name), by)


def range_summary(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Smallest, largest and median value with the names that hold the extremes.

    Nulls are skipped; on ties the name that sorts first is reported.
    """
    rows = settle(df.where(F.col(value).isNotNull()).select(*by, value, name))
    # Plain extremes first, then the names among the few rows that hold them.
    ends = measured(rows.groupBy(*by).agg(F.min(value).alias("min_size"), F.max(value).alias("max_size")))
    found = ends
    for end, which in (("min_size", "which_min"), ("max_size", "which_max")):
        held = same_keys(rows, ends.select(*by, end), by).where(F.col(value) == F.col(end))
        names = held.groupBy(*by, name).agg(F.count(F.lit(1)).alias("_n"))
        first = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(name).asc_nulls_first()))
        names = names.withColumn("_first", first).where(F.col("_first") == 1).select(*by, F.col(name).alias(which))
        found = same_keys(found, names, by)
    med = quantiles(rows, by, value, (("med_size", 0.5),)).drop("n")
    return same_keys(found, med, by).select(*by, "min_size", "which_min", "max_size", "which_max", "med_size")


def period_contrasts(
    ranges: DataFrame, by: Sequence[str], period: str = "bin", modern: str = "Modern", future: str = "Future"
) -> DataFrame:
    """Overall range, midrange, and the modern and future medians and maxima of a range table."""

    def only(label: str, col: str) -> Column:
        return F.max(F.when(F.col(period) == label, F.col(col)))

    return ranges.groupBy(*by).agg(
        F.min("min_size").alias("minimum"),
        F.max("max_size").alias("maximum"),
        ((F.max("max_size") + F.min("min_size")) / 2).alias("avg"),
        F.max("med_size").alias("med"),
        only(modern, "med_size").alias("extant_med"),
        only(future, "med_size").alias("future_med"),
        only(modern, "max_size").alias("extant_max"),
        only(future, "max_size").alias("future_max"),
    )


def mean_of_distinct(df: DataFrame, by: Sequence[str], value: str, na: str = "propagate") -> DataFrame:
    """Mean over the distinct rows of (by, value)."""
    rows = df.select(*by, value).dropDuplicates()
    mean = F.avg(value)
    return rows.groupBy(*by).agg((propagate(mean, F.col(value)) if na == "propagate" else mean).alias(value))


def merge_duplicates(
    df: DataFrame,
    by: Sequence[str],
    source: str,
    priority: Sequence[str],
    picks: Sequence[str],
    row_order: Sequence[str],
    texts: Sequence[str] = (),
    highest: Sequence[str] = (),
    lowest: Sequence[str] = (),
    means: Sequence[str] = (),
    stack_order: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key from several ranked sources.

    ``picks`` come from the first row of the best-ranked source; ``texts`` become the
    distinct non-null texts in first-seen order; ``highest``, ``lowest`` and ``means``
    aggregate and turn null if any input is null; ``sources`` lists the source of
    every merged row.  Rows count as stacked in ``stack_order`` of their sources and
    by ``row_order`` inside one.
    """
    stack = list(stack_order or priority)
    rank = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col(source))
    place = F.array_position(F.array(*[F.lit(s) for s in stack]), F.col(source))
    seq = F.struct(place.alias("s"), *[F.col(c) for c in row_order])
    rows = df.withColumn("_rank", rank).withColumn("_seq", seq)
    best = F.min(F.struct(F.col("_rank"), F.col("_seq"), *[F.col(c) for c in picks]))
    per_source = [F.sum(F.when(F.col(source) == s, 1).otherwise(0)).cast("int") for s in stack]
    merged = rows.groupBy(*by).agg(
        *[propagate(F.max(c), F.col(c)).alias(c) for c in highest],
        *[propagate(F.min(c), F.col(c)).alias(c) for c in lowest],
        *[propagate(F.avg(c), F.col(c)).alias(c) for c in means],
        best.alias("_best"),
        # Counted, not collected: the text is rebuilt from the counts.
        F.concat(*[F.repeat(F.lit(f", {s}"), n) for s, n in zip(stack, per_source)]).alias("_src"),
    )
    merged = merged.select(
        *by,
        *[F.col(c) for c in (*highest, *lowest, *means)],
        *[F.col(f"_best.{c}").alias(c) for c in picks],
        F.substring(F.col("_src"), 3, 2_000_000_000).alias("sources"),
    )
    for text in texts:
        seen = rows.where(F.col(text).isNotNull()).groupBy(*by, text).agg(F.min("_seq").alias("_seq"))
        joined = F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_seq", text))), lambda x: x[text]), ", "
        )
        merged = same_keys(merged, seen.groupBy(*by).agg(joined.alias(text)), by, "left")
        merged = merged.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return merged


def weighted_mean_var(df: DataFrame, by: Sequence[str], value: str, weight: Column) -> DataFrame:
    """Weighted mean and unbiased frequency-weighted variance; null weights are skipped."""
    rows = df.select(*by, F.col(value).alias("_x"), weight.alias("_w")).where(
        F.col("_w").isNotNull() & F.col("_x").isNotNull()
    )
    mean = rows.groupBy(*by).agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("wtd_mean"), F.sum("_w").alias("_sw")
    )
    # One row per group, counted before it is sent out, so the second scan shuffles nothing.
    dev = same_keys(rows, measured(mean), by)
    spread = dev.groupBy(*by).agg(
        F.first("wtd_mean").alias("wtd_mean"),
        (F.sum(F.col("_w") * F.pow(F.col("_x") - F.col("wtd_mean"), 2)) / (F.first("_sw") - 1)).alias("wtd_var"),
    )
    return spread


def inverse_variance(sd: Column) -> Column:
    """1 / sd^2, null where sd is zero."""
    return F.when(sd != 0, 1.0 / (sd * sd))


def mean_of(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def group_mean_model(df: DataFrame, by: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Group means with a variance of their own: estimate, standard error, t and interval."""
    fit = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("estimate"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("std_error"),
    )
    low, high = normal_interval(F.col("estimate"), F.col("std_error"), z)
    return fit.withColumns(
        {"statistic": F.col("estimate") / F.col("std_error"), "low": low, "upp": high}
    )


def abs_limit(df: DataFrame, low: str, high: str, slack: float = 1.01) -> DataFrame:
    """Symmetric axis limit that holds all intervals."""
    lim = F.greatest(F.abs(F.min(low)), F.abs(F.max(high))) * slack
    return df.agg(lim.alias("limit"))


def log_shift(df: DataFrame, rate: str) -> DataFrame:
    """Rates shifted to be non-negative and put on a shifted log10 scale.

    Adds ``corr_rate`` (rate minus the smallest rate) and ``log_corr_rate`` =
    log10(corr_rate + 10^c) - c with c the truncated log10 of the smallest positive
    corrected rate.  Both constants are single-row aggregates.
    """
    corr = F.col(rate) - df.agg(F.min(rate)).scalar()
    shifted = df.withColumn("corr_rate", corr)
    c = shifted.where(F.col("corr_rate") > 0).agg(trunc(F.log10(F.min("corr_rate"))).cast("double")).scalar()
    return shifted.withColumn("log_corr_rate", F.log10(F.col("corr_rate") + F.pow(F.lit(10.0), c)) - c)
