"""Size distributions through simulated future extinctions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataguild.functions import classify as C
from strataguild.functions.nulls import not_in_set
from strataguild.functions.scalar import percent_change, positive_ln
from strataguild.operators.joins import against_baseline, same_keys
from strataguild.operators.quantiles import central_interval, five_number, hdi, quantiles
from strataguild.operators.reshape import stack_loose
from strataguild.operators.summaries import abs_limit, mean_of
from strataguild.operators.trajectory import survivor_quantiles
from strataguild.session import settle
from strataguild.sources.files import read_stage, write_stage

FIVE_NAMES = (("y0", 0.0), ("y25", 0.25), ("y50", 0.5), ("y75", 0.75), ("y100", 1.0))
# Species that survive only in captivity.
EXTINCT_IN_WILD = ("Elaphurus davidianus", "Oryx dammah")
YEARS = 500
CHANGES = ("mean", "low_ci", "upp_ci", "low_ci_50", "upp_ci_50")


def pleistocene_pool(present: DataFrame, extinct: DataFrame) -> DataFrame:
    """Living species (name, value, three shares) and extinct ones (mass instead of value)."""
    shares = ["diet_plant", "diet_vert", "diet_inv"]
    gone = extinct.withColumn("value", positive_ln(F.col("mass"))).select("name", "value", *shares)
    both = stack_loose(present.select("name", "value", *shares), gone)
    guild = C.by_share(
        {"herbivore": F.col("diet_plant"), "carnivore": F.col("diet_vert"), "invertivore": F.col("diet_inv")}
    )
    return both.withColumn("guild", guild)


def present_pool(pool: DataFrame, present: DataFrame, excluded: Sequence[str] = EXTINCT_IN_WILD) -> DataFrame:
    kept = pool.join(present.select("name").distinct(), "name", "left_semi")
    return kept.where(not_in_set(F.col("name").cast("string"), excluded))


def snapshot(pool: DataFrame, label: str) -> DataFrame:
    """Five-number table of one moment."""
    five = quantiles(pool, ["guild"], "value", FIVE_NAMES).drop("n")
    return five.withColumn("time", F.lit(label))


def end_states(pool: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """Five-number table of each run's survivors, whatever the year they would die in."""
    any_time = events.withColumn("death_year", F.lit(1))
    return survivor_quantiles(pool, any_time, runs, FIVE_NAMES, [1]).drop("year")


def future_snapshot(states: DataFrame) -> DataFrame:
    names = [n for n, _ in FIVE_NAMES]
    return mean_of(states, ["guild"], names).withColumn("time", F.lit("Future"))


def through_time(pleistocene: DataFrame, present: DataFrame, states: DataFrame) -> DataFrame:
    return stack_loose(
        snapshot(pleistocene, "Pleistocene"), snapshot(present, "Present"), future_snapshot(states)
    )


def trajectory(
    pool: DataFrame, events: DataFrame, runs: DataFrame, p: float = 0.5, years: int = YEARS
) -> DataFrame:
    """Survivors' quantile ``stat`` per run, guild and year 1..years, with its exponential."""
    out = survivor_quantiles(pool, events, runs, (("stat", p),), range(1, years + 1))
    return out.withColumn("stat_e", F.exp("stat"))


def year_zero(pool: DataFrame, p: float = 0.5) -> DataFrame:
    base = quantiles(pool, ["guild"], "value", (("stat", p),)).drop("n")
    return base.withColumns({"year": F.lit(0), "stat_e": F.exp("stat")})


def trajectory_summary(runs: DataFrame, start: DataFrame, method: str = "builtin") -> DataFrame:
    """Mean and central intervals over the runs per guild and year.

    A guild-year has one row per run at most, a number set by the simulation.
    """
    both = stack_loose(start, runs)
    return central_interval(both, ["guild", "year"], "stat", method)


def trajectory_hdi(runs: DataFrame, mass: float = 0.95) -> DataFrame:
    """Mean and shortest 95% interval over the runs per guild and year."""
    runs = settle(runs)
    mean = mean_of(runs, ["guild", "year"], ["stat"]).withColumnRenamed("stat", "mean")
    return same_keys(mean, hdi(runs, ["guild", "year"], "stat", mass), ["guild", "year"])


def trajectory_change(summary: DataFrame, start: DataFrame) -> DataFrame:
    """Percent change of back-transformed sizes against year zero."""
    base = start.select("guild", F.col("stat_e").alias("base_e"))
    joined = against_baseline(summary, base, ["guild"])
    return joined.select(
        "guild", "year", *[percent_change(F.exp(c), F.col("base_e")).alias(c) for c in CHANGES]
    )


def change_limit(change: DataFrame) -> DataFrame:
    return abs_limit(change, "low_ci", "upp_ci")


def stage_trajectories(
    pool: DataFrame, events: DataFrame, runs: DataFrame, shares: dict[str, float], years: int, folder: str
) -> None:
    """Write trajectories and year zero of several statistics, one part of the staged tables for each."""
    named = [(F.lit(name), p) for name, p in shares.items()]
    moved = stack_loose(*[trajectory(pool, events, runs, p, years).withColumn("statistic", name) for name, p in named])
    start = stack_loose(*[year_zero(pool, p).withColumn("statistic", name) for name, p in named])
    write_stage(moved, f"{folder}/trajectory", ["statistic"])
    write_stage(start, f"{folder}/start", ["statistic"])


def staged_change(spark: SparkSession, folder: str, statistic: str) -> DataFrame:
    """Percent change of one statistic from the staged tables; only its parts are read."""
    start = read_stage(spark, f"{folder}/start", statistic=statistic).drop("statistic")
    moved = read_stage(spark, f"{folder}/trajectory", statistic=statistic).drop("statistic")
    return trajectory_change(trajectory_summary(moved, start), start)
