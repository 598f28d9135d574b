"""Survivor trajectories, snapshots and percent change."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queryset.registry import query
from queryset.views import DEATHS, YEARS
from strataguild.operators.trajectory import survivor_quantiles
from strataguild.plans import future
from strataguild.session import checkpoint_folder

NAMES = "y0:d y25:d y50:d y75:d y100:d"
FIVE = """min(value) AS y0, quantile_cont(value, 0.25) AS y25, median(value) AS y50, quantile_cont(value, 0.75) AS y75, max(value) AS y100"""
END_STATES = f"""{DEATHS}, states AS (SELECT run, guild, {FIVE} FROM runs CROSS JOIN pool
  WHERE NOT EXISTS (SELECT 1 FROM deaths d WHERE d.run = runs.run AND d.name = pool.name) GROUP BY ALL)"""


def dense(p: float) -> str:
    return f"""{DEATHS}, traj AS (SELECT runs.run, guild, year, quantile_cont(value, {p}) AS stat FROM runs CROSS JOIN pool
    CROSS JOIN generate_series(1, {YEARS}) AS y(year) LEFT JOIN deaths d ON d.run = runs.run AND d.name = pool.name
    WHERE d.death_year IS NULL OR d.death_year > year GROUP BY ALL),
  start AS (SELECT guild, quantile_cont(value, {p}) AS stat FROM pool GROUP BY guild),
  summary AS (SELECT guild, year, avg(stat) AS mean, quantile_cont(stat, 0.025) AS low_ci, quantile_cont(stat, 0.975) AS upp_ci,
    quantile_cont(stat, 0.25) AS low_ci_50, quantile_cont(stat, 0.75) AS upp_ci_50
    FROM (SELECT guild, year, stat FROM traj UNION ALL SELECT guild, 0, stat FROM start) GROUP BY ALL)"""


def run(t, p: float):
    return future.trajectory(t.pool(), t.deaths(), t.runs(), p, YEARS)


@query("survivor_boxstats", f"run:i guild:s {NAMES}", "SELECT * FROM states", END_STATES)
def survivor_boxstats(t):
    return future.end_states(t.pool(), t.deaths(), t.runs())


@query(
    "boxes_through_time",
    f"guild:s time:s {NAMES}",
    f"""SELECT guild, 'Pleistocene' AS time, {FIVE} FROM pool GROUP BY guild
        UNION ALL SELECT guild, 'Present', {FIVE} FROM present GROUP BY guild
        UNION ALL SELECT guild, 'Future', avg(y0), avg(y25), avg(y50), avg(y75), avg(y100) FROM states GROUP BY guild""",
    f"""{DEATHS}, present AS (SELECT * FROM pool WHERE name IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)),
    states AS (SELECT run, guild, {FIVE} FROM runs CROSS JOIN present
      WHERE NOT EXISTS (SELECT 1 FROM deaths d WHERE d.run = runs.run AND d.name = present.name) GROUP BY ALL)""",
)
def boxes_through_time(t):
    living = t.lineitem.where(F.col("l_quantity") == 50).select(F.col("l_partkey").alias("name"))
    present = future.present_pool(t.pool(), living)
    return future.through_time(t.pool(), present, future.end_states(present, t.deaths(), t.runs()))


@query("trajectory_median", "run:i guild:s year:i stat:d stat_e:d", "SELECT *, exp(stat) AS stat_e FROM traj", dense(0.5))
def trajectory_median(t):
    return run(t, 0.5)


@query("trajectory_q90", "run:i guild:s year:i stat:d stat_e:d", "SELECT *, exp(stat) AS stat_e FROM traj", dense(0.9))
def trajectory_q90(t):
    return run(t, 0.9)


@query(
    "baseline_year0",
    "guild:s year:i stat:d stat_e:d",
    "SELECT guild, 0 AS year, stat, exp(stat) AS stat_e FROM start",
    dense(0.9),
)
def baseline_year0(t):
    return future.year_zero(t.pool(), 0.9)


@query(
    "trajectory_summary",
    "guild:s year:i mean:d low_ci:d upp_ci:d low_ci_50:d upp_ci_50:d",
    "SELECT * FROM summary",
    dense(0.5),
)
def trajectory_summary(t):
    return future.trajectory_summary(run(t, 0.5), future.year_zero(t.pool()))


CHANGED = ", ".join(f"(exp({c}) - exp(stat)) / exp(stat) * 100 AS {c}" for c in future.CHANGES)


@query(
    "trajectory_change",
    "guild:s year:i mean:d low_ci:d upp_ci:d low_ci_50:d upp_ci_50:d",
    f"SELECT guild, year, {CHANGED} FROM summary JOIN start USING (guild)",
    dense(0.9),
)
def trajectory_change(t):
    start = future.year_zero(t.pool(), 0.9)
    return future.trajectory_change(future.trajectory_summary(run(t, 0.9), start), start)


@query(
    "trajectory_change_limit",
    "limit:d",
    f"""SELECT greatest(abs(min(low_ci)), abs(max(upp_ci))) * 1.01::DOUBLE AS "limit" FROM (SELECT {CHANGED} FROM summary JOIN start USING (guild))""",
    dense(0.9),
)
def trajectory_change_limit(t):
    """The limit of the plots comes from the 90th percentile."""
    start = future.year_zero(t.pool(), 0.9)
    return future.change_limit(future.trajectory_change(future.trajectory_summary(run(t, 0.9), start), start))


@query(
    "trajectory_hdi",
    "guild:s year:i mean:d low:d upp:d",
    """SELECT a.guild, a.year, any_value(a.mean) AS mean, arg_min(a.stat, (b.stat - a.stat, a.stat)) AS low,
       arg_min(b.stat, (b.stat - a.stat, a.stat)) AS upp FROM ranked a JOIN ranked b ON a.guild = b.guild AND a.year = b.year
       AND b.rn = a.rn + CAST(floor(a.n * 0.95::DOUBLE) AS BIGINT) GROUP BY a.guild, a.year""",
    dense(0.5)
    + """, ranked AS (SELECT guild, year, stat, avg(stat) OVER (PARTITION BY guild, year) AS mean,
      row_number() OVER (PARTITION BY guild, year ORDER BY stat) AS rn, count(*) OVER (PARTITION BY guild, year) AS n FROM traj)""",
)
def trajectory_hdi(t):
    return future.trajectory_hdi(run(t, 0.5))


@query(
    "survivor_mean_of_runs",
    f"guild:s {NAMES}",
    "SELECT guild, avg(y0) AS y0, avg(y25) AS y25, avg(y50) AS y50, avg(y75) AS y75, avg(y100) AS y100 FROM states GROUP BY guild",
    END_STATES,
)
def survivor_mean_of_runs(t):
    return future.future_snapshot(future.end_states(t.pool(), t.deaths(), t.runs()))


@query(
    "survivor_two_quantiles",
    "run:i guild:s year:i med:d q90:d",
    f"""SELECT run, guild, year, a.stat AS med, b.q90 FROM traj a JOIN (
         SELECT runs.run, guild, year, quantile_cont(value, 0.9) AS q90 FROM runs CROSS JOIN pool
         CROSS JOIN generate_series(1, {YEARS}) AS y(year) LEFT JOIN deaths d ON d.run = runs.run AND d.name = pool.name
         WHERE d.death_year IS NULL OR d.death_year > year GROUP BY ALL) b USING (run, guild, year)""",
    dense(0.5),
)
def survivor_two_quantiles(t):
    return survivor_quantiles(t.pool(), t.deaths(), t.runs(), (("med", 0.5), ("q90", 0.9)), range(1, YEARS + 1))


@query(
    "trajectory_staged",
    "statistic:s guild:s year:i mean:d low_ci:d upp_ci:d low_ci_50:d upp_ci_50:d",
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {dense(p)} SELECT '{name}' AS statistic, guild, year, {CHANGED} FROM summary JOIN start USING (guild)) AS {name}"
        for name, p in (("median", 0.5), ("q90", 0.9))
    ),
)
def trajectory_staged(t):
    """Both statistics from the pool to their changes, each read back alone from the staged tables."""
    folder = f"{checkpoint_folder(t.spark)}/trajectories-{uuid.uuid4().hex}"
    future.stage_trajectories(t.pool(), t.deaths(), t.runs(), {"median": 0.5, "q90": 0.9}, YEARS, folder)
    parts = [future.staged_change(t.spark, folder, name).withColumn("statistic", F.lit(name)) for name in ("median", "q90")]
    return parts[0].unionByName(parts[1])
