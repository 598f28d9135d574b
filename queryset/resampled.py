"""Seeded subsampling and resampling."""

from __future__ import annotations

from queryset.registry import query
from queryset.views import TRAITS, bootstrap_sql, draw_rank, text_number
from strataguild.operators import resample as R
from strataguild.plans import fossil

SIZES, SAMPLE_REPS, BOOT_REPS, SEED = tuple(range(5, 101, 5)), 100, 1000, 1234
STATS = "y0:d y5:d y25:d y50:d y75:d y95:d y100:d avg:d stddev:d"
SUMMARY = """min(mass) AS y0, quantile_cont(mass, 0.05) AS y5, quantile_cont(mass, 0.25) AS y25, median(mass) AS y50,
  avg(mass) AS avg, quantile_cont(mass, 0.75) AS y75, quantile_cont(mass, 0.95) AS y95, max(mass) AS y100, stddev_samp(mass) AS stddev"""
RANKED = f"""{TRAITS}, ranked AS (SELECT rk, gk, mass, row_number() OVER (PARTITION BY rk, gk ORDER BY mass) AS rank FROM traits),
sized AS (SELECT rk, gk, count(*) AS n FROM traits GROUP BY ALL)"""
SUB = f"""{RANKED}, draws AS (SELECT rk, gk, n, sample, rep, {draw_rank(['rk', 'gk', 'sample', 'rep', 'draw'], 'n', SEED)}
  FROM sized, (VALUES {', '.join(f'({s})' for s in SIZES)}) AS k(sample), generate_series(1, {SAMPLE_REPS}) AS r(rep),
       generate_series(1, {max(SIZES)}) AS d(draw) WHERE draw <= sample),
sub AS (SELECT rk, gk, n AS species, sample, rep, {SUMMARY} FROM draws JOIN ranked USING (rk, gk, rank) GROUP BY ALL)"""
# All seven quantiles from one list of values.
SEVEN = """q[1] AS y0, q[2] AS y5, q[3] AS y25, q[4] AS y50, q[5] AS y75, q[6] AS y95, q[7] AS y100, avg, stddev"""
AT_ONCE = """quantile_cont(mass, [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1]) AS q, avg(mass) AS avg, stddev_samp(mass) AS stddev"""


def boot_ctes(by: str, key, ranked: str) -> str:
    return f"""{ranked}, {bootstrap_sql(by, key, BOOT_REPS, SEED, R.POSITIONS, R.FLIPS)},
boot AS (SELECT {by}, n AS species, rep, {SEVEN} FROM (SELECT {by}, n, rep, {AT_ONCE} FROM draws JOIN ranked USING ({by}, rank) GROUP BY ALL))"""


BOOT = boot_ctes("rk, gk", ["rk", "gk"], RANKED)
TEXT_RANKED = f"""{TRAITS}, ranked AS (SELECT region, guild, mass, row_number() OVER (PARTITION BY region, guild ORDER BY mass) AS rank FROM traits),
sized AS (SELECT region, guild, count(*) AS n FROM traits GROUP BY ALL)"""
TEXT_BOOT = boot_ctes("region, guild", text_number(["region", "guild"]), TEXT_RANKED)


def meta_sql(src: str, by: str, reps: int, least: int) -> str:
    """Averages over replicates; trims of one half or more are medians."""
    k5, k25 = int(reps * 0.05), int(reps * 0.25)
    trim = lambda y, k: f"list_avg(list_sort(list({y}))[{k + 1}:{reps - k}]) AS {y}"
    return f"""SELECT {by}, species, any_value(raw_sd) AS raw_sd, any_value(raw_mean) AS raw_mean, avg(y0) AS y0, {trim('y5', k5)}, {trim('y25', k25)},
      median(y50) AS y50, median(y75) AS y75, median(y95) AS y95, median(y100) AS y100, any_value(m) AS wtd_mean,
      sum(w * (avg - m) * (avg - m)) / (sum(w) - 1) AS wtd_var FROM (
        SELECT *, sum(w * avg) OVER g / sum(w) OVER g AS m, stddev_samp(avg) OVER g AS raw_sd, avg(avg) OVER g AS raw_mean
        FROM (SELECT *, 1 / nullif(stddev * stddev, 0) AS w FROM {src} WHERE species >= {least})
        WINDOW g AS (PARTITION BY {by}, species)) GROUP BY {by}, species"""


META = "species:i raw_sd:d raw_mean:d y0:d y5:d y25:d y50:d y75:d y95:d y100:d wtd_mean:d wtd_var:d"


@query("subsample", f"rk:i gk:i species:i sample:i rep:i {STATS}", "SELECT * FROM sub", SUB)
def subsample(t):
    return R.subsample(t.traits(), ["rk", "gk"], "mass", SIZES, SAMPLE_REPS, SEED, rng="mix")


@query("bootstrap", f"rk:i gk:i species:i rep:i {STATS}", "SELECT * FROM boot", BOOT)
def bootstrap(t):
    return R.bootstrap(t.traits(), ["rk", "gk"], "mass", BOOT_REPS, SEED, rng="mix")


@query("resample_meta", f"rk:i gk:i sample:i {META}", meta_sql("sub", "rk, gk, sample", SAMPLE_REPS, 4), SUB)
def resample_meta(t):
    sub = R.subsample(t.traits(), ["rk", "gk"], "mass", SIZES, SAMPLE_REPS, SEED, rng="mix")
    return R.resample_meta(sub, ["rk", "gk", "sample"], 4)


@query(
    "bootstrap_ranges",
    f"rk:i gk:i {META} raw_low:d raw_upp:d wtd_low:d wtd_upp:d",
    f"""SELECT *, raw_mean - 1.96::DOUBLE * raw_sd AS raw_low, raw_mean + 1.96::DOUBLE * raw_sd AS raw_upp,
        wtd_mean - 1.96::DOUBLE * sqrt(wtd_var) AS wtd_low, wtd_mean + 1.96::DOUBLE * sqrt(wtd_var) AS wtd_upp
        FROM ({meta_sql('boot', 'rk, gk', BOOT_REPS, 5)})""",
    BOOT,
)
def bootstrap_ranges(t):
    boot = R.bootstrap(t.traits(), ["rk", "gk"], "mass", BOOT_REPS, SEED, rng="mix")
    return fossil.with_ranges(R.resample_meta(boot, ["rk", "gk"], 5))


@query("bootstrap_hashed", f"region:s guild:s species:i rep:i {STATS}", "SELECT * FROM boot", TEXT_BOOT)
def bootstrap_hashed(t):
    """Default draws over text keys."""
    return R.bootstrap(t.traits(), ["region", "guild"], "mass", BOOT_REPS)
