"""Whole plans on the given tables: taxa, realms, intervals and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryset.cleaning import flag_guild
from queryset.registry import query
from queryset.resampled import META, SAMPLE_REPS, SEED, SUB, meta_sql
from queryset.tested import DIFF, PERM_REPS, TEST
from queryset.views import GUILDS, QUARTERS, SEGMENTS, SPANS, TRAITS, exact_tests, holm, pair_table, permuted, rank_sum, star
from strataguild.functions.classify import FISH_GUILDS, GUILDS as DIETS
from strataguild.operators.reshape import stack_loose
from strataguild.plans import fossil, living
from strataguild.session import settle


def flag(i: int, often: int) -> str:
    """A diet flag of a part: 0, 1 or unknown."""
    mix = f"(p_partkey * {2 * i + 3} + p_size * {i + 5}) % 23"
    return f"CASE WHEN {mix} < {often} THEN 1 WHEN {mix} = 22 THEN NULL ELSE 0 END"


AMPHIBIAN = {"flowers": 15, "seeds": 15, "fruits": 14, "arthro": 9, "vert": 5}
AMPHIBIAN_ROWS = f"""SELECT p_name AS species, p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_retailprice END AS body_mass_g,
  {', '.join(f"{flag(i, n)} AS {c}" for i, (c, n) in enumerate(AMPHIBIAN.items()))} FROM part"""
AMPHIBIANS = f"""amphibians AS (SELECT species AS binomial, {flag_guild('p', 'i', 'v')} AS guild, ln(body_mass_g) AS value, 'Amphibians' AS tax FROM (
  SELECT *, coalesce(least(flowers, seeds, fruits), 0) AS p, coalesce(arthro, 0) AS i, coalesce(vert, 0) AS v FROM ({AMPHIBIAN_ROWS}))
  WHERE body_mass_g IS NOT NULL AND p + i + v > 0)"""


def every(cols) -> str:
    """Greatest of several columns, unknown if one is."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"CASE WHEN {known} THEN greatest({', '.join(cols)}) END"


REPTILE_COLUMNS = [*living.REPTILE_PLANT, *living.REPTILE_INV, *living.REPTILE_VERT]
REPTILE_ROWS = f"""SELECT CASE WHEN p_size % 5 = 0 THEN 'AVES' ELSE 'REPTILIA' END AS class, p_name AS sciname, p_retailprice / 3 AS body_mass_value,
  {', '.join(f"{flag(i + 7, 2)} AS {c}" for i, c in enumerate(REPTILE_COLUMNS))} FROM part"""
REPTILES = f"""reptiles AS (SELECT sciname AS binomial, {flag_guild('p', 'i', 'v')} AS guild, ln(body_mass_value) AS value, 'Reptiles' AS tax FROM (
  SELECT *, greatest({', '.join(living.REPTILE_PLANT)}) AS p, {every(living.REPTILE_INV)} AS i, {every(living.REPTILE_VERT)} AS v FROM ({REPTILE_ROWS}))
  WHERE class = 'REPTILIA')"""
TAXON = "binomial:s guild:s value:d tax:s"


def rows(t, sql: str, *tables: str):
    """A stand-in table, given by the same SQL to both engines."""
    for name in tables:
        getattr(t, name).createOrReplaceTempView(name)
    # Kept, so that its flags are columns and not expressions in every rule.
    return settle(t.spark.sql(sql))


@query("amphibian_guilds", TAXON, "SELECT * FROM amphibians", AMPHIBIANS)
def amphibian_guilds(t):
    return living.amphibians(rows(t, AMPHIBIAN_ROWS, "part"))


@query("reptile_guilds", TAXON, "SELECT * FROM reptiles", REPTILES)
def reptile_guilds(t):
    return living.reptiles(rows(t, REPTILE_ROWS, "part"))


BOTH = f"{AMPHIBIANS}, {REPTILES}, taxa AS (SELECT * FROM amphibians UNION ALL SELECT * FROM reptiles)"


def both_taxa(t):
    return stack_loose(amphibian_guilds(t), reptile_guilds(t))


@query(
    "taxon_rank_tests",
    TEST.replace("region", "tax") + " p_adj:p stars:s",
    f"""SELECT h.*, {star('p_adj')} AS stars FROM ({holm('exact_tests', 'tax')}) AS h
        JOIN ({pair_table('taxa', 'tax', 'guild', DIETS, True)}) AS n ON h.tax = n.tax AND h.group_a = n.ga AND h.group_b = n.gb""",
    f"{BOTH}, {rank_sum('taxa', 'tax', 'guild', DIETS, 'value', False)}, {exact_tests('tax')}",
)
def taxon_rank_tests(t):
    """Amphibians and reptiles: all guild pairs adjusted within a taxon, neighbours kept."""
    return living.taxon_tests(both_taxa(t), DIETS)


@query(
    "taxon_percentile_tests",
    DIFF.replace("region", "tax") + " hits:i p:p p_adj:p stars:s",
    f"""SELECT h.*, {star('p_adj')} AS stars FROM ({holm('tests', 'tax')}) AS h
        JOIN ({pair_table('taxa', 'tax', 'guild', DIETS, True)}) AS n ON h.tax = n.tax AND h.group_a = n.ga AND h.group_b = n.gb""",
    f"{BOTH}, {permuted('taxa', 'tax', 'guild', DIETS, 'value', False, 0.9, PERM_REPS, SEED)}",
)
def taxon_percentile_tests(t):
    return living.taxon_percentile_tests(both_taxa(t), DIETS, r=PERM_REPS, seed=SEED)


@query(
    "guild_percentile_by_biome",
    DIFF.replace("region", "biome") + " hits:i p:p p_adj:p stars:s",
    f"SELECT *, {star('p_adj')} AS stars FROM ({holm('tests')})",
    f"{TRAITS}, {permuted('traits', 'biome', 'guild', GUILDS, 'mass', True, 0.9, PERM_REPS, SEED)}",
)
def guild_percentile_by_biome(t):
    """Neighbouring guilds in each of the biomes at the 90th percentile."""
    return fossil.guild_percentile_tests(t.traits(), ["biome"], GUILDS, "mass", r=PERM_REPS, seed=SEED)


FISH_ROWS = """SELECT l_partkey AS taxon, CASE l_suppkey % 6 WHEN 0 THEN 'Herbivore' WHEN 1 THEN 'Planktivore' WHEN 2 THEN 'omnivore'
  WHEN 3 THEN 'Omnivore' WHEN 4 THEN 'Benthic carnivore' ELSE 'Higher carnivore' END AS trophic_group, r_name AS realm,
  CASE WHEN l_quantity < 3 THEN NULL ELSE l_extendedprice / 100 END AS lmax, l_orderkey AS pos_a, l_linenumber AS pos_b
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
FISH = f"""fish AS (SELECT taxon, CASE trophic_group WHEN 'Herbivore' THEN 'herbivore' WHEN 'Planktivore' THEN 'planktivore'
  WHEN 'Benthic carnivore' THEN 'benthic carnivore' WHEN 'Higher carnivore' THEN 'higher carnivore' ELSE 'omnivore' END AS guild, realm, ln(lmax) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY pos_a, pos_b, lmax) AS rn FROM ({FISH_ROWS})) WHERE rn = 1 AND lmax IS NOT NULL)"""


def fish(t):
    return living.fishes(rows(t, FISH_ROWS, "lineitem", "supplier", "nation", "region"), ["pos_a", "pos_b", "lmax"])


@query("fish_counts_by_realm", "realm:s guild:s n:i", "SELECT realm, guild, count(*) AS n FROM fish GROUP BY ALL", FISH)
def fish_counts_by_realm(t):
    return living.guild_tables(fish(t), ["realm"], FISH_GUILDS)["counts"]


@query(
    "fish_tests_by_realm",
    TEST.replace("region", "realm") + " p_adj:p stars:s",
    f"SELECT *, {star('p_adj', ' ')} AS stars FROM ({holm('exact_tests')})",
    f"{FISH}, {rank_sum('fish', 'realm', 'guild', FISH_GUILDS, 'value', True)}, {exact_tests('realm')}",
)
def fish_tests_by_realm(t):
    """Five fish guilds, neighbours compared in every realm."""
    return living.guild_tables(fish(t), ["realm"], FISH_GUILDS)["tests"]


BINNED = f"""{SPANS}, {QUARTERS}, binned AS (SELECT "interval" AS quarter, guild, value FROM spans JOIN quarters ON lad < hi AND fad > lo)"""


def tests_by_quarter(labels) -> tuple[str, str]:
    return f"SELECT *, {star('p_adj', ' ')} AS stars FROM ({holm('exact_tests')})", (
        f"{BINNED}, {rank_sum('binned', 'quarter', 'guild', labels, 'value', True)}, {exact_tests('quarter')}"
    )


def binned(t):
    return fossil.bin_through_time(t.spans(), t.quarters()).withColumnRenamed("interval", "quarter")


@query("guild_tests_by_interval", TEST.replace("region", "quarter") + " p_adj:p stars:s", *tests_by_quarter(SEGMENTS))
def guild_tests_by_interval(t):
    """Every guild of the species alive in an interval against the next one."""
    return fossil.guild_tests(binned(t), ["quarter"], SEGMENTS)


@query("three_guild_tests_by_interval", TEST.replace("region", "quarter") + " p_adj:p stars:s", *tests_by_quarter(SEGMENTS[:3]))
def three_guild_tests_by_interval(t):
    return fossil.guild_tests(binned(t), ["quarter"], SEGMENTS[:3])


RANGES = "raw_low:d raw_upp:d wtd_low:d wtd_upp:d"


@query(
    "sensitivity_of_sample_size",
    f"rk:i gk:i sample:i {META} {RANGES}",
    f"""SELECT *, raw_mean - 1.96::DOUBLE * raw_sd AS raw_low, raw_mean + 1.96::DOUBLE * raw_sd AS raw_upp,
        wtd_mean - 1.96::DOUBLE * sqrt(wtd_var) AS wtd_low, wtd_mean + 1.96::DOUBLE * sqrt(wtd_var) AS wtd_upp
        FROM ({meta_sql('sub', 'rk, gk, sample', SAMPLE_REPS, 4)})""",
    SUB,
)
def sensitivity_of_sample_size(t):
    """The sensitivity plan at 20 sizes of 100 samples; its full-size part is ``bootstrap_ranges``."""
    return fossil.resampling_sensitivity(t.traits(), ["rk", "gk"], "mass", seed=SEED, rng="mix", boot_reps=1)[0]
