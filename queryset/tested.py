"""Rank-sum and percentile tests, adjustment and quantile regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryset.registry import query
from queryset.views import BIOMES, GUILDS, REGIONS, TRAITS, exact_tests, holm, mix31, pair_table, permuted, rank_sum, star
from strataguild.functions.scalar import stars
from strataguild.operators import percentile_tests as PT
from strataguild.operators import quantreg
from strataguild.operators import rank_tests as RT
from strataguild.plans import fossil, living

TEST = "region:s group_a:s group_b:s n_a:i n_b:i stat:c p:p"


@query("rank_sum_adjacent", TEST, "SELECT * FROM tests", f"{TRAITS}, {rank_sum('traits', 'region', 'guild', GUILDS, 'mass', True)}")
def rank_sum_adjacent(t):
    return RT.pairwise_rank_sum(t.traits(), "mass", "guild", GUILDS, ["region"], "adjacent")


@query(
    "rank_sum_all_holm",
    TEST + " p_adj:p stars:s",
    f"SELECT *, {star('p_adj')} AS stars FROM ({holm('tests', 'region')})",
    f"{TRAITS}, {rank_sum('traits', 'region', 'guild', GUILDS, 'mass', False)}",
)
def rank_sum_all_holm(t):
    return RT.pairwise_rank_sum(
        t.traits(), "mass", "guild", GUILDS, ["region"], "all", adjust="holm", family=["region"]
    )


@query(
    "guild_tests_by_region",
    TEST + " p_adj:p stars:s",
    f"SELECT *, {star('p_adj', ' ')} AS stars FROM ({holm('tests')})",
    f"{TRAITS}, {rank_sum('traits', 'region', 'guild', GUILDS, 'mass', True)}",
)
def guild_tests_by_region(t):
    return fossil.guild_tests(t.traits(), ["region"], GUILDS, "mass")


@query(
    "guild_tests_by_biome",
    TEST.replace("region", "biome") + " p_adj:p stars:s",
    f"SELECT *, {star('p_adj', ' ')} AS stars FROM ({holm('tests')})",
    f"{TRAITS}, {rank_sum('traits', 'biome', 'guild', GUILDS, 'mass', True)}",
)
def guild_tests_by_biome(t):
    return living.guild_tables(t.traits(), ["biome"], GUILDS, "mass")["tests"]


@query(
    "taxon_tests",
    TEST + " p_adj:p stars:s",
    f"""SELECT h.*, {star('p_adj')} AS stars FROM ({holm('tests', 'region')}) AS h
        JOIN ({pair_table('traits', 'region', 'guild', GUILDS, True)}) AS n
        ON h.region = n.region AND h.group_a = n.ga AND h.group_b = n.gb""",
    f"{TRAITS}, {rank_sum('traits', 'region', 'guild', GUILDS, 'mass', False)}",
)
def taxon_tests(t):
    return living.taxon_tests(t.traits(), GUILDS, ["region"], "mass")


FLAGS = ("A", "N", "R")
PRICED = f"""priced AS (SELECT l_partkey AS part, l_returnflag AS flag, l_extendedprice * (1 - l_discount) AS v FROM lineitem)"""


@query(
    "rank_sum_small_samples",
    "part:i group_a:s group_b:s n_a:i n_b:i stat:c p:p",
    "SELECT * FROM exact_tests",
    f"""{PRICED}, {rank_sum('priced', 'part', 'flag', FLAGS, 'v', False)}, {exact_tests('part')}""",
)
def rank_sum_small_samples(t):
    """Samples below 50: the exact law where values are untied, the normal one where they are tied."""
    priced = t.lineitem.select(
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"),
    )
    return RT.pairwise_rank_sum(priced, "v", "flag", FLAGS, ["part"])


def region_table_sql(regions, region: str) -> tuple[str, str]:
    cols = ", ".join(f"max(p_adj) FILTER (guild = '{g}') AS \"{g}\"" for g in GUILDS)
    counts = ", ".join(f"sum(CASE WHEN \"{g}\" < 0.05 THEN 1 ELSE 0 END) AS \"{g}\"" for g in GUILDS)
    ctes = f"""{TRAITS}, {rank_sum('traits', 'guild', region, regions, 'mass', False)},
    wide AS (SELECT group_a || ' - ' || group_b AS pair, {cols} FROM ({holm('tests')}) GROUP BY 1)"""
    return f"SELECT * FROM wide UNION ALL SELECT '# Significant', {counts} FROM wide", ctes


WIDE = "pair:s " + " ".join(f"{g}:p" for g in GUILDS)


@query("among_region_rank", WIDE, *region_table_sql(REGIONS, "region"))
def among_region_rank(t):
    return living.among_region_medians(t.traits(), "region", REGIONS, "guild", GUILDS, "mass")


@query("among_biome_rank", WIDE, *region_table_sql(BIOMES, "biome"))
def among_biome_rank(t):
    return living.among_region_medians(t.traits(), "biome", BIOMES, "guild", GUILDS, "mass")


@query(
    "holm_and_stars",
    "species:i p:p p_adj:p stars:s",
    f"SELECT *, {star('p_adj')} AS stars FROM ({holm('ps')})",
    f"""{TRAITS}, ps AS (SELECT species, pow(min(mass) / 12, 40) AS p FROM traits GROUP BY species)""",
)
def holm_and_stars(t):
    ps = t.traits().groupBy("species").agg(F.pow(F.min("mass") / 12, F.lit(40.0)).alias("p"))
    return RT.p_adjust(ps).withColumn("stars", stars(F.col("p_adj")))


OBSERVED = f"""pairs AS ({pair_table('traits', 'region', 'guild', GUILDS, True)}),
q AS (SELECT region, guild, count(*) AS n, quantile_cont(mass, 0.9) AS q FROM traits GROUP BY ALL),
observed AS (SELECT p.region, ga AS group_a, gb AS group_b, a.n AS n_a, b.n AS n_b, a.q - b.q AS diff FROM pairs p
  JOIN q a ON a.region = p.region AND a.guild = ga JOIN q b ON b.region = p.region AND b.guild = gb)"""
DIFF = "region:s group_a:s group_b:s n_a:i n_b:i diff:d"


@query("percentile_difference", DIFF, "SELECT * FROM observed", f"{TRAITS}, {OBSERVED}")
def percentile_difference(t):
    found = PT.percentile_differences(t.traits(), "mass", "guild", GUILDS, ["region"], 0.9, "adjacent")
    return found.select("*", RT.level_name("ia", GUILDS).alias("group_a"), RT.level_name("ib", GUILDS).alias("group_b"))


DEAL_REPS = 10


@query(
    "percentile_perm_dealt",
    DIFF + " hits:i p:p",
    f"""SELECT o.*, hits, hits / {DEAL_REPS}::DOUBLE AS p FROM observed o JOIN (
      SELECT region, group_a, group_b, count(*) FILTER (round(abs(d), 9) >= round(abs(diff), 9)) AS hits FROM (
        SELECT region, group_a, group_b, rep, any_value(diff) AS diff,
          quantile_cont(mass, 0.9) FILTER (rn <= n_a) - quantile_cont(mass, 0.9) FILTER (rn > n_a) AS d
        FROM placed GROUP BY region, group_a, group_b, rep) GROUP BY ALL) USING (region, group_a, group_b)""",
    f"""{TRAITS}, {OBSERVED},
    keyed AS (SELECT region, guild, mass, rep, {mix31(['row_id', 'rep'], 0, 'k')}
      FROM traits CROSS JOIN generate_series(1, {DEAL_REPS}) AS s(rep)),
    placed AS (SELECT o.*, rep, mass, row_number() OVER (PARTITION BY o.region, group_a, group_b, rep ORDER BY k, mass) AS rn
      FROM keyed JOIN observed o ON keyed.region = o.region AND (guild = group_a OR guild = group_b))""",
)
def percentile_perm_dealt(t):
    return PT.pairwise_percentile_test_dealt(
        t.traits(), "mass", "guild", GUILDS, "row_id", ["region"], 0.9, DEAL_REPS, "adjacent"
    )


PERM_REPS, REGION_REPS, SEED = 5000, 20_000, 1234


@query(
    "percentile_perm",
    DIFF + " hits:i p:p p_adj:p stars:s",
    f"SELECT *, {star('p_adj')} AS stars FROM ({holm('tests')})",
    f"{TRAITS}, {permuted('traits', 'region', 'guild', GUILDS, 'mass', True, 0.9, PERM_REPS, SEED)}",
)
def percentile_perm(t):
    return fossil.guild_percentile_tests(t.traits(), ["region"], GUILDS, "mass", r=PERM_REPS, seed=SEED)


def percentile_table_sql(regions, region: str, r: int) -> tuple[str, str]:
    cols = ", ".join(f"max(p_adj) FILTER (guild = '{g}') AS \"{g}\"" for g in GUILDS)
    counts = ", ".join(f"sum(CASE WHEN \"{g}\" < 0.05 THEN 1 ELSE 0 END) AS \"{g}\"" for g in GUILDS)
    ctes = f"""{TRAITS}, {permuted('traits', 'guild', region, regions, 'mass', False, 0.9, r, SEED)},
    wide AS (SELECT group_a || ' - ' || group_b AS pair, {cols} FROM ({holm('tests')}) GROUP BY 1)"""
    return f"SELECT * FROM wide UNION ALL SELECT '# Significant', {counts} FROM wide", ctes


@query("among_region_percentile", WIDE, *percentile_table_sql(REGIONS, "region", REGION_REPS))
def among_region_percentile(t):
    """All region pairs within each guild at the 90th percentile."""
    return living.among_region_percentiles(t.traits(), "region", REGIONS, "guild", GUILDS, "mass", r=REGION_REPS, seed=SEED)


QR_POINTS = """pts AS (SELECT o_orderpriority AS priority, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS x,
    avg(o_totalprice) / 1000 AS y FROM orders GROUP BY ALL),
  lines AS (SELECT DISTINCT a.priority, (a.y - (b.y - a.y) / (b.x - a.x) * a.x) AS a, (b.y - a.y) / (b.x - a.x) AS b
    FROM pts a JOIN pts b ON a.priority = b.priority AND a.x < b.x),
  scored AS (SELECT l.priority, tau, l.a, l.b, round(sum((y - l.a - l.b * x) * (CASE WHEN y - l.a - l.b * x >= 0 THEN tau ELSE tau - 1 END)), 9) AS loss
    FROM lines l JOIN pts USING (priority) CROSS JOIN (VALUES (0.03::DOUBLE), (0.97::DOUBLE)) AS k(tau) GROUP BY ALL)"""


@query(
    "quantile_regression",
    "priority:s tau:c intercept:c slope:d loss:c",
    """SELECT priority, tau, arg_min(a, (loss, b, a)) AS intercept, arg_min(b, (loss, b, a)) AS slope, min(loss) AS loss
       FROM scored GROUP BY priority, tau""",
    QR_POINTS,
)
def quantile_regression(t):
    return quantreg.quantile_regression(regression_points(t), "x", "y", (0.03, 0.97), ["priority"])


@query(
    "quantile_regression_edges",
    "priority:s tau:c loss:c",
    "SELECT priority, tau, min(loss) AS loss FROM scored GROUP BY priority, tau",
    QR_POINTS.replace("0.03::", "0.025::").replace("0.97::", "0.975::"),
)
def quantile_regression_edges(t):
    """The 95% band: several lines may be best where the share of points is whole, all with this loss."""
    return quantreg.quantile_regression(regression_points(t), "x", "y", (0.025, 0.975), ["priority"])


def regression_points(t):
    return t.orders.groupBy(
        F.col("o_orderpriority").alias("priority"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("x"),
    ).agg((F.avg("o_totalprice") / 1000).alias("y"))
