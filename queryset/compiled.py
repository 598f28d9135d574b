"""Whole analyses on stand-in inputs shaped like the species tables they expect."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryset.registry import query
from strataguild.functions.classify import FOSSIL_RULES, LIVING_RULES
from strataguild.operators.summaries import group_counts
from strataguild.plans import fossil, living
from strataguild.sources.dimensions import BIOMES as BIOME_NAMES
from strataguild.sources.dimensions import FIVE_GUILD_KEY, intervals

# Row expressions shared by both sides; they are plain SQL on Spark and on DuckDB.
DIET = """CASE WHEN p_name LIKE 'small%' THEN 'Browser' WHEN p_name LIKE 'large%' THEN 'carnivore'
  WHEN p_name LIKE 'hot%' THEN 'INSECTS, frugivore' WHEN p_name LIKE 'cold%' THEN 'omnivore' WHEN p_name LIKE 'old%' THEN 'piscivore'
  WHEN p_name LIKE 'new%' THEN 'insectivore' WHEN p_name LIKE '%rod' THEN NULL ELSE 'unknown' END"""
SPECIES_1 = f"""SELECT concat('sp ', CAST(l_partkey AS {{text}})) AS genus_species, p_type AS "order", p_brand AS family, {DIET} AS pbdb_diet,
  CASE WHEN p_size = 7 THEN 'aquatic' WHEN p_size = 8 THEN NULL ELSE 'ground' END AS pbdb_life_habit,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(12.5 AS DOUBLE) END AS fad, CAST(l_linenumber AS DOUBLE) AS lad, ln(l_extendedprice) AS lnmass_g
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
TAXONOMY = f"""SELECT concat('sp ', CAST(p_partkey AS {{text}})) AS taxon_name,
  CASE WHEN p_size < 40 THEN concat('sp ', CAST(p_partkey + 1 AS {{text}})) END AS accepted_name,
  CASE WHEN p_size = 30 THEN 'genus' WHEN p_size = 31 THEN NULL ELSE 'species' END AS accepted_rank,
  CASE WHEN p_size > 35 THEN 'herbivore' END AS diet, CASE WHEN p_size = 33 THEN 'aquatic' END AS life_habit,
  CASE WHEN p_size < 30 THEN 'NO_ORDER_SPECIFIED' WHEN p_type = 'SMALL' THEN 'Lipotyphla' WHEN p_type = 'LARGE' THEN 'Xenarthra' END AS "order",
  'NO_FAMILY_SPECIFIED' AS family FROM part WHERE p_size > 20"""
SPECIES_2 = """SELECT 'sp' AS genus, CAST(c_custkey AS {text}) AS species, CASE WHEN c_nationkey < 8 THEN 'Soricomorpha' ELSE c_mktsegment END AS "order",
  CASE WHEN c_nationkey < 5 THEN 'NA' WHEN c_nationkey < 10 THEN 'AF' WHEN c_nationkey < 15 THEN 'EA' WHEN c_nationkey < 20 THEN 'SA' ELSE 'Insular' END AS continent,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'extinct' WHEN 'MACHINERY' THEN 'historical' ELSE 'extant' END AS status,
  CASE WHEN c_acctbal > 9500 THEN 'invalid' WHEN c_nationkey = 3 THEN NULL ELSE 'valid' END AS mass_status, CASE WHEN c_nationkey = 4 THEN 'x' END AS to_do,
  CASE WHEN c_name LIKE '%1' THEN 'browse' WHEN c_name LIKE '%2' THEN 'Carnivore' WHEN c_name LIKE '%3' THEN 'insects and fruit: frugivore'
    WHEN c_name LIKE '%4' THEN NULL WHEN c_name LIKE '%5' THEN 'insectivore' ELSE 'omnivore' END AS trophic,
  CASE WHEN c_nationkey = 11 THEN 'Marine' WHEN c_nationkey = 12 THEN 'savanna' WHEN c_nationkey = 13 THEN NULL ELSE 'plain' END AS habitat_mode,
  CASE WHEN c_acctbal > 8000 THEN 'Future' WHEN c_acctbal > 7000 THEN 'Future2' WHEN c_acctbal > 6000 THEN NULL ELSE 'LP' END AS time_of_extinction,
  c_acctbal / 1000 AS logmass_g, CASE WHEN c_nationkey = 14 THEN 'unknown' ELSE CAST(c_acctbal AS {text}) END AS combined_mass_g,
  CASE WHEN c_nationkey = 15 THEN 'no date' ELSE CAST(c_nationkey * 40 AS {text}) END AS last_occurance_kybp FROM customer"""
SPECIES_3 = f"""SELECT concat('sp ', CAST(p_partkey * 2 AS {{text}})) AS taxon_name, p_brand AS "order", {DIET} AS diet,
  CASE WHEN p_size < 10 THEN 'Smith et al 2018' WHEN p_size = 10 THEN NULL ELSE 'measured' END AS mass_source,
  CASE WHEN p_size > 5 THEN ln(p_retailprice) END AS ln_mass_g, CASE WHEN p_size < 25 THEN CAST(p_size AS DOUBLE) END AS ln_mass_g_estimate,
  CAST(p_size AS DOUBLE) AS firstapp_max_ma, CAST(p_size AS DOUBLE) / 10 AS lastapp_min_ma FROM part"""


def spark_rows(t, sql: str):
    """Run one of the shared row expressions on Spark."""
    names = {n: getattr(t, n) for n in ("lineitem", "part", "customer") if n in sql}
    body = sql.format(text="STRING").replace('"order"', "`order`")
    for n in names:
        body = body.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return t.spark.sql(body, **names)


def by_text(diet: str, rules, omni: bool) -> str:
    hit = lambda pat: f"coalesce(regexp_matches({diet}, '{pat}', 'i'), false)"
    several = " + ".join(f"CAST({hit(p)} AS INTEGER)" for _, p in rules) + " > 1"
    several = f"{hit('omni')} OR {several}" if omni else several
    return f"CASE WHEN {several} THEN 'omnivore' " + " ".join(f"WHEN {hit(p)} THEN '{g}'" for g, p in rules) + " ELSE 'herbivore' END"


RECODE = """CASE "order" WHEN 'Soricomorpha' THEN 'Eulipotyphla' WHEN 'Lipotyphla' THEN 'Eulipotyphla' WHEN 'Hicanodonta' THEN 'Cingulata'
  WHEN 'Xenarthra' THEN 'Pilosa' ELSE "order" END"""
QUATERNARY = f"""s2 AS ({SPECIES_2.format(text='VARCHAR')}),
quaternary AS (SELECT genus || ' ' || species AS name, "order", 2.58::DOUBLE AS fad,
  CASE WHEN status IN ('extant', 'historical') THEN 0 ELSE TRY_CAST(last_occurance_kybp AS DOUBLE) / 1000 END AS lad,
  {by_text('trophic', LIVING_RULES, False)} AS guild,
  CASE WHEN TRY_CAST(combined_mass_g AS DOUBLE) > 0 THEN ln(TRY_CAST(combined_mass_g AS DOUBLE)) END AS value, continent, status, time_of_extinction
  FROM s2 WHERE mass_status = 'valid' AND logmass_g > 0 AND to_do IS NULL AND trophic IS NOT NULL
    AND NOT coalesce(regexp_matches(habitat_mode, '^aquatic$|marine|NA', 'i'), false))"""
COMPILED = f"""s1 AS ({SPECIES_1.format(text='VARCHAR')}), tax AS ({TAXONOMY.format(text='VARCHAR')}), s3 AS ({SPECIES_3.format(text='VARCHAR')}),
{QUATERNARY},
m1 AS (SELECT coalesce(x.accepted_name, genus_species) AS name, coalesce(nullif(x."order", 'NO_ORDER_SPECIFIED'), s1."order") AS "order",
  coalesce(x.diet, pbdb_diet) AS diet, coalesce(x.life_habit, pbdb_life_habit) AS habit, accepted_rank, fad, lad, lnmass_g
  FROM s1 LEFT JOIN tax x ON genus_species = taxon_name),
taxon AS (SELECT name, "order", fad, lad, {by_text('diet', FOSSIL_RULES, True)} AS guild, avg(lnmass_g) AS value, 'NA' AS continent FROM (
  SELECT DISTINCT name, "order", fad, lad, diet, lnmass_g FROM m1 WHERE diet IS NOT NULL AND fad IS NOT NULL AND lad IS NOT NULL
  AND coalesce(habit <> 'aquatic', true) AND (accepted_rank IS NULL OR accepted_rank = 'species')) GROUP BY name, "order", fad, lad, diet),
added AS (SELECT taxon_name AS name, "order", firstapp_max_ma AS fad, lastapp_min_ma AS lad, {by_text('diet', LIVING_RULES, True)} AS guild,
  CASE WHEN ln_mass_g IS NOT NULL AND mass_source <> 'Smith et al 2018' THEN ln_mass_g ELSE ln_mass_g_estimate END AS value, 'NA' AS continent
  FROM s3 WHERE (ln_mass_g IS NOT NULL AND mass_source <> 'Smith et al 2018') OR ln_mass_g_estimate IS NOT NULL),
stacked AS (SELECT *, row_number() OVER (PARTITION BY name, continent ORDER BY place, "order" NULLS FIRST, fad NULLS FIRST, lad NULLS FIRST, value NULLS FIRST) AS seq
  FROM (SELECT name, {RECODE} AS "order", fad, lad, guild, value, continent, source, place, rank FROM (
    SELECT *, 'lyons' AS source, 1 AS place, 2 AS rank FROM taxon
    UNION ALL SELECT name, "order", fad, lad, guild, value, continent, 'mom', 2, 1 FROM quaternary
    UNION ALL SELECT *, 'supp', 3, 3 FROM added))),
species AS (SELECT a.*, coalesce(orders, '') AS "order" FROM (
    SELECT name, continent, CASE WHEN count(fad) = count(*) THEN max(fad) END AS fad, CASE WHEN count(lad) = count(*) THEN min(lad) END AS lad,
      CASE WHEN count(value) = count(*) THEN avg(value) END AS value, arg_min(guild, (rank, seq)) AS guild,
      string_agg(source, ', ' ORDER BY seq) AS sources FROM stacked GROUP BY name, continent) a
  LEFT JOIN (SELECT name, continent, string_agg("order", ', ' ORDER BY seq) AS orders FROM (
    SELECT name, continent, "order", min(seq) AS seq FROM stacked WHERE "order" IS NOT NULL GROUP BY ALL) GROUP BY ALL) b USING (name, continent))"""


def species(t):
    return fossil.compile_species(
        fossil.clean_taxon_source(spark_rows(t, SPECIES_1), spark_rows(t, TAXONOMY)),
        fossil.clean_quaternary_source(spark_rows(t, SPECIES_2)),
        fossil.clean_added_source(spark_rows(t, SPECIES_3)),
    )


@query(
    "compile_species",
    "name:s continent:s order:s fad:d lad:d guild:s value:d sources:s",
    "SELECT * FROM species",
    COMPILED,
)
def compile_species(t):
    return species(t)


BOUNDS = (("Holocene", 0.0, 0.0117), ("Pleistocene", 0.0117, 2.58), ("Neogene", 2.58, 23.0))


def cut(col: str, closed: str) -> str:
    ops = (">", "<=") if closed == "right" else (">=", "<")
    return "CASE " + " ".join(f"WHEN {col} {ops[0]} {lo} AND {col} {ops[1]} {hi} THEN '{n}'" for n, lo, hi in BOUNDS) + " END"


@query(
    "compiled_table",
    "order:s name:s value:d guild:s fad:d lad:d fad_interval:s lad_interval:s sources:s",
    f"""SELECT * FROM (SELECT *, {cut('fad', 'right')} AS fad_interval, {cut('lad', 'left')} AS lad_interval FROM species)
        WHERE fad_interval IS NOT NULL AND lad_interval IS NOT NULL""",
    COMPILED,
)
def compiled_table(t):
    return fossil.compiled_table(species(t), BOUNDS)


def dated(t):
    """Interval table whose rows are the distinct part sizes, read as ages."""
    sizes = t.part.select(F.col("p_size").cast("double").alias("hi")).distinct()
    bounds = sizes.select(F.concat(F.lit("T"), F.col("hi").cast("int")).alias("interval"), "hi", (F.col("hi") - 1).alias("lo"))
    return intervals(bounds, "interval", "hi", "lo")


@query(
    "bin_through_time",
    "bin_num:i interval:s guild:s n:i",
    """SELECT bin_num, "interval", guild, count(*) AS n FROM species JOIN (
         SELECT 'T' || p_size AS "interval", p_size AS hi, p_size - 1 AS lo, row_number() OVER (ORDER BY p_size DESC) AS bin_num
         FROM (SELECT DISTINCT p_size FROM part)) ON lad < hi AND fad > lo GROUP BY ALL""",
    COMPILED,
)
def bin_through_time(t):
    return group_counts(fossil.bin_through_time(species(t), dated(t)), ["bin_num", "interval", "guild"])


PER_PERIOD = f"""{QUATERNARY}, old AS (SELECT q.*, bin FROM quaternary q JOIN (VALUES ('Holocene', 0.0117::DOUBLE, 0.0::DOUBLE),
  ('Pleistocene', 2.58::DOUBLE, 0.0117::DOUBLE)) AS i(bin, hi, lo) ON lad <= hi AND fad >= lo),
per AS (SELECT * FROM old UNION ALL SELECT *, 'Modern' FROM quaternary WHERE status = 'extant'
  UNION ALL SELECT *, 'Future' FROM quaternary WHERE status = 'extant' AND coalesce(time_of_extinction NOT IN ('Future', 'Future2'), true))"""


def per_period(t):
    recent = t.spark.createDataFrame([(n, hi, lo) for n, lo, hi in BOUNDS[:2]], "interval string, hi double, lo double")
    return fossil.periods(fossil.clean_quaternary_source(spark_rows(t, SPECIES_2)), recent)


@query(
    "size_ranges",
    "guild:s bin:s min_size:d which_min:s max_size:d which_max:s med_size:d",
    """SELECT guild, bin, min(value) AS min_size, arg_min(name, (value, name)) AS which_min, max(value) AS max_size,
       arg_min(name, (-value, name)) AS which_max, median(value) AS med_size FROM per WHERE value IS NOT NULL GROUP BY ALL""",
    PER_PERIOD,
)
def size_ranges(t):
    return fossil.size_ranges(per_period(t))


TRAITS_WIDE = """SELECT concat('sp ', CAST(l_partkey AS {text})) AS binomial, CASE WHEN min(p_size) <= 30 THEN 'Mammalia' ELSE 'Aves' END AS class,
  CASE WHEN min(p_size) % 10 = 0 THEN 'marine' ELSE 'terrestrial' END AS realm, CAST(1 + min(p_size) % 6 AS INT) AS diet_5cat,
  min(p_retailprice) AS body_mass_median, """ + ", ".join(
    f"100 * sum(CASE WHEN l_linenumber = {i + 1} THEN l_quantity ELSE 0 END) / sum(l_quantity) AS {c}"
    for i, c in enumerate(("diet_fruit", "diet_nect", "diet_inv", "diet_vend", "diet_vect", "diet_vfish", "diet_seed"))
) + """, CAST(0 AS DOUBLE) AS diet_planto, CAST(0 AS DOUBLE) AS diet_vunk, CAST(0 AS DOUBLE) AS diet_scav
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 2 GROUP BY l_partkey"""
MEMBERS = """SELECT DISTINCT concat('sp ', CAST(l_partkey AS {text})) AS binomial, s_nationkey + 1 AS biome,
  CASE WHEN p_size <= 30 THEN 'Mammalia' ELSE 'Aves' END AS class, log10(p_retailprice) AS log10_body_mass_median
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 48"""
NAMED = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(BIOME_NAMES))
LIVING = f"""tr AS ({TRAITS_WIDE.format(text='VARCHAR')}), mem AS ({MEMBERS.format(text='VARCHAR')}),
shares AS (SELECT *, diet_fruit + diet_nect + diet_seed + diet_planto AS plant, diet_vend + diet_vect + diet_vfish + diet_vunk + diet_scav AS vert FROM tr),
guilds AS (SELECT binomial, class, realm, ln(body_mass_median) AS value, CASE WHEN greatest(plant, diet_inv, vert) <= 50 THEN 'omnivore'
  WHEN plant = greatest(plant, diet_inv, vert) THEN 'herbivore' WHEN diet_inv = greatest(plant, diet_inv, vert) THEN 'invertivore' ELSE 'carnivore' END AS guild FROM shares),
living AS (SELECT g.*, m.biome, biome_name FROM guilds g LEFT JOIN mem m USING (binomial)
  LEFT JOIN (VALUES {NAMED}) AS k(biome, biome_name) ON k.biome = m.biome)"""


def wide_traits(t):
    return spark_rows(t, TRAITS_WIDE)


def memberships(t):
    body = MEMBERS.format(text="STRING")
    for n in ("lineitem", "part", "supplier"):
        body = body.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return t.spark.sql(body, lineitem=t.lineitem, part=t.part, supplier=t.supplier)


@query(
    "species_by_biome",
    "biome_name:s class:s guild:s n:i mean:d",
    """SELECT biome_name, class, guild, count(*) AS n, avg(value) AS mean FROM living
       WHERE realm = 'terrestrial' AND class = 'Mammalia' AND biome_name IS NOT NULL GROUP BY ALL""",
    LIVING,
)
def species_by_biome(t):
    rows = living.in_biomes(living.species_by_biome(memberships(t), wide_traits(t)), "Mammalia")
    return rows.groupBy("biome_name", "class", "guild").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query(
    "one_per_species",
    "binomial:s biome:i guild:s value:d tax:s",
    """SELECT binomial, min(biome) AS biome, any_value(guild) AS guild, any_value(value) AS value, 'Birds (terrestrial)' AS tax FROM (
         SELECT *, count(*) FILTER (biome IS NULL) OVER (PARTITION BY binomial) AS gaps FROM living)
       WHERE class = 'Aves' AND realm = 'terrestrial' GROUP BY binomial""",
    LIVING,
)
def one_per_species(t):
    both = living.species_by_biome(memberships(t), wide_traits(t))
    return living.one_per_species(both, "Aves", ["terrestrial"], "Birds (terrestrial)")


CODE = "CASE diet_5cat WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 4 END"
FIVE_KEY = ", ".join(f"({c}, '{a}')" for c, _, a in FIVE_GUILD_KEY)


@query(
    "older_group_means",
    "class:s diet_abbr:s n:i estimate:d std_error:d statistic:c low:d upp:d",
    f"""SELECT *, estimate / std_error AS statistic, estimate - 1.96::DOUBLE * std_error AS low, estimate + 1.96::DOUBLE * std_error AS upp FROM (
         SELECT class, diet_abbr, count(*) AS n, avg(log10_body_mass_median) AS estimate, stddev_samp(log10_body_mass_median) / sqrt(count(*)) AS std_error
         FROM (SELECT m.*, {CODE} AS code, realm FROM mem m LEFT JOIN tr USING (binomial)) JOIN (VALUES {FIVE_KEY}) AS k(code, diet_abbr) USING (code)
         JOIN (VALUES {NAMED}) AS b(biome, biome_name) USING (biome) WHERE realm = 'terrestrial' GROUP BY ALL)""",
    LIVING,
)
def older_group_means(t):
    return living.older_group_means(memberships(t), wide_traits(t))


FISH = """SELECT concat('fish ', CAST(l_suppkey AS {text}), ' ', CAST(l_linenumber AS {text})) AS taxon,
  CASE l_returnflag WHEN 'A' THEN 'Herbivore' WHEN 'N' THEN 'omnivore' ELSE 'Higher carnivore' END AS trophic_group,
  l_linestatus AS realm, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS lmax, l_orderkey AS pos_a, l_partkey AS pos_b FROM lineitem"""


@query(
    "fish_guilds",
    "binomial:s guild:s value:d realm:s tax:s",
    f"""SELECT taxon AS binomial, CASE trophic_group WHEN 'Herbivore' THEN 'herbivore' WHEN 'omnivore' THEN 'omnivore' ELSE 'higher carnivore' END AS guild,
        ln(lmax) AS value, realm, 'Fishes' AS tax FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY pos_a, pos_b, lmax) AS rn
        FROM ({FISH.format(text='VARCHAR')})) WHERE rn = 1 AND lmax IS NOT NULL""",
)
def fish_guilds(t):
    return living.fishes(spark_rows(t, FISH), ["pos_a", "pos_b", "lmax"])


@query(
    "guild_boxes_by_biome",
    "biome:s guild:s n:i lower:d middle:d upper:d ymin:d ymax:d n_outliers:i",
    """SELECT biome, guild, any_value(n) AS n, any_value(lower) AS lower, any_value(middle) AS middle, any_value(upper) AS upper,
       min(mass) FILTER (inside) AS ymin, max(mass) FILTER (inside) AS ymax, count(*) FILTER (NOT inside) AS n_outliers
       FROM (SELECT t.*, n, lower, middle, upper, mass BETWEEN lower - 1.5::DOUBLE * (upper - lower) AND upper + 1.5::DOUBLE * (upper - lower) AS inside
         FROM tt t JOIN (SELECT biome, guild, count(*) AS n, quantile_cont(mass, 0.25) AS lower, quantile_cont(mass, 0.5) AS middle,
           quantile_cont(mass, 0.75) AS upper FROM tt GROUP BY ALL) USING (biome, guild)) GROUP BY ALL""",
    """tt AS (SELECT n_name AS biome, p_type AS guild, ln(l_extendedprice) AS mass FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
)
def guild_boxes_by_biome(t):
    from queryset.views import GUILDS as LEVELS

    return living.guild_tables(t.traits(), ["biome"], LEVELS, "mass")["boxes"]
