"""Living species: guild against biome, realm and taxon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.functions import classify as C
from strataguild.functions.nulls import in_set
from strataguild.functions.scalar import level_rank, positive_ln, stars
from strataguild.operators import density as kde
from strataguild.operators import percentile_tests, quantiles, rank_tests, summaries
from strataguild.operators.joins import lookup_join
from strataguild.operators.rows import first_per_key
from strataguild.sources.dimensions import FIVE_GUILD_KEY, GUILD_KEY, biome_key, lookup

# Column groups whose shares or flags are combined.
PLANT_SHARES = ("diet_fruit", "diet_nect", "diet_seed", "diet_planto")
VERT_SHARES = ("diet_vend", "diet_vect", "diet_vfish", "diet_vunk", "diet_scav")
REPTILE_PLANT = (
    "cat_plant", "cat_plant_other", "cat_foliage", "cat_root", "cat_wood", "cat_nectar", "cat_fruit", "cat_grain",
)
REPTILE_INV = ("cat_invert", "cat_insect")
REPTILE_VERT = (
    "cat_scavenger", "cat_endotherm", "cat_mammal", "cat_bird", "cat_herptile", "cat_amphibian",
    "cat_reptile", "cat_fish", "cat_vertunk", "cat_vertebrate", "cat_egg",
)
# Fixed value: a species whose arthropod diet is missing from its source.
ARTHROPOD_EATER = "Atylodes genei"
# Codes of the older five-guild key -> codes of the trait table.
OLDER_CODES = {1: 1, 2: 2, 3: 5, 4: 3, 5: 4}


def trait_guilds(traits: DataFrame) -> DataFrame:
    """Land-vertebrate traits with the guild of the largest share and ln body mass."""
    shares = traits.withColumns(
        {
            "diet_plant": sum((F.col(c) for c in PLANT_SHARES[1:]), F.col(PLANT_SHARES[0])),
            "diet_vert": sum((F.col(c) for c in VERT_SHARES[1:]), F.col(VERT_SHARES[0])),
        }
    )
    guild = C.by_share(
        {"herbivore": F.col("diet_plant"), "invertivore": F.col("diet_inv"), "carnivore": F.col("diet_vert")}
    )
    return shares.select(
        "binomial", "class", "realm", guild.alias("guild"), positive_ln(F.col("body_mass_median")).alias("value")
    )


def species_by_biome(memberships: DataFrame, traits: DataFrame) -> DataFrame:
    """Biome memberships and traits side by side; species missing on either side stay."""
    named = lookup_join(
        memberships.select("binomial", F.col("biome").cast("int").alias("biome")),
        biome_key(memberships.sparkSession),
        "biome",
    )
    both = named.join(trait_guilds(traits), "binomial", "full")
    key = lookup(memberships.sparkSession, [(n, a, c) for c, n, a in GUILD_KEY], "guild string, guild_abbr string, guild_code int")
    return lookup_join(both, key, "guild").where(F.col("guild").isNotNull())


def in_biomes(species: DataFrame, animal_class: str, realm: str = "terrestrial") -> DataFrame:
    return species.where(
        (F.col("realm") == realm) & (F.col("class") == animal_class) & F.col("biome_name").isNotNull()
    )


def one_per_species(species: DataFrame, animal_class: str, realms: Sequence[str], taxon: str) -> DataFrame:
    """Each species of a class once, whatever number of biomes it lives in."""
    kept = species.where((F.col("class") == animal_class) & in_set(F.col("realm"), realms))
    return first_per_key(kept, ["binomial"], ["biome"]).withColumn("tax", F.lit(taxon))


def amphibians(traits: DataFrame) -> DataFrame:
    known = traits.where(F.col("body_mass_g").isNotNull())
    plant = C.plant_flag_all([F.col("flowers"), F.col("seeds"), F.col("fruits")])
    arthro = F.when(F.col("species") == ARTHROPOD_EATER, F.lit(1)).otherwise(F.coalesce(F.col("arthro"), F.lit(0)))
    flags = known.withColumns(
        {"_p": F.coalesce(plant, F.lit(0)), "_i": arthro, "_v": F.coalesce(F.col("vert"), F.lit(0))}
    ).where(F.col("_p") + F.col("_i") + F.col("_v") > 0)
    guild = C.by_flags({"herbivore": F.col("_p"), "invertivore": F.col("_i"), "carnivore": F.col("_v")})
    return flags.select(
        F.col("species").alias("binomial"),
        guild.alias("guild"),
        positive_ln(F.col("body_mass_g")).alias("value"),
        F.lit("Amphibians").alias("tax"),
    )


def reptiles(traits: DataFrame) -> DataFrame:
    plant = C.flag_any([F.col(c) for c in REPTILE_PLANT], skip_null=True)
    inv = C.flag_any([F.col(c) for c in REPTILE_INV], skip_null=False)
    vert = C.flag_any([F.col(c) for c in REPTILE_VERT], skip_null=False)
    kept = traits.where(F.col("class") == "REPTILIA").withColumns({"_p": plant, "_i": inv, "_v": vert})
    guild = C.by_flags({"herbivore": F.col("_p"), "invertivore": F.col("_i"), "carnivore": F.col("_v")})
    return kept.select(
        F.col("sciname").alias("binomial"),
        guild.alias("guild"),
        positive_ln(F.col("body_mass_value")).alias("value"),
        F.lit("Reptiles").alias("tax"),
    )


def fishes(traits: DataFrame, order: Sequence[str] = ("realm",)) -> DataFrame:
    """Fish taxa once each, with five guilds and ln maximum length; taxa without a length are left out."""
    once = first_per_key(traits, ["taxon"], list(order))
    return once.where(positive_ln(F.col("lmax")).isNotNull()).select(
        F.col("taxon").alias("binomial"),
        C.by_map(F.col("trophic_group"), C.FISH_TROPHIC).alias("guild"),
        positive_ln(F.col("lmax")).alias("value"),
        "realm",
        F.lit("Fishes").alias("tax"),
    )


def guild_tables(
    df: DataFrame, by: Sequence[str], levels: Sequence[str], value: str = "value", guild: str = "guild"
) -> dict[str, DataFrame]:
    """Group sizes, box statistics and neighbouring-guild median tests per partition."""
    keys = [*by, guild]
    tests = rank_tests.p_adjust(
        rank_tests.pairwise_rank_sum(df, value, guild, levels, by, pairs="adjacent")
    ).withColumn("stars", stars(F.col("p_adj"), blank_dot=True))
    return {
        "counts": summaries.group_counts(df, keys),
        "boxes": quantiles.boxplot_stats(df, keys, value)[0],
        "tests": tests,
    }


def taxon_tests(
    df: DataFrame, levels: Sequence[str], by: Sequence[str] = ("tax",), value: str = "value", guild: str = "guild"
) -> DataFrame:
    """Per taxon: all guild pairs adjusted within the taxon, neighbours kept."""
    tests = rank_tests.pairwise_rank_sum(
        df, value, guild, levels, by, pairs="all", adjust="holm", family=by
    )
    gap = level_rank(F.col("group_b"), levels) - level_rank(F.col("group_a"), levels)
    return tests.where(gap == 1)


def taxon_percentile_tests(
    df: DataFrame, levels: Sequence[str], r: int = 5000, seed: int = 1234, by: Sequence[str] = ("tax",),
    value: str = "value", guild: str = "guild",
) -> DataFrame:
    tests = percentile_tests.pairwise_percentile_test(df, value, guild, levels, by, 0.9, r, seed, "all")
    adjusted = rank_tests.p_adjust(tests, family=by).withColumn("stars", stars(F.col("p_adj")))
    gap = level_rank(F.col("group_b"), levels) - level_rank(F.col("group_a"), levels)
    return adjusted.where(gap == 1)


def among_region_medians(
    df: DataFrame, region: str, regions: Sequence[str], guild: str, guilds: Sequence[str], value: str = "value"
) -> DataFrame:
    tests = rank_tests.pairwise_rank_sum(df, value, region, regions, [guild], pairs="all")
    return rank_tests.among_region_table(tests, guild, guilds)


def among_region_percentiles(
    df: DataFrame,
    region: str,
    regions: Sequence[str],
    guild: str,
    guilds: Sequence[str],
    value: str = "value",
    r: int = 100_000,
    seed: int = 1234,
) -> DataFrame:
    tests = percentile_tests.pairwise_percentile_test(df, value, region, regions, [guild], 0.9, r, seed, "all")
    return rank_tests.among_region_table(tests, guild, guilds)


def older_group_means(memberships: DataFrame, traits: DataFrame) -> DataFrame:
    """Older five-guild variant: log10 mass means per class and guild, variances apart."""
    spark = memberships.sparkSession
    codes = F.create_map(*[F.lit(x) for kv in OLDER_CODES.items() for x in kv])
    joined = memberships.join(traits.select("binomial", "realm", "diet_5cat"), "binomial", "left")
    coded = joined.withColumn("diet_5cat", F.element_at(codes, F.col("diet_5cat").cast("int")))
    key = lookup(spark, FIVE_GUILD_KEY, "diet_5cat int, diet_name string, diet_abbr string")
    named = lookup_join(lookup_join(coded, biome_key(spark), "biome"), key, "diet_5cat")
    named = named.where(F.col("diet_abbr").isNotNull() & F.col("biome_name").isNotNull())
    land = named.where(F.col("realm") == "terrestrial")
    return summaries.group_mean_model(land, ["class", "diet_abbr"], "log10_body_mass_median")


def size_density(df: DataFrame, guilds: Sequence[str], value: str = "value", guild: str = "guild", n_grid: int = 512) -> DataFrame:
    return kde.density(df.where(in_set(F.col(guild), guilds)), value, [guild], n_grid)
