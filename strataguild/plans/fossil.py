"""Species compiled from three sources, binned into intervals, tested and resampled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataguild.functions import classify as C
from strataguild.functions.nulls import in_set, matches, not_in_set, to_number
from strataguild.functions.scalar import (
    first_true,
    interval_label,
    level_rank,
    normal_interval,
    override,
    positive_ln,
    recode,
    stars,
)
from strataguild.operators import percentile_tests, quantreg, rank_tests, resample, summaries
from strataguild.operators.joins import enrich, overlap_join
from strataguild.operators.reshape import stack_loose, stack_sources, to_long
from strataguild.operators.rows import with_levels

# Order names replaced by their current names.
ORDER_SYNONYMS = {
    "Soricomorpha": "Eulipotyphla",
    "Lipotyphla": "Eulipotyphla",
    "Hicanodonta": "Cingulata",
    "Xenarthra": "Pilosa",
}
# Base of the Pleistocene (Myr) given to every late Quaternary species.
PLEISTOCENE_BASE = 2.58
SOURCE_PRIORITY = ("mom", "lyons", "supp")
SOURCE_STACK = ("lyons", "mom", "supp")
COMMON = ("name", "order", "fad", "lad", "guild", "value", "continent")
PERIODS = ("Pleistocene", "Holocene", "Modern", "Future")
# Lengths of extinction events in years.
FUTURE_YEARS = 500
EVENT_YEARS = {"AF": 11500, "AUS": 40000, "EA": 38500, "NA": 2000, "SA": 6500}


def clean_taxon_source(species: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """First source: update from the taxonomy list, keep land species, average duplicates.

    ``species`` has genus_species, order, family, pbdb_diet, pbdb_life_habit, fad, lad
    and lnmass_g; ``taxonomy`` has taxon_name, accepted_name, accepted_rank, diet,
    life_habit, order and family.
    """
    both = enrich(species, taxonomy, "genus_species", "taxon_name", "tax_")
    updated = both.withColumns(
        {
            "pbdb_diet": override(F.col("tax_diet"), F.col("pbdb_diet")),
            "pbdb_life_habit": override(F.col("tax_life_habit"), F.col("pbdb_life_habit")),
            "name": override(F.col("tax_accepted_name"), F.col("genus_species")),
            "order": override(F.col("tax_order"), F.col("order"), "NO_ORDER_SPECIFIED"),
            "family": override(F.col("tax_family"), F.col("family"), "NO_FAMILY_SPECIFIED"),
        }
    )
    kept = updated.where(
        F.col("pbdb_diet").isNotNull()
        & F.col("fad").isNotNull()
        & F.col("lad").isNotNull()
        & not_in_set(F.col("pbdb_life_habit"), ["aquatic"])
        & (F.col("tax_accepted_rank").isNull() | (F.col("tax_accepted_rank") == "species"))
    )
    keys = ["order", "name", "fad", "lad", "pbdb_diet"]
    mean = summaries.mean_of_distinct(kept, keys, "lnmass_g")
    return mean.withColumns(
        {
            "guild": C.by_text(F.col("pbdb_diet"), C.FOSSIL_RULES, C.OMNIVORE_TEXT),
            "value": F.col("lnmass_g"),
            "continent": F.lit("NA"),
        }
    ).select(*COMMON)


def clean_quaternary_source(df: DataFrame) -> DataFrame:
    """Second source, with the status and time of extinction kept for the range tables.

    Columns used: genus, species, order, continent, status, mass_status, to_do, trophic,
    habitat_mode, time_of_extinction, logmass_g, combined_mass_g, last_occurance_kybp.
    """
    kept = df.where(
        (F.col("mass_status") == "valid")
        & (F.col("logmass_g") > 0)
        & F.col("to_do").isNull()
        & F.col("trophic").isNotNull()
        # "NA" matches inside any habitat word, in either case.
        & ~matches(F.col("habitat_mode"), "^aquatic$|marine|NA")
    )
    return kept.select(
        F.concat_ws(" ", "genus", "species").alias("name"),
        "order",
        F.lit(PLEISTOCENE_BASE).alias("fad"),
        C.last_occurrence(F.col("status"), F.col("last_occurance_kybp")).alias("lad"),
        C.by_text(F.col("trophic"), C.LIVING_RULES).alias("guild"),
        positive_ln(to_number(F.col("combined_mass_g"))).alias("value"),
        "continent",
        "status",
        "time_of_extinction",
    )


def clean_added_source(df: DataFrame) -> DataFrame:
    """Third source: measured mass unless it comes from the second source, else the estimate."""
    measured = F.col("ln_mass_g").isNotNull() & (F.col("mass_source") != "Smith et al 2018")
    return df.where(measured | F.col("ln_mass_g_estimate").isNotNull()).select(
        F.col("taxon_name").alias("name"),
        "order",
        F.col("firstapp_max_ma").alias("fad"),
        F.col("lastapp_min_ma").alias("lad"),
        C.by_text(F.col("diet"), C.LIVING_RULES, C.OMNIVORE_TEXT).alias("guild"),
        F.when(measured, F.col("ln_mass_g")).otherwise(F.col("ln_mass_g_estimate")).alias("value"),
        F.lit("NA").alias("continent"),
    )


def compile_species(taxon: DataFrame, quaternary: DataFrame, added: DataFrame) -> DataFrame:
    """Union of the cleaned sources with duplicates merged per species and continent."""
    parts = [("lyons", taxon), ("mom", quaternary.select(*COMMON)), ("supp", added)]
    stacked = stack_sources(parts).withColumn("order", recode(F.col("order"), ORDER_SYNONYMS))
    merged = summaries.merge_duplicates(
        stacked,
        ["name", "continent"],
        "source",
        SOURCE_PRIORITY,
        picks=["guild"],
        row_order=["order", "fad", "lad", "value"],
        texts=["order"],
        highest=["fad"],
        lowest=["lad"],
        means=["value"],
        stack_order=SOURCE_STACK,
    )
    return with_levels(merged, "guild", C.GUILDS, "guild_rank").drop("guild_rank")


def compiled_table(species: DataFrame, bounds: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Species with the intervals of first (low, high] and last [low, high) occurrence."""
    placed = species.withColumns(
        {
            "fad_interval": interval_label(F.col("fad"), bounds, "right"),
            "lad_interval": interval_label(F.col("lad"), bounds, "left"),
        }
    )
    kept = placed.where(F.col("fad_interval").isNotNull() & F.col("lad_interval").isNotNull())
    columns = ["order", "name", "value", "guild", "fad", "lad", "fad_interval", "lad_interval", "sources"]
    return kept.select(*columns).orderBy("order", "name")


def bin_through_time(species: DataFrame, intervals: DataFrame) -> DataFrame:
    """Every species once per interval it overlaps."""
    return overlap_join(species, intervals)


def guild_tests(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[str],
    value: str = "value",
    guild: str = "guild",
    blank_dot: bool = True,
) -> DataFrame:
    """Neighbouring guilds compared at the median in every partition, adjusted together."""
    tests = rank_tests.pairwise_rank_sum(df, value, guild, levels, by, pairs="adjacent")
    adjusted = rank_tests.p_adjust(tests)
    return adjusted.withColumn("stars", stars(F.col("p_adj"), blank_dot))


def guild_percentile_tests(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[str],
    value: str = "value",
    guild: str = "guild",
    r: int = 5000,
    seed: int = 1234,
    tau: float = 0.9,
) -> DataFrame:
    """Neighbouring guilds compared at the 90th percentile by permutation, adjusted together."""
    tests = percentile_tests.pairwise_percentile_test(
        df, value, guild, levels, by, tau, r, seed, pairs="adjacent"
    )
    return rank_tests.p_adjust(tests).withColumn("stars", stars(F.col("p_adj")))


def resampling_sensitivity(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sizes: Sequence[int] = tuple(range(5, 101, 5)),
    sample_reps: int = 100,
    boot_reps: int = 1000,
    seed: int = 1234,
    rng: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """Replicate statistics of subsamples and of full-size resamples, with 95% ranges."""
    sub = resample.resample_meta(
        resample.subsample(df, by, value, sizes, sample_reps, seed, rng), [*by, "sample"], 4
    )
    boot = resample.resample_meta(resample.bootstrap(df, by, value, boot_reps, seed, rng), by, 5)
    return with_ranges(sub), with_ranges(boot)


def with_ranges(meta: DataFrame) -> DataFrame:
    raw = normal_interval(F.col("raw_mean"), F.col("raw_sd"))
    wtd = normal_interval(F.col("wtd_mean"), F.sqrt("wtd_var"))
    return meta.withColumns(
        {"raw_low": raw[0], "raw_upp": raw[1], "wtd_low": wtd[0], "wtd_upp": wtd[1]}
    )


def periods(quaternary: DataFrame, intervals: DataFrame) -> DataFrame:
    """Species per period: two youngest intervals (touching counts), modern and future."""
    old = overlap_join(quaternary, intervals, closed=True).withColumn("bin", F.col("interval"))
    modern = quaternary.where(F.col("status") == "extant").withColumn("bin", F.lit("Modern"))
    future = modern.where(not_in_set(F.col("time_of_extinction"), ["Future", "Future2"])).withColumn(
        "bin", F.lit("Future")
    )
    columns = [*quaternary.columns, "bin"]
    both = stack_loose(old.select(*columns), modern.select(*columns), future.select(*columns))
    return with_levels(both, "bin", PERIODS, "bin_rank").drop("bin_rank")


def size_ranges(per_period: DataFrame, by: Sequence[str] = ("guild", "bin")) -> DataFrame:
    return summaries.range_summary(per_period, list(by), "value", "name")


def guild_contrasts(ranges: DataFrame) -> DataFrame:
    out = summaries.period_contrasts(ranges, ["guild"])
    return out.withColumn("diet_num", level_rank(F.col("guild"), C.GUILDS))


def rates_of_change(ranges: DataFrame) -> DataFrame:
    """Change of median size per year, past and future, per guild and continent."""
    stats = summaries.period_contrasts(
        ranges.where(F.col("continent") != "Insular"), ["guild", "continent"]
    ).withColumns(
        {
            "diff_pleis": F.col("extant_med") - F.col("med"),
            "diff_future": F.col("future_med") - F.col("extant_med"),
        }
    )
    long = to_long(stats, ["guild", "continent"], ["diff_pleis", "diff_future"], "time", "diff", "diff_")
    cases = [(F.col("time") == "future", FUTURE_YEARS)]
    cases += [(F.col("continent") == c, years) for c, years in EVENT_YEARS.items()]
    timed = long.withColumn("length", first_true(cases).cast("double")).withColumn(
        "rate", F.col("diff") / F.col("length")
    )
    return summaries.log_shift(timed, "rate")


def rate_limits(rates: DataFrame, taus: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """Quantile lines of past rates on log10 event length, per guild."""
    past = rates.where((F.col("time") == "pleis") & in_set(F.col("guild"), C.GUILDS))
    return quantreg.quantile_regression(
        past.withColumn("log_length", F.log10("length")), "log_length", "rate", taus, ["guild"]
    )
