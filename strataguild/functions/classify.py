"""Rules that turn a diet text, diet shares or diet flags into an ordered guild."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataguild.functions.nulls import in_set, matches, to_number
from strataguild.functions.scalar import row_arg_max, row_max, row_min, row_sum

# The ordered guild levels.
GUILDS = ("herbivore", "omnivore", "invertivore", "carnivore")
FISH_GUILDS = ("herbivore", "planktivore", "omnivore", "benthic carnivore", "higher carnivore")

# Text patterns per source, tested in this order.
FOSSIL_RULES = (
    ("herbivore", "herb|brows|frug|graz|foliv|gran"),
    ("carnivore", "carn|piscivore"),
    ("invertivore", "insect"),
)
LIVING_RULES = (
    ("herbivore", "browse|frug|graze"),
    ("carnivore", "carn|piscivore"),
    ("invertivore", "insect"),
)
OMNIVORE_TEXT = "omni"


def by_text(
    diet: Column,
    rules: Sequence[tuple[str, str]],
    omnivore_text: str | None = None,
    omnivore: str = "omnivore",
) -> Column:
    """Guild from a text.

    Two or more matching rules, or the omnivore text, give the omnivore guild;
    otherwise the first matching rule wins, and no match at all (a null text
    included) falls back to the first rule.
    """
    hits = [matches(diet, pattern) for _, pattern in rules]
    several = row_sum([h.cast("int") for h in hits]) > 1
    if omnivore_text is not None:
        several = matches(diet, omnivore_text) | several
    out = F.when(several, F.lit(omnivore))
    for hit, (label, _) in zip(hits, rules):
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit(rules[0][0]))


def by_share(
    shares: Mapping[str, Column], cutoff: float = 50.0, omnivore: str = "omnivore"
) -> Column:
    """Guild with the largest share, or omnivore if no share exceeds the cutoff."""
    cols = list(shares.values())
    return F.when(row_max(cols) <= cutoff, F.lit(omnivore)).otherwise(
        row_arg_max(cols, list(shares))
    )


def by_flags(flags: Mapping[str, Column], omnivore: str = "omnivore") -> Column:
    """Guild of the only set flag; several flags give omnivore, none or a null give null."""
    cols = list(flags.values())
    total = row_sum(cols)
    return F.when(total > 1, F.lit(omnivore)).when(total > 0, row_arg_max(cols, list(flags)))


def plant_flag_all(cols: Sequence[Column]) -> Column:
    """Amphibian plant flag: the row minimum over the known columns."""
    return row_min(cols, skip_null=True)


def flag_any(cols: Sequence[Column], skip_null: bool) -> Column:
    """Reptile flag: the row maximum, with nulls skipped or passed on."""
    return row_max(cols, skip_null=skip_null)


def by_map(col: Column, mapping: Mapping[str, str]) -> Column:
    """Guild by exact text; unknown texts give null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col)


# Trophic group texts of the fish tables.
FISH_TROPHIC = {
    "Herbivore": "herbivore",
    "Planktivore": "planktivore",
    "Omnivore": "omnivore",
    "omnivore": "omnivore",
    "Benthic carnivore": "benthic carnivore",
    "Higher carnivore": "higher carnivore",
}


def last_occurrence(
    status: Column, age_kyr: Column, living: Sequence[str] = ("extant", "historical")
) -> Column:
    """Age of last occurrence in Myr: zero for living species, else thousands of years / 1000."""
    return F.when(in_set(status, living), F.lit(0.0)).otherwise(to_number(age_kyr) / 1000.0)
