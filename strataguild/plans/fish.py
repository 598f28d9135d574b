"""Two small tables of fossil fish joined into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataguild.functions.scalar import parse_number, positive_ln
from strataguild.operators.reshape import stack_loose
from strataguild.operators.rows import with_levels
from strataguild.sources.files import read_csv

LEVELS = ("Herbivore", "Planktivore", "Omnivore", "Benthic carnivore", "Higher carnivore")
FIRST = (
    ("Species", "string"),
    ("Name", "string"),
    ("Family", "string"),
    ("Habitat", "string"),
    ("Length (cm)", "double"),
    ("Trophic Level", "double"),
    ("V_diet_cat", "string"),
    ("notes", "string"),
)
SECOND = (
    ("Species", "string"),
    ("est_SL", "string"),
    ("est_ML", "string"),
    ("Diet", "string"),
    ("V_diet", "string"),
    ("notes", "string"),
)
BLANKS = ("", "NA")


def fossil_fish_table(spark: SparkSession, first_path: str, second_path: str) -> DataFrame:
    one = read_csv(spark, first_path, FIRST, na=BLANKS)
    one = with_levels(one.withColumn("diet_cat", F.col("v_diet_cat")), "diet_cat", LEVELS, "diet_rank")
    one = one.withColumn("study", F.lit("Cavin et al. 2015"))
    two = read_csv(spark, second_path, SECOND, na=BLANKS)
    two = with_levels(two.withColumn("diet_cat", F.col("v_diet")), "diet_cat", LEVELS, "diet_rank")
    two = two.withColumns({"length_cm": parse_number(F.col("est_ml")), "study": F.lit("Maisey 1994")})
    return stack_loose(one, two).withColumn("ln_length", positive_ln(F.col("length_cm")))
