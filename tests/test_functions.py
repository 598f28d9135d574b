import math

from pyspark.sql import functions as F

from strataguild.functions import classify as C
from strataguild.functions import nulls, scalar
from strataguild.functions.normal import two_sided_p
from strataguild.functions.seeded import mix31


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_rules(spark):
    df = spark.createDataFrame([("Insects", "1.5"), (None, "junk"), ("x", None)], "a string, n string")
    got = rows(
        df.select(
            nulls.matches(F.col("a"), "insect"),
            nulls.in_set(F.col("a"), ["x"]),
            nulls.not_in_set(F.col("a"), ["x"]),
            nulls.to_number(F.col("n")),
            nulls.null_tokens(F.col("n"), ["junk"]),
        )
    )
    assert got == [
        (True, False, True, 1.5, "1.5"),
        (False, False, True, None, None),
        (False, True, False, None, None),
    ]


def test_aggregate_null_policy(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    got = dict(rows(df.groupBy("g").agg(nulls.propagate(F.max("v"), F.col("v")))))
    assert got == {"a": None, "b": 2.0}


def test_logs_of_bad_values_are_null(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-2.0,), (None,)], "v double")
    assert rows(df.select(scalar.positive_ln(F.col("v")))) == [(0.0,), (None,), (None,), (None,)]


def test_interval_edges(spark):
    bounds = [("low", 0.0, 5.0), ("high", 5.0, 9.0)]
    df = spark.createDataFrame([(0.0,), (5.0,), (9.0,), (None,)], "v double")
    got = rows(
        df.select(
            scalar.interval_label(F.col("v"), bounds, "right"), scalar.interval_label(F.col("v"), bounds, "left")
        )
    )
    assert got == [(None, "low"), ("low", "high"), ("high", None), (None, None)]


def test_row_arg_max_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 2, 2), (1, None, 3)], "a int, b int, c int")
    cols = [F.col(c) for c in "abc"]
    assert rows(df.select(scalar.row_arg_max(cols, ["x", "y", "z"]))) == [("x",), ("y",), (None,)]


def test_guild_from_text(spark):
    texts = ["Browser", "omnivore", "carnivore, insects", "PISCIVORE", None, "unknown", "granivore"]
    df = spark.createDataFrame([(x,) for x in texts], "d string")
    got = rows(
        df.select(
            C.by_text(F.col("d"), C.FOSSIL_RULES, C.OMNIVORE_TEXT), C.by_text(F.col("d"), C.LIVING_RULES)
        )
    )
    assert [g[0] for g in got] == [
        "herbivore", "omnivore", "omnivore", "carnivore", "herbivore", "herbivore", "herbivore",
    ]
    # The second source has no omnivore text and a narrower plant pattern.
    assert [g[1] for g in got] == [
        "herbivore", "herbivore", "omnivore", "carnivore", "herbivore", "herbivore", "herbivore",
    ]


def test_guild_from_shares_and_flags(spark):
    df = spark.createDataFrame([(50, 50, 0), (60, 0, 40), (0, 0, 100), (None, 80, 20)], "p int, i int, v int")
    shares = {"herbivore": F.col("p"), "invertivore": F.col("i"), "carnivore": F.col("v")}
    assert [r[0] for r in rows(df.select(C.by_share(shares)))] == ["omnivore", "herbivore", "carnivore", None]
    flags = spark.createDataFrame([(1, 1, 0), (0, 1, 0), (0, 0, 0), (None, 1, 0)], "p int, i int, v int")
    assert [r[0] for r in rows(flags.select(C.by_flags(shares)))] == ["omnivore", "invertivore", None, None]


def test_fish_map_and_last_occurrence(spark):
    df = spark.createDataFrame([("omnivore", "extant", "5"), ("Squid eater", "extinct", "11.7"), (None, "x", "?")], "t string, s string, k string")
    got = rows(df.select(C.by_map(F.col("t"), C.FISH_TROPHIC), C.last_occurrence(F.col("s"), F.col("k"))))
    assert got == [("omnivore", 0.0), (None, 11.7 / 1000), (None, None)]


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.0, 1.959964, 3.0, 5.0, 7.0, 7.2, 10.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for (z, p) in rows(df.select("z", two_sided_p(F.col("z")))):
        assert math.isclose(p, math.erfc(z / math.sqrt(2)), rel_tol=2e-8)


def test_mix_is_spread_evenly(spark):
    df = spark.range(20000).select((mix31([F.col("id"), F.lit(3)], 7) % 10).alias("d"))
    counts = [r["count"] for r in df.groupBy("d").count().collect()]
    assert len(counts) == 10 and max(counts) < 2200 and min(counts) > 1800


def test_stars(spark):
    ps = [0.001, 0.0011, 0.01, 0.05, 0.1, 0.2, None]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert [r[0] for r in rows(df.select(scalar.stars(F.col("p"))))] == ["***", "**", "**", "*", ".", " ", None]
    assert rows(df.select(scalar.stars(F.col("p"), blank_dot=True)))[4][0] == " "


def test_numbers_in_text(spark):
    cases = {".5 cm": 0.5, "1,200 cm": 1200.0, "~20 cm": 20.0, "13.5 cm, 165 cm": 13.5, "-3": -3.0, "7.": 7.0, "none": None, "": None}
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", scalar.parse_number(F.col("t")).alias("n")).collect()} == {**cases, None: None}
