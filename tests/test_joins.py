import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataguild.operators import joins as J
from strataguild.operators import reshape as R
from strataguild.operators import rows as W
from strataguild.operators import summaries as S


def spans(spark, n=60):
    rng = np.random.default_rng(4)
    fad = np.round(rng.uniform(0, 20, n), 1)
    lad = np.round(fad - rng.uniform(0, 6, n), 1)
    return pd.DataFrame({"name": np.arange(n), "fad": fad, "lad": lad})


def test_overlap_edges(spark):
    ages = spark.createDataFrame([("a", 5.0, 3.0), ("b", 3.0, 3.0), ("c", 3.0, 1.0), ("d", None, 1.0)], "name string, fad double, lad double")
    bins = spark.createDataFrame([("old", 5.0, 3.0), ("young", 3.0, 0.0)], "interval string, hi double, lo double")
    open_ = {(r["name"], r["interval"]) for r in J.overlap_join(ages, bins).collect()}
    closed = {(r["name"], r["interval"]) for r in J.overlap_join(ages, bins, closed=True).collect()}
    assert open_ == {("a", "old"), ("c", "young")}
    assert closed == {("a", "old"), ("a", "young"), ("b", "old"), ("b", "young"), ("c", "old"), ("c", "young")}


@pytest.mark.parametrize("sent", [True, False])
@pytest.mark.parametrize("closed", [True, False])
def test_overlap_matches_all_comparisons(spark, sent, closed, monkeypatch):
    """Narrow, wide, nested, equal and reversed ranges, nulls, and a crowd in the youngest interval; by broadcast and by shuffle."""
    if not sent:
        monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(7)
    ages = [(int(i), float(f), float(la)) for i, f, la in spans(spark).itertuples(index=False)]
    ages += [(100 + i, float(x), float(x) / 2) for i, x in enumerate(rng.uniform(0, 0.01, 200))]
    ages += [(400, 25.0, -5.0), (401, 3.0, 3.0), (401, 3.0, 3.0), (402, None, 1.0), (403, 2.0, None), (404, 1.0, 4.0), (405, 1e9, 1e8), (406, float("inf"), 19.0)]
    bins = [(i * 10 + w, float(i + w), float(i)) for i in range(20) for w in (1, 3)]
    bins += [(1000 + i, float(x) + 0.001, float(x)) for i, x in enumerate(np.round(rng.uniform(0, 0.01, 40), 4))]
    bins += [(2000, 20.0, 0.0), (2001, 5.0, 5.0), (2002, None, 1.0), (2003, 1.0, 6.0), (2004, float("inf"), 20.0)]

    def meets(s, i):
        if None in (*s, *i):
            return False
        return s[2] <= i[1] and s[1] >= i[2] if closed else s[2] < i[1] and s[1] > i[2]

    want = sorted((s[0], i[0]) for s in ages for i in bins if meets(s, i))
    df = spark.createDataFrame(ages, "name int, fad double, lad double").repartition(3)
    ranges = spark.createDataFrame(bins, "i int, hi double, lo double").repartition(3)
    joined = J.overlap_join(df, ranges, closed=closed)
    assert sorted((r["name"], r["i"]) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert J.overlap_join(df, ranges.limit(0)).count() == 0 and J.overlap_join(df.limit(0), ranges).count() == 0


def test_cover_and_path_meet_once(spark):
    """A cell and a range share one node if the cell lies in the range, else none."""
    rows = [(a, b, c) for a in range(8) for b in range(a, 8) for c in range(8)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    both = F.size(F.array_intersect(J._cover("a", "b", 3), J._path("c", range(4), 3)))
    assert all(r["n"] == (r["a"] <= r["c"] <= r["b"]) for r in df.select("*", both.alias("n")).collect())


def test_null_safe_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert [tuple(r) for r in J.same_keys(a, b, ["k"]).collect()] == [(None, 2, 3)]
    full = {tuple(r) for r in J.same_keys(a, b, ["k"], "full").collect()}
    assert full == {("x", 1, None), (None, 2, 3), ("y", None, 4)}


def test_exclusion_keeps_nulls_and_survivors_are_per_run(spark):
    pool = spark.createDataFrame([("a",), ("b",)], "name string")
    dead = spark.createDataFrame([(1, "a", 3), (2, "b", 9)], "run int, name string, death_year int")
    got = {(r["run"], r["name"]) for r in J.survivors(J.per_run(pool, spark.createDataFrame([(1,), (2,), (3,)], "run int")), dead).collect()}
    assert got == {(1, "b"), (2, "a"), (3, "a"), (3, "b")}
    assert {r["name"] for r in J.alive_in_year(pool, dead, 3).collect()} == {"b"}


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, "z"), ("k", 1, "y"), ("m", 9, "w")], "k string, o int, v string")
    got = {tuple(r) for r in W.first_per_key(df, ["k"], ["o", "v"]).collect()}
    assert got == {("k", 1, "y"), ("m", 9, "w")}


def test_levels_outside_the_list_become_null(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,)], "g string")
    got = [tuple(r) for r in W.with_levels(df, "g", ["a", "b"], "ord").collect()]
    assert got == [("b", 2), (None, None), (None, None)]


def test_merge_duplicates(spark):
    rows = [
        ("sp", "NA", "lyons", "Pilosa", 9.0, 1.0, 2.0, "herbivore"),
        ("sp", "NA", "supp", "Cingulata", 12.0, 0.5, 4.0, "carnivore"),
        ("sp", "NA", "supp", "Pilosa", 3.0, 0.7, 6.0, "omnivore"),
        ("sp", "NA", "mom", None, 2.58, 0.0, 8.0, "invertivore"),
        ("two", "NA", "supp", "A", 1.0, 0.0, 1.0, "omnivore"),
        ("two", "NA", "lyons", "A", None, 0.0, 3.0, "herbivore"),
    ]
    df = spark.createDataFrame(rows, "name string, continent string, source string, ord string, fad double, lad double, v double, guild string")
    out = S.merge_duplicates(
        df, ["name", "continent"], "source", ("mom", "lyons", "supp"), ["guild"], ["fad"], ["ord"], ["fad"], ["lad"], ["v"],
        stack_order=("lyons", "mom", "supp"),
    )
    got = {r["name"]: r for r in out.collect()}
    sp = got["sp"]
    assert (sp["guild"], sp["sources"], sp["ord"]) == ("invertivore", "lyons, mom, supp, supp", "Pilosa, Cingulata")
    assert (sp["fad"], sp["lad"], sp["v"]) == (12.0, 0.0, 5.0)
    two = got["two"]
    # A missing age makes the merged age missing.
    assert (two["guild"], two["fad"], two["v"], two["sources"]) == ("herbivore", None, 2.0, "lyons, supp")


def test_mean_of_distinct_propagates_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", None), ("b", 5.0)], "g string, v double")
    assert dict(map(tuple, S.mean_of_distinct(df, ["g"], "v").collect())) == {"a": 2.0, "b": None}
    assert dict(map(tuple, S.mean_of_distinct(df, ["g"], "v", na="skip").collect())) == {"a": 2.0, "b": 5.0}


def test_matrix_to_events(spark):
    df = spark.createDataFrame([("a", 0.2, None), ("b", 7.0, 499.5)], "sp string, r1 double, r2 double")
    got = {tuple(r) for r in R.events_from_matrix(df, "sp", ["r1", "r2"]).collect()}
    assert got == {(1, "a", 0.2, 1), (1, "b", 7.0, 7), (2, "b", 499.5, 500)}


def test_log_shift(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (2.0,)], "rate double")
    got = {r["rate"]: r for r in S.log_shift(df, "rate").collect()}
    c = np.trunc(np.log10(0.5))
    assert np.isclose(got[-0.5]["log_corr_rate"], np.log10(10**c) - c)
    assert np.isclose(got[2.0]["log_corr_rate"], np.log10(2.5 + 10**c) - c)
