import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataguild.operators import resample as R
from strataguild.operators import trajectory as T
from strataguild.plans import future


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], [400, 90]), "v": np.round(rng.normal(5, 2, 490), 1), "id": np.arange(490)})
    return spark.createDataFrame(pdf).cache(), pdf


def frame(df, keys):
    return df.toPandas().sort_values(keys).reset_index(drop=True)


def test_bootstrap_is_independent_of_partitioning(sample):
    df, pdf = sample
    a = frame(R.bootstrap(df, ["g"], "v", 40), ["g", "rep"])
    b = frame(R.bootstrap(df.repartition(6, "id"), ["g"], "v", 40), ["g", "rep"])
    pd.testing.assert_frame_equal(a, b)
    for g, part in pdf.groupby("g"):
        mine = a[a.g == g]
        assert (mine.species == len(part)).all() and len(mine) == 40
        se = part.v.std() / np.sqrt(len(part))
        assert abs(mine.avg.mean() - part.v.mean()) < 5 * se / np.sqrt(40)
        assert 0.6 < mine.avg.std() / se < 1.5
        assert mine.y0.min() >= part.v.min() and mine.y100.max() <= part.v.max()


def test_counts_of_blocks_do_not_depend_on_how_they_are_split(spark):
    """Splitting in slices over the cluster gives the counts of splitting in place; they are multinomial."""
    items = spark.createDataFrame([("a", r, 9000, 4, 77 + r) for r in range(1, 61)], "g string, rep int, n_total bigint, _levels int, _tree bigint")
    whole = frame(R.block_counts(items, ["g"]), ["rep", "_block"])
    sliced = frame(R.block_counts(items, ["g"], split_draws=24 * 30), ["rep", "_block"])
    pd.testing.assert_frame_equal(whole, sliced)
    wide = whole.pivot(index="rep", columns="_block", values="_m")
    assert wide.shape == (60, 16) and (wide.sum(axis=1) == 9000).all()
    p = 1 / 16
    assert abs(wide.to_numpy().mean() - 9000 * p) < 1e-9
    assert 0.8 < wide.to_numpy().var() / (9000 * p * (1 - p)) < 1.2


@pytest.mark.parametrize("positions", [7, 64])
def test_blocks_cover_every_position_evenly(spark, positions):
    """Uneven blocks: every position is drawn with one chance, and the summaries are those of the drawn values."""
    n, reps = 150, 400
    df = spark.createDataFrame([("a", float(i)) for i in range(n)], "g string, v double")
    got = frame(R.bootstrap(df, ["g"], "v", reps, positions=positions), ["rep"])
    assert len(got) == reps
    mean, se = (n - 1) / 2, np.sqrt((n * n - 1) / 12 / n)
    assert abs(got.avg.mean() - mean) < 5 * se / np.sqrt(reps) and 0.85 < got.avg.std() / se < 1.15
    # Of n draws the smallest position is missed with chance (1 - 1/n)^n.
    for edge, col in ((0.0, "y0"), (n - 1.0, "y100")):
        assert abs((got[col] != edge).mean() - (1 - 1 / n) ** n) < 0.1
    assert (got[["y0", "y5", "y25", "y50", "y75", "y95", "y100"]].diff(axis=1).iloc[:, 1:] >= 0).all().all()


def test_drawn_sums_are_those_of_the_listed_draws():
    starts, values = np.array([10, 13, 14]), np.array([1.0, 5.0, 7.0])
    want = [[{"key": "k", "rank": 2}], []]
    a, b = R._drawn_sums(11, 12, 1, 1, 20, starts, values, [3, 4], np.array([50, 1]), want, 2.0)
    assert (a["rep"], b["rep"], b["picks"]) == (3, 4, []) and a["picks"][0]["value"] in values
    assert -50 <= a["s1"] <= 250 and a["s2"] >= a["s1"] ** 2 / 50


def test_numbers_mixed_in_place_are_the_plain_ones():
    from strataguild.functions.seeded import PRIME, finish_sums, finished, fold_in, opened

    state = np.r_[0, PRIME - 1, PRIME - 1, np.random.default_rng(4).integers(0, PRIME, 40_000)]
    key = np.r_[PRIME - 1, PRIME - 1, 0, np.arange(40_000)]
    sums = (opened(state) + key).astype(np.uint64)
    finish_sums(sums)
    assert (sums == finished(fold_in(state, key)).astype(np.uint64)).all()


def test_counts_travel_in_rows_of_blocks(spark):
    """2^RUN blocks a row, with the draws of all blocks before; also where a replicate is split over several nodes."""
    items = spark.createDataFrame([("a", r, 90_000, 7, 77 + r) for r in range(1, 9)], "g string, rep int, n_total bigint, _levels int, _tree bigint")
    for at_once in (1 << 24, 24 * 30):
        runs = R.block_runs(items, ["g"], at_once).toPandas()
        assert runs._m.map(len).max() <= 1 << R.RUN
        for _, own in runs.sort_values("_first").groupby("rep"):
            sums = own._m.map(sum)
            assert (own._before == sums.cumsum() - sums).all() and sums.sum() == 90_000
        if at_once == 1 << 24:
            assert len(runs) == 8 * 128 >> R.RUN


def test_subsample_sizes(sample):
    df, pdf = sample
    got = frame(R.subsample(df, ["g"], "v", [5, 50], 30), ["g", "sample", "rep"])
    assert len(got) == 2 * 2 * 30 and set(got.species) == {400, 90}
    spread = got.groupby("sample").avg.std()
    assert spread[5] > spread[50]


def test_meta_uses_trims_and_medians(spark):
    rows = [("a", 9, float(i), float(i), float(i), float(i * i), float(i), float(i), float(i), float(i), 1.0 if i else 0.0) for i in range(8)]
    names = "g string, species int, y0 double, y5 double, y25 double, y50 double, y75 double, y95 double, y100 double, avg double, stddev double"
    r = R.resample_meta(spark.createDataFrame(rows, names), ["g"], 5).first()
    assert (r["y0"], r["y5"], r["y25"]) == (3.5, 3.5, 3.5)
    assert r["y50"] == (9 + 16) / 2 and r["y100"] == 3.5
    # The replicate without spread has no weight.
    assert np.isclose(r["wtd_mean"], 4.0) and np.isclose(r["wtd_var"], sum((i - 4) ** 2 for i in range(1, 8)) / 6)
    assert R.resample_meta(spark.createDataFrame(rows, names), ["g"], 10).count() == 0


@pytest.mark.parametrize("base_digits", [1, 2])
def test_trajectory_equals_dense_definition(spark, base_digits):
    rng = np.random.default_rng(6)
    n = 100 if base_digits == 1 else 700
    pool = pd.DataFrame({"name": np.arange(n), "guild": rng.choice(["h", "c"], n), "value": rng.normal(0, 1, n)})
    pool.loc[:20, "value"] = 0.25
    # Guild "c" dies out in run 2; run 4 has no deaths.
    ev = [(r, int(i), int(rng.integers(1, 15))) for r in (1, 2, 3) for i in range(n) if rng.random() < 0.7 or (r == 2 and pool.guild[i] == "c")]
    ev = pd.DataFrame(ev, columns=["run", "name", "death_year"])
    runs = spark.createDataFrame([(r,) for r in (1, 2, 3, 4)], "run int")
    got = T.survivor_quantiles(
        spark.createDataFrame(pool), spark.createDataFrame(ev), runs, (("med", 0.5), ("q90", 0.9)), range(1, 21)
    ).toPandas()
    want = []
    for r in (1, 2, 3, 4):
        died = ev[ev.run == r].set_index("name").death_year.reindex(pool.name).fillna(10**6).to_numpy()
        for g in "hc":
            for y in range(1, 21):
                v = pool.value.to_numpy()[(pool.guild.to_numpy() == g) & (died > y)]
                if len(v):
                    want.append((r, g, y, np.quantile(v, 0.5), np.quantile(v, 0.9)))
    want = pd.DataFrame(want, columns=["run", "guild", "year", "med", "q90"])
    both = want.merge(got, on=["run", "guild", "year"], suffixes=("", "_got"))
    assert len(both) == len(want) == len(got)
    assert np.allclose(both.med, both.med_got) and np.allclose(both.q90, both.q90_got)
    assert not ((want.run == 2) & (want.guild == "c") & (want.year == 15)).any()


def test_percent_change(spark):
    runs = spark.createDataFrame([(1, "h", 1, 2.0), (2, "h", 1, 4.0), (1, "h", 2, 1.0)], "run int, guild string, year int, stat double")
    start = spark.createDataFrame([("h", 3.0, 0, float(np.exp(3.0)))], "guild string, stat double, year int, stat_e double")
    change = {r["year"]: r for r in future.trajectory_change(future.trajectory_summary(runs, start), start).collect()}
    assert np.isclose(change[0]["mean"], 0) and np.isclose(change[1]["mean"], 0)
    assert np.isclose(change[2]["low_ci"], (np.exp(1.0) - np.exp(3.0)) / np.exp(3.0) * 100)
    assert np.isclose(change[1]["upp_ci_50"], (np.exp(3.5) / np.exp(3.0) - 1) * 100)


def test_pools(spark):
    present = spark.createDataFrame([("a b", 2.0, 100.0, 0.0, 0.0), ("Oryx dammah", 3.0, 0.0, 100.0, 0.0)], "name string, value double, diet_plant double, diet_vert double, diet_inv double")
    extinct = spark.createDataFrame([("x y", float(np.exp(4)), 10.0, 40.0, 50.0)], "name string, mass double, diet_plant double, diet_vert double, diet_inv double")
    pool = future.pleistocene_pool(present, extinct)
    got = {r["name"]: (round(r["value"], 9), r["guild"]) for r in pool.collect()}
    assert got == {"a b": (2.0, "herbivore"), "Oryx dammah": (3.0, "carnivore"), "x y": (4.0, "omnivore")}
    assert [r["name"] for r in future.present_pool(pool, present).collect()] == ["a b"]


def test_null_guild_has_a_trajectory(spark):
    from strataguild.operators.trajectory import survivor_quantiles

    pool = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0), (3, "g", 5.0)], "name int, guild string, value double")
    dead = spark.createDataFrame([(1, 2, 1)], "run int, name int, death_year int")
    runs = spark.createDataFrame([(1,)], "run int")
    got = {(r["guild"], r["year"]): r["m"] for r in survivor_quantiles(pool, dead, runs, (("m", 0.5),), [1, 2]).collect()}
    assert got == {(None, 1): 2.0, (None, 2): 2.0, ("g", 1): 5.0, ("g", 2): 5.0}
