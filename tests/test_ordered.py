import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataguild.operators import order_stats as O
from strataguild.operators import quantiles as Q
from strataguild.operators import rank_search as R
from strataguild.operators import summaries as S
from strataguild.operators.density import density
from strataguild.operators.quantreg import quantile_regression


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value repeats often, one group is tiny, one is the null group."""
    rng = np.random.default_rng(5)
    n = 4000
    g = rng.choice(["hot", "cold", "tiny", None], n, p=[0.8, 0.15, 0.01, 0.04])
    v = np.where(rng.random(n) < 0.3, 2.5, rng.normal(0, 1, n) * 10.0 ** rng.integers(-3, 3, n))
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(n)})
    return spark.createDataFrame(pdf, "g string, v double, id bigint").repartition(5).cache(), pdf


def groups(pdf):
    for name in ("hot", "cold", "tiny", None):
        part = pdf[pdf.g.isna()] if name is None else pdf[pdf.g == name]
        yield name, np.sort(part.v.to_numpy())


NARROW = {
    "close": lambda i: 1e6 + i / 20_000,
    "wide": lambda i: 10.0 ** (-i / 60),
    "tied": lambda i: float(i % 7),
    "half tied": lambda i: 5.0 if i % 2 else float(i),
    "one": lambda i: 3.25,
}


@pytest.mark.parametrize("method", ["rescan", "histogram"])
def test_quantiles_of_any_spread_keep_tasks_short(spark, method):
    """Close, very wide and tied values: ranks are exact and no task sorts more than a set number of rows."""
    n, short = 20_000, 400
    rows = [(name, f(i)) for name, f in NARROW.items() for i in range(n)] + [("few", float(i)) for i in range(11)] + [(None, 1.0)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "v"]), "g string, v double").repartition(6).cache()
    found = Q.interpolated(Q.order_statistics(df, ["g"], "v", Q.RESAMPLE, method, short=short), ["g"], Q.RESAMPLE)
    got = {r["g"]: r for r in found.collect()}
    for name, f in [*NARROW.items(), ("few", float)]:
        x = [f(i) for i in range(11 if name == "few" else n)]
        assert got[name]["n"] == len(x)
        for col, p in Q.RESAMPLE:
            assert np.isclose(got[name][col], np.quantile(x, p), rtol=1e-12), (name, col)
    assert got[None]["y50"] == 1.0
    base = O.value_histogram(df, ["g"], "v") if method == "histogram" else df
    weight = "n" if method == "histogram" else None
    rounds = list(R.narrowed(base, ["g"], "v", Q._wanted("_total", Q.RESAMPLE), [p for _, p in Q.RESAMPLE], weight, short))
    assert 2 <= len(rounds) <= 4
    for live, tasks in rounds:
        most = live.join(tasks.select("g", "_seg"), ["g", "_seg"]).groupBy("g", "_seg").count().agg(F.max("count")).first()[0]
        assert most is None or most <= short


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=2, max_size=120))
def test_stretches_keep_the_order_of_any_doubles(spark, vals):
    edges = sorted((vals * R.EDGES)[: R.EDGES])
    df = spark.createDataFrame([(float(v), [float(e) for e in edges]) for v in sorted(vals)], "v double, e array<double>")
    at = [r[0] for r in df.select(R.stretch(F.col("v"), F.col("e"))).collect()]
    assert at == sorted(at)
    assert all((k % 2 == 1) == (float(v) in edges) for k, v in zip(at, sorted(vals)))


def test_quantiles_compute_their_input_once(spark):
    """A value that differs at every computation still gives ranks of one of them."""
    df = spark.range(0, 30_000, 1, 4).select((F.col("id") % 2).alias("g"), F.rand().alias("v"))
    seen = Q.quantiles(df, ["g"], "v", (("low", 0.0), ("mid", 0.5), ("high", 1.0))).collect()
    assert len(seen) == 2 and all(0 <= r["low"] < 0.01 and 0.45 < r["mid"] < 0.55 and r["high"] > 0.99 for r in seen)


@pytest.mark.parametrize("method", ["rescan", "histogram", "builtin"])
def test_quantiles_match_linear_interpolation(skewed, method):
    df, pdf = skewed
    got = {r["g"]: r for r in Q.quantiles(df, ["g"], "v", Q.RESAMPLE, method).collect()}
    for name, x in groups(pdf):
        assert got[name]["n"] == len(x)
        for col, p in Q.RESAMPLE:
            assert np.isclose(got[name][col], np.quantile(x, p), rtol=1e-12)


def test_positions_and_lookup(skewed):
    df, pdf = skewed
    pos = O.with_positions(O.value_histogram(df, ["g"], "v"), ["g"], "v")
    asked = pos.groupBy("g").agg(F.max("n_total").alias("n_total")).withColumn(
        "rank", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_total")))
    )
    got = O.values_at_ranks(pos, asked, ["g"], "v").toPandas()
    for name, x in groups(pdf):
        part = got[got.g.isna()] if name is None else got[got.g == name]
        assert np.array_equal(part.sort_values("rank").v.to_numpy(), x)


def test_lookup_over_wide_ties(spark):
    """One value spans many slices of the rank axis."""
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 100000), ("a", 3.0, 7)], "g string, v double, w bigint")
    pos = O.with_positions(O.value_histogram(df, ["g"], "v", "w"), ["g"], "v")
    ranks = [1, 5, 6, 70, 50000, 100005, 100006, 100012]
    asked = spark.createDataFrame([("a", r, 100012) for r in ranks], "g string, rank bigint, n_total bigint")
    got = {r["rank"]: r["v"] for r in O.values_at_ranks(pos, asked, ["g"], "v").collect()}
    assert got == {1: 1.0, 5: 1.0, 6: 2.0, 70: 2.0, 50000: 2.0, 100005: 2.0, 100006: 3.0, 100012: 3.0}


def test_hdi_trim_and_box(skewed):
    df, pdf = skewed
    hdi = {r["g"]: r for r in Q.hdi(df, ["g"], "v").collect()}
    trims = {t: {r["g"]: r["trimmed_mean"] for r in Q.trimmed_mean(df, ["g"], "v", t).collect()} for t in (0.0, 0.05, 0.25, 0.5, 1.0)}
    stats, outliers = Q.boxplot_stats(df, ["g"], "v")
    box = {r["g"]: r for r in stats.collect()}
    out = outliers.toPandas()
    for name, x in groups(pdf):
        k = int(np.floor(len(x) * 0.95))
        width = x[k:] - x[: len(x) - k]
        i = int(np.argmin(width))
        assert np.isclose(hdi[name]["upp"] - hdi[name]["low"], width[i])
        for t, got in trims.items():
            cut = int(len(x) * t)
            want = np.median(x) if t >= 0.5 else x[cut : len(x) - cut].mean()
            assert np.isclose(got[name], want)
        q1, q3 = np.quantile(x, [0.25, 0.75])
        ok = (x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))
        assert (box[name]["ymin"], box[name]["ymax"]) == (x[ok].min(), x[ok].max())
        assert box[name]["n_outliers"] == (~ok).sum() == (out.g.isna() if name is None else out.g == name).sum()


def test_range_ties_take_the_first_name(spark):
    df = spark.createDataFrame([("g", 1.0, "b"), ("g", 1.0, "a"), ("g", 3.0, "d"), ("g", 3.0, "c"), ("g", None, "e")], "g string, v double, k string")
    r = S.range_summary(df, ["g"], "v", "k").first()
    assert (r["which_min"], r["which_max"], r["med_size"]) == ("a", "c", 2.0)


def test_weighted_mean_skips_zero_spread(spark):
    df = spark.createDataFrame([("g", 1.0, 0.5), ("g", 3.0, 1.0), ("g", 99.0, 0.0)], "g string, x double, sd double")
    r = S.weighted_mean_var(df, ["g"], "x", S.inverse_variance(F.col("sd"))).first()
    assert np.isclose(r["wtd_mean"], (4 * 1 + 1 * 3) / 5)
    assert np.isclose(r["wtd_var"], (4 * 0.16 + 1 * 2.56) / 4)


def test_density_integrates_to_one(skewed):
    df, pdf = skewed
    got = density(df.where("g = 'cold'").where(F.abs("v") < 50), "v", ["g"], 400).orderBy("grid").toPandas()
    area = np.trapezoid(got.density, got.x)
    assert 0.9 < area < 1.01


def best_loss(points, tau):
    lines = [(p, q) for i, p in enumerate(points) for q in points[i + 1 :] if p[0] != q[0]]
    losses = []
    for (x1, y1), (x2, y2) in lines:
        b = (y2 - y1) / (x2 - x1)
        r = [y - y1 - b * (x - x1) for x, y in points]
        losses.append(sum((tau if e >= 0 else tau - 1) * e for e in r))
    return min(losses)


def test_quantile_line_is_optimal(spark):
    """Against all lines through two points: points on small grids, where many lines tie, and continuous ones."""
    rng = np.random.default_rng(8)
    groups = [[(3, 2), (2, 3), (2, 0), (1, 2), (0, 0), (0, 2)], [(1, 1), (1, 2)]]
    groups += [[tuple(p) for p in rng.integers(0, 4, (int(rng.integers(3, 12)), 2))] for _ in range(25)]
    groups += [[tuple(p) for p in rng.normal(size=(12, 2))] for _ in range(3)]
    rows = [(g, float(x), float(y)) for g, points in enumerate(groups) for x, y in points]
    taus = (0.025, 0.5, 0.9)
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {(r["g"], r["tau"]): r["loss"] for r in quantile_regression(df, "x", "y", taus, ["g"]).collect()}
    lined = {g: p for g, p in enumerate(groups) if len({x for x, _ in p}) > 1}
    assert got.keys() == {(g, t) for g in lined for t in taus}
    for (g, tau), loss in got.items():
        assert loss == pytest.approx(best_loss(lined[g], tau), abs=1e-9)


def test_short_groups_are_regressed_in_one_job(spark):
    """The jobs do not grow with the turns, and turning by jobs finds lines of the same loss, also for the null group."""
    rng = np.random.default_rng(31)
    rows = [(g, float(x), float(rng.normal(x, 40))) for g in ("a", "b", None) for x in rng.integers(0, 90, 120)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    sc = spark.sparkContext
    sc.setJobGroup("regression", "")
    got = {(r["g"], r["tau"]): r["loss"] for r in quantile_regression(df, "x", "y", (0.1, 0.5), ["g"]).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("regression"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12
    few = spark.createDataFrame([("a", float(i % 5), float(i * i % 11)) for i in range(12)] + [(None, 1.0, 2.0), (None, 3.0, 5.0)], "g string, x double, y double")
    by_jobs = {r["g"]: r["loss"] for r in quantile_regression(few, "x", "y", (0.1,), ["g"], short=8).collect()}
    assert by_jobs == {r["g"]: pytest.approx(r["loss"], abs=1e-9) for r in quantile_regression(few, "x", "y", (0.1,), ["g"]).collect()}
    assert by_jobs.keys() == {"a", None} and len(got) == 6
    assert quantile_regression(df.where("g = 'a'").drop("g"), "x", "y", (0.1,)).first()["loss"] == pytest.approx(got["a", 0.1], rel=1e-9)


@pytest.mark.parametrize("values", [[1e6 + i / 4000 for i in range(4000)], [10 ** (-i / 40) for i in range(4000)], [5.0] * 3000 + list(range(1000))])
def test_running_totals_stay_spread(spark, values):
    """Close values, values over many magnitudes and one heavy tie: right, and no part holds much more than its share."""
    df = spark.createDataFrame([(float(v), 1) for v in values], "v double, n int").groupBy("v").agg(F.sum("n").alias("n"))
    out = O.running(df, [], "v", [("before", "n", "sum")], [("total", "n")]).orderBy("v").collect()
    counts = [r["n"] for r in out]
    assert [r["before"] for r in out] == [sum(counts[:i]) for i in range(len(counts))]
    assert {r["total"] for r in out} == {len(values)}


def test_density_of_a_constant_group(spark):
    """The default bandwidth falls back on the size of the value."""
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    peak = density(df, "v", [], 3).collect()[0]["density"]
    assert peak == pytest.approx(1 / (0.9 * 5 * 2**-0.2 * np.sqrt(2 * np.pi)))


def test_range_summary_names_and_plan(spark):
    """Names of the extremes are found among equal rows only; nothing is sorted to aggregate."""
    rows = [("g", 1.0, "c"), ("g", 1.0, "b"), ("g", 9.0, "z"), ("g", 9.0, "y"), ("g", None, "a"), ("h", 2.0, None), (None, 3.0, "n")]
    got = S.range_summary(spark.createDataFrame(rows, "g string, v double, k string"), ["g"], "v", "k")
    assert {tuple(r) for r in got.collect()} == {("g", 1.0, "b", 9.0, "y", 5.0), ("h", 2.0, None, 2.0, None, 2.0), (None, 3.0, "n", 3.0, "n", 3.0)}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
