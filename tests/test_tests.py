import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataguild.operators import percentile_tests as PT
from strataguild.operators import rank_tests as RT
from strataguild.operators.reshape import add_count_row


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    rows = []
    for part, n in (("p", 160), ("q", 300)):
        for g in "abcd":
            if (part, g) == ("q", "b"):
                continue
            rows += [(part, g, float(np.round(rng.normal("abcd".index(g) * 0.2, 1), 1))) for _ in range(n)]
    pdf = pd.DataFrame(rows, columns=["part", "g", "v"])
    pdf["id"] = np.arange(len(pdf))
    return spark.createDataFrame(pdf).repartition(3).cache(), pdf


def test_rank_sum_matches_definition(sample):
    df, pdf = sample
    got = RT.pairwise_rank_sum(df, "v", "g", list("abcd"), ["part"], "all").toPandas()
    assert len(got) == 6 + 3
    for r in got.itertuples():
        a = pdf[(pdf.part == r.part) & (pdf.g == r.group_a)].v.to_numpy()
        b = pdf[(pdf.part == r.part) & (pdf.g == r.group_b)].v.to_numpy()
        assert r.stat == brute_u(a, b) and r.stat + brute_u(b, a) == len(a) * len(b)
        n = len(a) + len(b)
        t = np.unique(np.concatenate([a, b]), return_counts=True)[1].astype(float)
        sd = math.sqrt(len(a) * len(b) / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
        c = r.stat - len(a) * len(b) / 2
        assert math.isclose(r.p, math.erfc(abs((c - np.sign(c) * 0.5) / sd) / math.sqrt(2)), rel_tol=1e-7)


def test_neighbours_skip_missing_levels(sample):
    df, _ = sample
    got = RT.pairwise_rank_sum(df, "v", "g", list("abcd"), ["part"], "adjacent").collect()
    pairs = {(r["part"], r["group_a"], r["group_b"]) for r in got}
    assert pairs == {("p", "a", "b"), ("p", "b", "c"), ("p", "c", "d"), ("q", "a", "c"), ("q", "c", "d")}


def plain_law(m, n):
    """Counts of U over all ways to place m values among m + n, by sums of ranks."""
    ways = [[0] * (m * (m + n) + 1) for _ in range(m + 1)]
    ways[0][0] = 1
    for rank in range(1, m + n + 1):
        for k in range(min(rank, m), 0, -1):
            for s in range(len(ways[k]) - 1, rank - 1, -1):
                ways[k][s] += ways[k - 1][s - rank]
    low = m * (m + 1) // 2
    return [x / math.comb(m + n, m) for x in ways[m][low : low + m * n + 1]]


def test_rank_sum_laws_of_all_sizes(spark):
    sizes = [(1, 1), (1, 7), (7, 1), (3, 5), (5, 3), (12, 9), (30, 17), (49, 49)]
    df = spark.createDataFrame(sizes, "n_a bigint, n_b bigint")
    got = {(r["n_a"], r["n_b"]): r["_law"] for r in RT.rank_sum_laws(df.union(df)).collect()}
    assert set(got) == set(sizes)
    for (m, n), law in got.items():
        assert len(law) == m * n + 1 and np.allclose(law, plain_law(m, n), rtol=1e-10, atol=0)


def test_holm_of_very_many_equal_values(spark):
    """A million tests of one p in one family, beside a few others: counts are stepped down, not rows."""
    same = spark.range(1_000_000).select(F.lit("a").alias("f"), F.lit(1.0).alias("p"))
    few = spark.createDataFrame([("a", 0.001), ("a", 0.001), ("a", 0.5), ("b", 0.01), ("b", None)], "f string, p double")
    got = RT.p_adjust(same.unionByName(few), family=["f"]).groupBy("f", "p", "p_adj").count().collect()
    assert {(r["f"], r["p"], r["p_adj"], r["count"]) for r in got} == {
        ("a", 1.0, 1.0, 1_000_000), ("a", 0.001, 1.0, 2), ("a", 0.5, 1.0, 1), ("b", 0.01, 0.01, 1), ("b", None, None, 1),
    }


def test_holm_by_range_parts_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(str(i % 3), float(np.round(x, 2))) for i, x in enumerate(rng.random(300) ** 3)]
    df = spark.createDataFrame(rows, "f string, p double")
    direct = sorted(tuple(r) for r in RT.p_adjust(df, family=["f"]).collect())
    monkeypatch.setattr(RT, "SHORT", 0)
    assert sorted(tuple(r) for r in RT.p_adjust(df, family=["f"]).collect()) == direct
    for f in "012":
        own = sorted(p for g, p in rows if g == f)
        step, want = 0.0, []
        for i, p in enumerate(own):
            step = max(step, (len(own) - i) * p)
            want.append(min(1.0, step))
        assert np.allclose(sorted(a for g, _, a in direct if g == f), want)


def test_exact_law_for_small_untied_samples(spark):
    a, b = [1.1, 2.3, 5.7, 8.1], [0.4, 3.3, 3.9, 6.6, 9.9]
    df = spark.createDataFrame([("x", v) for v in a] + [("y", v) for v in b], "g string, v double")
    got = RT.pairwise_rank_sum(df, "v", "g", ["x", "y"]).first()
    pool = sorted(a + b)
    law = [brute_u(c, [v for v in pool if v not in c]) for c in combinations(pool, 4)]
    u = brute_u(a, b)
    low, high = np.mean([x <= u for x in law]), np.mean([x >= u for x in law])
    assert math.isclose(got["p"], min(1, 2 * min(low, high)), rel_tol=1e-12)
    tied = spark.createDataFrame([("x", v) for v in a] + [("y", v) for v in [*b, 1.1]], "g string, v double")
    assert RT.pairwise_rank_sum(tied, "v", "g", ["x", "y"]).first()["p"] != got["p"]


def test_holm_is_monotone_and_ignores_nulls(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, None, 0.04]
    df = spark.createDataFrame(list(enumerate(ps)), "k int, p double")
    got = {r["k"]: r["p_adj"] for r in RT.p_adjust(df).collect()}
    order = sorted((p, k) for k, p in enumerate(ps) if p is not None)
    top = 0.0
    for i, (p, k) in enumerate(order):
        top = max(top, (len(order) - i) * p)
        assert math.isclose(got[k], min(1.0, top))
        assert got[k] >= p
    assert got[5] is None


def test_holm_on_published_permutation_counts(spark):
    """Raw counts out of 100,000 in a family of 364 give the published adjusted values."""
    counts = [0, 13, 41, 55, 74, 75, 88, 126, 150, 169, 215, 221] + [50000] * 352
    df = spark.createDataFrame([(i, c / 100000) for i, c in enumerate(counts)], "k int, p double")
    got = sorted(r["p_adj"] for r in RT.p_adjust(df).collect())
    want = [0.0] + [c / 100000 * (363 - i) for i, c in enumerate(counts[1:12])]
    assert np.allclose(got[:12], np.minimum(1, np.maximum.accumulate(want)))
    # Three of the published adjusted values.
    assert all(any(math.isclose(g, w, rel_tol=1e-9) for g in got) for w in (0.04719, 0.14842, 0.534))


def test_count_row(spark):
    df = spark.createDataFrame([("a", 0.01, 0.5), ("b", 0.2, 0.04), ("c", 0.04, None)], "k string, x double, y double")
    last = [r for r in add_count_row(df, "k", ["x", "y"]).collect() if r["k"] == "# Significant"][0]
    assert (last["x"], last["y"]) == (2.0, 1.0)


@pytest.mark.parametrize("na,nb,tau", [(6, 5, 0.7), (2, 7, 0.9), (1, 4, 0.5)])
@pytest.mark.parametrize("draws", ["walk", "beta"])
def test_position_sampler_matches_full_enumeration(spark, draws, na, nb, tau):
    """Joint law of the four pooled ranks, against every way to deal a few rows."""
    reps = 40000
    if draws == "walk":
        flat = np.concatenate([PT.walked_ranks(tau, s, na, nb, 1, 10000) for s in range(4)])
    else:
        df = spark.createDataFrame([(s, na, nb, 10000) for s in range(4)], "s bigint, a bigint, b bigint, r bigint")
        flat = np.concatenate([np.array(r[0]) for r in df.select(PT.position_sampler(tau)("s", "a", "b", "r")).collect()])
    drawn = [tuple(x) for x in flat.reshape(-1, 4)]
    assert len(drawn) == reps

    def edges(n):
        k = int(np.floor((n - 1) * tau))
        return k, min(k + 1, n - 1)

    law: dict = {}
    for chosen in combinations(range(1, na + nb + 1), na):
        other = [i for i in range(1, na + nb + 1) if i not in chosen]
        key = tuple([chosen[i] for i in edges(na)] + [other[i] for i in edges(nb)])
        law[key] = law.get(key, 0) + 1
    total = math.comb(na + nb, na)
    seen = pd.Series(drawn).value_counts()
    assert set(seen.index) <= set(law)
    chi2 = sum((seen.get(k, 0) - reps * c / total) ** 2 / (reps * c / total) for k, c in law.items())
    dof = len(law) - 1
    assert chi2 < dof + 4 * math.sqrt(2 * dof)


def test_walk_of_large_groups_starts_and_ends_right():
    """Sizes far beyond a listing: ranks are in order and centred on the percentile."""
    n = 3_000_000
    ranks = PT.walked_ranks(0.9, 5, n, n, 1, 400)
    assert (ranks[:, 0] < ranks[:, 1]).all() and (ranks[:, 2] < ranks[:, 3]).all() and (ranks > 0).all()
    # The standard deviation of a group's percentile among the pooled positions.
    sd = math.sqrt(0.9 * 0.1 * 2 * n)
    assert abs(ranks[:, 0].mean() - 1.8 * n) < 5 * sd / 20 and 0.8 < ranks[:, 0].std() / sd < 1.2


@pytest.mark.parametrize("draws", ["walk", "beta"])
def test_permutation_modes_agree(sample, draws):
    df, pdf = sample
    drawn = PT.pairwise_percentile_test(df, "v", "g", list("abcd"), ["part"], 0.9, 3000, 1, "adjacent", draws).toPandas()
    dealt = PT.pairwise_percentile_test_dealt(df, "v", "g", list("abcd"), "id", ["part"], 0.9, 150, "adjacent").toPandas()
    both = drawn.merge(dealt, on=["part", "group_a", "group_b"], suffixes=("", "_d"))
    assert len(both) == 5 and (both.r if "r" in both else True) is not None
    assert np.allclose(both["diff"], both["diff_d"])
    assert (both.p - both.p_d).abs().max() < 0.16
    for r in drawn.itertuples():
        a = pdf[(pdf.part == r.part) & (pdf.g == r.group_a)].v.to_numpy()
        b = pdf[(pdf.part == r.part) & (pdf.g == r.group_b)].v.to_numpy()
        assert math.isclose(r.diff, np.quantile(a, 0.9) - np.quantile(b, 0.9), abs_tol=1e-12)
        rng, pool, hits = np.random.default_rng(2), np.concatenate([a, b]), 0
        for _ in range(2000):
            x = rng.permutation(pool)
            hits += round(abs(np.quantile(x[: len(a)], 0.9) - np.quantile(x[len(a) :], 0.9)), 9) >= round(abs(r.diff), 9)
        assert abs(r.p - hits / 2000) < 0.05


def test_drawn_p_does_not_depend_on_partitioning(sample):
    df, _ = sample
    runs = [
        PT.pairwise_percentile_test(d, "v", "g", list("abcd"), ["part"], 0.9, 400, 9, "adjacent").toPandas()
        for d in (df, df.repartition(7, "id"))
    ]
    a, b = (r.sort_values(["part", "group_a"]).reset_index(drop=True) for r in runs)
    assert a.equals(b)


def test_percentile_test_ranks_only_values_near_the_percentile(spark, monkeypatch):
    rng = np.random.default_rng(12)
    shift = {"a": 0.0, "b": 0.1, "c": 3.0, "d": 0.0}
    rows = [(None if i % 2 else "p", g, i, float(x)) for g, s in shift.items() for i, x in enumerate(rng.normal(s, 1, 5000))]
    df = spark.createDataFrame(rows, "part string, g string, id long, v double")
    ranked = []

    def counted(rows, *args, **kwargs):
        ranked.append(rows.count())
        return ranks(rows, *args, **kwargs)

    ranks = PT.running
    for module in (PT, RT):
        monkeypatch.setattr(module, "running", counted, raising=False)
    got = PT.pairwise_percentile_test(df, "v", "g", list("abcd"), ["part"], 0.9, 500, 3).toPandas()
    assert len(got) == 12 and set(got["n_a"]) == {2500}
    # 20,000 different values, of which only those near a wanted rank are put in order.
    assert ranked and max(ranked) < 5000
    data = pd.DataFrame(rows, columns=["part", "g", "id", "v"]).fillna({"part": "none"})
    q = data.groupby(["part", "g"])["v"].quantile(0.9)
    for r in got.fillna({"part": "none"}).itertuples():
        assert r.diff == pytest.approx(q[r.part, r.group_a] - q[r.part, r.group_b], abs=1e-12)
        assert r.hits == 0 or "c" not in (r.group_a, r.group_b)


def test_dealt_rows_are_not_kept(spark, monkeypatch):
    """Repeated and missing row ids, and ties; what is kept of the dealt rows is a small share of them."""
    from strataguild.operators import order_stats

    rng = np.random.default_rng(3)
    n, r = 300, 6
    pdf = pd.DataFrame({"g": rng.choice(["x", "y"], n), "v": np.round(rng.normal(0, 1, n), 2), "id": rng.integers(0, 250, n)})
    rows = [(g, float(v), None if i % 50 == 0 else int(i)) for g, v, i in pdf.itertuples(index=False)]
    kept, plain = [], order_stats.settle
    monkeypatch.setattr(order_stats, "settle", lambda df: (out := plain(df), kept.append(out.count()))[0])
    df = spark.createDataFrame(rows, "g string, v double, id bigint")
    got = PT.pairwise_percentile_test_dealt(df, "v", "g", ["x", "y"], "id", r=r, tau=0.9).first()
    assert 0 < max(kept) < n * r / 2
    keys = df.select("v", "g", *[F.coalesce(PT.permutation_key(F.col("id"), F.lit(k)), F.lit(-1)).alias(f"k{k}") for k in range(1, r + 1)]).toPandas()
    q = lambda a: np.quantile(a, 0.9)
    n_a, diff = (keys.g == "x").sum(), q(keys.v[keys.g == "x"]) - q(keys.v[keys.g == "y"])
    hits = 0
    for k in range(1, r + 1):
        v = keys.sort_values([f"k{k}", "v"]).v.to_numpy()
        hits += round(abs(q(v[:n_a]) - q(v[n_a:])), 9) >= round(abs(diff), 9)
    assert (got["n_a"], got["hits"], got["p"]) == (n_a, hits, hits / r) and math.isclose(got["diff"], diff)


def test_rank_sums_add_up_over_parts(spark, monkeypatch):
    """Many parts, cut batches, ties over levels and the null group; the counts per value are not kept and not paired."""
    from strataguild.operators import order_stats

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"p": rng.choice(["a", "b", None], 3000, p=[0.8, 0.1, 0.1]), "g": rng.choice(list("xyz"), 3000), "v": np.round(rng.normal(0, 1, 3000), 3)})
    kept = []
    monkeypatch.setattr(order_stats, "settle", lambda df: kept.append(df) or df)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "p string, g string, v double")
    sums = RT._pair_sums(df, "v", "g", list("xyz"), ["p"], "all").collect()
    assert not kept and len(sums) == 9
    for r in sums:
        own = pdf[pdf.p.isna()] if r["p"] is None else pdf[pdf.p == r["p"]]
        a, b = (own.v[own.g == "xyz"[i]].to_numpy() for i in (r["ia"], r["ib"]))
        t = np.unique(np.concatenate([a, b]), return_counts=True)[1].astype(float)
        assert (r["n_a"], r["n_b"], r["stat"], r["_ties"]) == (len(a), len(b), brute_u(a, b), (t**3 - t).sum())
    run = RT._part_sums(["p"], ["p"], [RT.pa.string()], 3)
    monkeypatch.setattr(RT, "TaskContext", type("T", (), {"get": lambda: type("P", (), {"partitionId": lambda s: 0})()}))
    hist = pdf[pdf.p == "a"].groupby(["p", "v", "g"]).size().reset_index(name="_c").rename(columns={"v": "_v"})
    hist["_lv"], hist["_c"] = hist.g.map("xyz".index).astype("int32"), hist._c.astype(float)
    batches = RT.pa.RecordBatch.from_pandas(hist[["p", "_v", "_lv", "_c"]], preserve_index=False)
    whole = list(run(iter([batches])))
    cut = list(run(batches.slice(i, 7) for i in range(0, len(hist), 7)))
    assert len(whole) == len(cut) == 1 and whole[0].equals(cut[0])
