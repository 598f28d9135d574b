import pytest
from pyspark.sql import functions as F

from strataguild.operators import joins
from strataguild.operators.summaries import period_contrasts
from strataguild.plans import fossil, future, living
from strataguild.sources import files


def test_taxon_source_updates_and_filters(spark):
    species = spark.createDataFrame(
        [
            ("A a", "Old", "Fam", "browser", None, 5.0, 1.0, 2.0),
            ("A a", "Old", "Fam", "browser", None, 5.0, 1.0, 2.0),
            ("A a", "Old", "Fam", "browser", None, 5.0, 1.0, 4.0),
            ("B b", "Keep", "Fam", None, "aquatic", 5.0, 1.0, 2.0),
            ("C c", "Keep", "Fam", "carnivore", None, 5.0, 1.0, 3.0),
            ("D d", "Keep", "Fam", "carnivore", None, 5.0, 1.0, 3.0),
            ("E e", "Keep", "Fam", "omni", None, None, 1.0, 3.0),
        ],
        "genus_species string, `order` string, family string, pbdb_diet string, pbdb_life_habit string, fad double, lad double, lnmass_g double",
    )
    taxonomy = spark.createDataFrame(
        [
            ("A a", "A new", "species", None, None, "New", "NO_FAMILY_SPECIFIED"),
            ("C c", None, "genus", None, None, "NO_ORDER_SPECIFIED", None),
            ("D d", None, None, "insectivore", None, "NO_ORDER_SPECIFIED", None),
        ],
        "taxon_name string, accepted_name string, accepted_rank string, diet string, life_habit string, `order` string, family string",
    )
    got = {r["name"]: r for r in fossil.clean_taxon_source(species, taxonomy).collect()}
    assert set(got) == {"A new", "D d"}
    # The mean is over distinct masses: (2 + 4) / 2.
    assert (got["A new"]["order"], got["A new"]["value"], got["A new"]["guild"]) == ("New", 3.0, "herbivore")
    assert (got["D d"]["order"], got["D d"]["guild"]) == ("Keep", "invertivore")


def test_quaternary_source_habitat_quirk(spark):
    names = "genus string, species string, `order` string, continent string, status string, mass_status string, to_do string, trophic string, habitat_mode string, time_of_extinction string, logmass_g double, combined_mass_g string, last_occurance_kybp string"
    row = lambda sp, habitat, **kw: tuple(
        {**dict(genus="G", species=sp, order="O", continent="NA", status="extinct", mass_status="valid", to_do=None,
                trophic="browse", habitat_mode=habitat, time_of_extinction=None, logmass_g=2.0, combined_mass_g="100",
                last_occurance_kybp="12"), **kw}.values()
    )
    df = spark.createDataFrame(
        [row("a", "terrestrial"), row("b", "savanna"), row("c", "Aquatic"), row("d", "semiaquatic"), row("e", None),
         row("f", "plain", to_do="x"), row("g", "plain", logmass_g=0.0), row("h", "plain", status="historical", combined_mass_g="junk")],
        names,
    )
    got = {r["name"]: r for r in fossil.clean_quaternary_source(df).collect()}
    assert set(got) == {"G a", "G d", "G e", "G h"}
    assert got["G a"]["lad"] == 0.012 and got["G h"]["lad"] == 0.0 and got["G h"]["value"] is None
    assert got["G a"]["continent"] == "NA"


def test_contrasts_from_published_ranges(spark):
    """Ranges of carnivores and herbivores as published; contrasts follow by arithmetic."""
    rows = [
        ("carnivore", "Future", 3.84801767545223, 11.0508887355316, 8.03863532821678),
        ("carnivore", "Holocene", 3.84801767545223, 13.4870064909922, 8.2713000698317),
        ("carnivore", "Modern", 3.84801767545223, 11.9988270493687, 8.0864025829865),
        ("carnivore", "Pleistocene", 3.84801767545223, 13.4870064909922, 8.32644712790718),
        ("herbivore", "Modern", 1.36609165380237, 15.1866999807287, 5.52146091786225),
    ]
    df = spark.createDataFrame(rows, "guild string, bin string, min_size double, max_size double, med_size double")
    got = {r["guild"]: r for r in period_contrasts(df, ["guild"]).collect()}
    c = got["carnivore"]
    assert (c["minimum"], c["maximum"], c["med"]) == (3.84801767545223, 13.4870064909922, 8.32644712790718)
    assert (c["extant_med"], c["future_med"]) == (8.0864025829865, 8.03863532821678)
    assert (c["extant_max"], c["future_max"]) == (11.9988270493687, 11.0508887355316)
    assert c["avg"] == pytest.approx((3.84801767545223 + 13.4870064909922) / 2)
    assert got["herbivore"]["future_med"] is None


def test_amphibians_and_reptiles(spark):
    amph = spark.createDataFrame(
        [("s1", 1, None, None, None, None, 2.0), ("s2", 1, 0, 1, 1, 0, 2.0), ("Atylodes genei", None, None, None, None, None, 1.0),
         ("s3", None, None, None, 1, 1, 3.0), ("s4", None, None, None, None, None, 3.0), ("s5", 1, 1, 1, 0, 0, None)],
        "species string, flowers int, seeds int, fruits int, arthro int, vert int, body_mass_g double",
    )
    got = {r["binomial"]: r["guild"] for r in living.amphibians(amph).collect()}
    assert got == {"s1": "herbivore", "s2": "invertivore", "Atylodes genei": "invertivore", "s3": "omnivore"}
    cats = [*living.REPTILE_PLANT, *living.REPTILE_INV, *living.REPTILE_VERT]
    base = {c: 0 for c in cats}
    recs = [("r1", {**base, "cat_fruit": 1}), ("r2", {**base, "cat_fruit": 1, "cat_insect": 1}), ("r3", {**base, "cat_insect": None}),
            ("r4", {**base, "cat_plant": None, "cat_egg": 1}), ("r5", base)]
    rep = spark.createDataFrame(
        [("REPTILIA", n, 10.0, *[r[c] for c in cats]) for n, r in recs],
        "class string, sciname string, body_mass_value double, " + ", ".join(f"{c} int" for c in cats),
    )
    got = {r["binomial"]: r["guild"] for r in living.reptiles(rep).collect()}
    assert got == {"r1": "herbivore", "r2": "omnivore", "r3": None, "r4": "carnivore", "r5": None}


def test_older_codes(spark):
    mem = spark.createDataFrame([(f"s{i}", i, "Mammalia", float(i)) for i in range(12)], "binomial string, biome int, class string, log10_body_mass_median double")
    traits = spark.createDataFrame([(f"s{i}", "terrestrial", 3 if i % 2 else 4) for i in range(11)], "binomial string, realm string, diet_5cat int")
    got = {r["diet_abbr"]: r["n"] for r in living.older_group_means(mem, traits).collect()}
    assert got == {"C": 5, "O": 5}  # biome 0 has no name


def test_rates_table(spark):
    rows = [(g, b, c, 1.0, 9.0, m) for g, m0 in (("carnivore", 8.0), ("herbivore", 5.0)) for c in ("AF", "SA", "Insular")
            for b, m in (("Pleistocene", m0 + 0.3), ("Modern", m0), ("Future", m0 - 0.1))]
    df = spark.createDataFrame(rows, "guild string, bin string, continent string, min_size double, max_size double, med_size double")
    got = {(r["guild"], r["continent"], r["time"]): r for r in fossil.rates_of_change(df).collect()}
    assert len(got) == 8
    r = got["carnivore", "AF", "pleis"]
    assert r["diff"] == pytest.approx(-0.3) and r["length"] == 11500 and r["rate"] == pytest.approx(-0.3 / 11500)
    assert got["herbivore", "SA", "future"]["length"] == 500
    assert min(x["corr_rate"] for x in got.values()) == 0


def test_resampling_sensitivity_ranges(spark):
    rows = [("b", g, float((i * 37) % 11) + k) for k, g in enumerate(("h", "o")) for i in range(60)]
    df = spark.createDataFrame(rows, "bin string, guild string, value double")
    sub, boot = fossil.resampling_sensitivity(df, ["bin", "guild"], "value", (5, 30), 20, 20)
    got = sub.collect()
    assert len(got) == 4 and {r["sample"] for r in got} == {5, 30} and all(r["species"] == 60 for r in got)
    for r in [*got, *boot.collect()]:
        assert r["raw_low"] < r["raw_mean"] < r["raw_upp"] and r["wtd_low"] < r["wtd_mean"] < r["wtd_upp"]
        assert r["y0"] <= r["y5"] <= r["y25"] <= r["y50"] <= r["y75"] <= r["y95"] <= r["y100"]


def test_taxon_tests_keep_neighbours_adjusted_within_taxon(spark):
    rows = [("T", g, k + ((i * 53) % 97) / 10) for k, g in enumerate("abc") for i in range(60)]
    df = spark.createDataFrame(rows, "tax string, guild string, value double")
    medians = living.taxon_tests(df, ["a", "b", "c"]).collect()
    upper = living.taxon_percentile_tests(df, ["a", "b", "c"], r=300).collect()
    for got in (medians, upper):
        assert {(r["group_a"], r["group_b"]) for r in got} == {("a", "b"), ("b", "c")}
        assert all(r["p"] <= r["p_adj"] <= 3 * r["p"] + 1e-12 for r in got)


def test_percentile_test_without_partition(spark):
    from strataguild.operators.percentile_tests import pairwise_percentile_test

    df = spark.createDataFrame([(g, float(i * (k + 1))) for k, g in enumerate("ab") for i in range(80)], "g string, v double")
    r = pairwise_percentile_test(df, "v", "g", ["a", "b"], r=200).collect()
    assert len(r) == 1 and r[0]["p"] < 0.05 and r[0]["n_a"] == 80


def test_staged_trajectories_are_read_by_part(spark, tmp_path):
    """One statistic reads its own folders only; a table without its commit marker is refused."""
    pool = spark.createDataFrame([(i, "g", float(i)) for i in range(30)], "name int, guild string, value double")
    dead = spark.createDataFrame([(r, i, 1 + (i + r) % 4) for r in (1, 2) for i in range(25)], "run int, name int, death_year int")
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    future.stage_trajectories(pool, dead, runs, {"median": 0.5, "q90": 0.9}, 6, str(tmp_path / "t"))
    table = files.read_stage(spark, str(tmp_path / "t" / "trajectory"), statistic="q90")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(statistic" in plan
    direct = future.trajectory_summary(future.trajectory(pool, dead, runs, 0.9, 6), future.year_zero(pool, 0.9))
    want = sorted(tuple(r) for r in future.trajectory_change(direct, future.year_zero(pool, 0.9)).collect())
    assert sorted(tuple(r) for r in future.staged_change(spark, str(tmp_path / "t"), "q90").collect()) == want
    (tmp_path / "t" / "start" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        future.staged_change(spark, str(tmp_path / "t"), "q90")


def test_alive_by_year_is_the_count_of_survivors(spark):
    pool = [(i, "gh"[i % 2], float(i)) for i in range(12)]
    dead = [(1, i, 1 + i % 5) for i in range(12)] + [(2, 3, 2), (2, 3, 4), (2, 99, 1)]
    got = joins.alive_by_year(
        spark.createDataFrame(pool, "name int, guild string, value double"),
        spark.createDataFrame(dead, "run int, name int, death_year int"),
        spark.createDataFrame([(1,), (2,), (3,)], "run int"), 7,
    ).collect()
    want = {}
    for run in (1, 2, 3):
        for year in range(8):
            for name, guild, value in pool:
                if not any(d[0] == run and d[1] == name and d[2] <= year for d in dead):
                    want.setdefault((run, guild, year), []).append(value)
    assert {(r["run"], r["guild"], r["year"]): (r["n"], r["mean"]) for r in got} == {k: (len(v), sum(v) / len(v)) for k, v in want.items()}
