from strataguild.plans.fish import fossil_fish_table
from strataguild.sources.dimensions import time_scale
from strataguild.sources.files import read_csv

FIRST = (
    "﻿Species,Name,Family,Habitat,Length (cm),Trophic Level,V_diet_cat,\r\n"
    "Grandis primus ,,Familia,NA,210,4.1,Higher carnivore,eats fish\r\n"
    'cf. Secundus,,Familia,NA,61.5,4.1,NA,"one thing, or another; open"\r\n'
    "Tertius sp.,,Altera,NA,,2.5,NA,\r\n"
    "Quartus albus,,Incerta i.s.,NA,33,2,Planktivore,"
)
SECOND = (
    "﻿Species,est_SL,est_ML,Diet,V_diet,\r\n"
    'Quintus,"12.5 cm, 140 cm",14.5 cm,,Benthic carnivore,or another?\r\n'
    "Sextus,,3.5 cm,,Planktivore,doubtful\r\n"
)


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_fossil_fish_table(spark, tmp_path):
    table = fossil_fish_table(spark, put(tmp_path, "a.csv", FIRST), put(tmp_path, "b.csv", SECOND))
    got = {r["species"]: r for r in table.collect()}
    assert len(got) == 6
    lav = got["Grandis primus"]
    assert (lav["length_cm"], lav["diet_cat"], lav["diet_rank"], lav["habitat"]) == (210.0, "Higher carnivore", 5, None)
    assert got["cf. Secundus"]["notes"] == "one thing, or another; open"
    assert got["cf. Secundus"]["diet_cat"] is None
    assert got["Tertius sp."]["length_cm"] is None and got["Tertius sp."]["ln_length"] is None
    assert got["Quintus"]["length_cm"] == 14.5 and got["Quintus"]["est_sl"] == "12.5 cm, 140 cm"
    assert got["Sextus"]["length_cm"] == 3.5 and got["Sextus"]["study"] == "Maisey 1994"
    assert got["Quartus albus"]["diet_rank"] == 2


def test_null_tokens_differ_by_source(spark, tmp_path):
    path = put(tmp_path, "c.csv", "name,continent,mass\na,NA,1\nb,,x\n")
    columns = [("name", "string"), ("continent", "string"), ("mass", "double")]
    keep = [tuple(r) for r in read_csv(spark, path, columns, na=("",)).collect()]
    drop = [tuple(r) for r in read_csv(spark, path, columns, na=("NA",)).collect()]
    assert keep == [("a", "NA", 1.0), ("b", None, None)]
    assert drop == [("a", None, 1.0), ("b", "", None)]


def test_time_scale(spark, tmp_path):
    text = (
        "interval_name\tage_bottom\tage_mid\tage_top\tperiod\n"
        "Holocene\t0.0117\t0.00585\t0\tQuaternary\nPleistocene\t2.588\t1.29985\t0.0117\tQuaternary\n"
        "Early Cretaceous\t145\t122.75\t100.5\tCretaceous\nLate Jurassic\t163.5\t154.25\t145\tJurassic\n"
    )
    got = time_scale(spark, put(tmp_path, "t.txt", text), 150).orderBy("bin_num").collect()
    assert [(r["interval"], r["bin_num"]) for r in got] == [("Early Cretaceous", 1), ("Pleistocene", 2), ("Holocene", 3)]
    assert got[1]["mid"] == 1.29985
