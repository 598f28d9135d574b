"""A share of the registered queries against their SQL twins; check_twins.py runs all."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_twins import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "guild_tests_by_region", "five_number", "merge_sources", "classify_regex", "interval_overlap_cells",
    "among_region_rank", "bootstrap", "trajectory_median", "csv_clean", "compile_species", "hdi",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    got = normal(entry.queries()[name](spark, FOLDER).toPandas())
    want = normal(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.shape == want.shape
    assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
