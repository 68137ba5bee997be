"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import registry
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE, _ = registry.load()
MAY_BE_EMPTY = {"connected_regions", "candidate_search"}


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, duck):
    res = compare(QUERIES[name](spark, SF), duck, ORACLE.get(name))
    assert res == "" or (res == "EMPTY" and name in MAY_BE_EMPTY)


def test_every_inventory_id_is_covered():
    ids = {f"{c}{i}" for c, n in zip("SPJAWTBM", (12, 32, 15, 30, 9, 7, 15, 6)) for i in range(1, n + 1)}
    have = {i for text in registry.load()[2].values() for i in text.split()}
    assert not ids - have


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_flagship_has_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:5] == ["model", "tp", "fp", "tn", "fn"] and df.count() == 3
