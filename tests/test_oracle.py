"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest
from harness import connect, differences

from tickframe.catalog import everything

CATALOG = everything()
pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("key", [k for k, q in CATALOG.items() if q.sql])
def test_matches_sql(spark, sf, duck, key):
    assert differences(CATALOG[key].run(spark, sf), duck, CATALOG[key].oracle()) == []


@pytest.mark.parametrize("key", [k for k, q in CATALOG.items() if not q.sql])
def test_model_queries_return_rows(spark, sf, key):
    assert CATALOG[key].run(spark, sf).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == list(CATALOG[entry.FLAGSHIP].columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
