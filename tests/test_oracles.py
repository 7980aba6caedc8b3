"""Every registered query that has SQL gives the rows of that SQL; the others give rows with a stable schema."""

import os

import pytest

from storyloom.plans.catalogue import ORACLES, QUERIES
from tests.oracle import difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert difference(spark, SF_DIR, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    a, b = QUERIES[name](spark, SF_DIR), QUERIES[name](spark, SF_DIR)
    assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
