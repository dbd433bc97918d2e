"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from compare import assert_same

from lateralis.plans import events, inference, phylogeny, relational  # noqa: F401
from lateralis.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["a", "b", "jaccard"]
    assert set(e.oracle_sql()) <= set(e.queries())
