"""The subpackage's registered queries: those with SQL against it, the others by shape."""

import pytest
from compare import assert_same

from lateralis.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_per_document(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name.startswith("op13_"):
        assert df.count() == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count()
    elif name.startswith("op1_"):
        assert df.count() == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count() + 1
    else:
        assert df.count() == 200 and df.select("doc_id").distinct().count() == 200
