import os

import pytest

from millrace.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF_DIR, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, SF_DIR), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_every_document_is_there(spark, name):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = QUERIES[name](spark, SF_DIR)
    assert got.select("doc_id").distinct().count() == docs.count()
