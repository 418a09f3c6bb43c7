import os

import pytest

from millrace.plans.queries import QUERIES, SQL
from tests.oracle import SF_DIR, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, SF_DIR), SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_embedded_chunks(spark):
    """Each chunk's vector against the stand-in model written plainly, over the chunks of the other engine."""
    import zlib

    import duckdb
    import numpy as np

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_DIR}/documents.parquet')")
    texts = {(d, i): t for d, i, t in con.sql(f"SELECT doc_id, chunk_index, text FROM ({SQL['chunks']})").fetchall()}
    got = {(r["doc_id"], r["chunk_index"]): r["embedding"] for r in QUERIES["embedded_chunks"](spark, SF_DIR).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        votes = [0] * 1024
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            votes[h % 1024] += 1 if h >= 2**31 else -1
        assert np.allclose(got[key], np.array(votes) / max(np.linalg.norm(votes), 1e-12), atol=1e-6)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= QUERIES.keys() and __spark_entry__.oracle_sql().keys() >= SQL.keys()
