"""SQL functions against the Columns they are made of; the table function against the native chunker."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import sql
from millrace.operators import chunking


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark, "mr_")


def test_functions_are_the_columns(spark, names):
    r = random.Random(4)
    parts = ["Rev-B", " ", "\n", "\t", "AS 3600", "SWMS", "par-\ntial", "AS-\nNew", "'q'", "\\", "é😀", "SECTION 4", "{\"Error\": \"x\"}", "file_v2.pdf", "\r\n", "12"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12))), r.choice((None, "d", "e")), r.getrandbits(62), r.getrandbits(62)) for i in range(200)] + [(200, None, None, None, 0)]
    df = spark.createDataFrame(rows, "page int, t string, doc_id string, a long, b long").withColumn("chunk_index", F.col("page") % 7)
    df.createOrReplaceTempView("sql_rows")
    for name, (arguments, function) in sql.FUNCTIONS.items():
        want = df.select("page", function(*(F.col(n) for n in arguments)).alias("v")).collect()
        got = spark.sql(f"SELECT page, mr_{name}({', '.join(arguments)}) AS v FROM sql_rows").collect()
        assert sorted(got, key=str) == sorted(want, key=str), name


def test_chunked_is_the_native_chunker(spark, names):
    r = random.Random(5)
    marks = ["\nSECTION 2 of", "\n  Clause 4", "\n1.2.3 Title", "\n", " ", " ", "😀é", "word ", "longerword ", "x" * 30, "\nAPPENDIX", " 4"]
    text = lambda: r.choice((None, "", "".join(r.choice(marks) for _ in range(r.randint(1, 700)))))
    rows = [(d, n, text()) for d in range(30) for n in range(1, r.randint(2, 6))]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string").repartition(3)
    pages.createOrReplaceTempView("sql_pages")
    got = spark.sql("SELECT * FROM mr_chunked(TABLE(sql_pages))")
    want = chunking.chunk_documents(pages, ["doc_id"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 60


def test_chunked_takes_pages(spark, names):
    with pytest.raises(Exception, match="takes a table with doc_id"):
        spark.sql("SELECT * FROM mr_chunked(TABLE(SELECT 1 AS a))").collect()
