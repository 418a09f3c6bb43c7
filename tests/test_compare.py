"""Comparing tables: planted losses, changes, extra rows and copies, and how much is read to find them."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.compare import compare


def planted(spark, tmp_path, n, name=str):
    base = spark.range(n).select(F.format_string("k%07d", "id").alias("key") if name is str else F.col("id").alias("key"), (F.col("id") % 97).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("b"))
    return base


def found(c, key="key"):
    return sorted((str(r[key]), r["kind"]) for r in c.differences.collect())


@pytest.mark.parametrize("kind", [str, int])
def test_planted_differences_are_found_exactly(spark, tmp_path, kind):
    left = planted(spark, tmp_path, 40_000, kind)
    r = random.Random(1)
    lost, changed, nulled, twice = (r.sample(range(i * 10_000, i * 10_000 + 900), 3) for i in range(4))
    name = (lambda i: f"k{i:07d}") if kind is str else (lambda i: i)
    of = lambda ids: F.col("key").isin([name(i) for i in ids])
    right = left.where(~of(lost)).withColumns({"a": F.when(of(changed), -1).otherwise(F.col("a")), "b": F.when(~of(nulled), F.col("b"))})
    extra = [name(50_000), name(50_001)]
    right = right.unionByName(right.where(of(twice))).unionByName(spark.createDataFrame([(x, 1, "new") for x in extra], left.schema))
    for t, at in ((left, "l"), (right, "r")):
        t.repartitionByRange(4, "key").sortWithinPartitions("key").write.parquet(str(tmp_path / at))
    a, b = spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r"))
    really = [i for i in nulled if i % 5]  # the others were null before
    want = [(x, "left") for x in map(name, lost)] + [(name(i), "differs") for i in (*changed, *really, *twice)] + [(x, "right") for x in extra]
    c = compare(a, b, "key", small=300)
    assert found(c) == sorted((str(x), k) for x, k in want)
    assert c.rows_read[0] == 40_000 and sum(c.rows_read[1:]) < 12_000 and c.rows_read[-1] < 4000
    print("rows read:", c.rows_read)


def test_equal_tables_are_read_once(spark):
    t = planted(spark, None, 3000)
    c = compare(t, t.repartition(7), "key")
    assert found(c) == [] and c.rows_read == [3000, 0]


def test_everything_differs(spark):
    t = planted(spark, None, 3000)
    c = compare(t, t.withColumn("a", F.col("a") + 1), "key", small=10)
    assert len(found(c)) == 3000 and {k for _, k in found(c)} == {"differs"} and len(c.rows_read) == 2


def test_null_and_repeated_keys_and_one_key(spark):
    rows = [(None, 1), (None, 2), ("x", 1), ("x", 1), ("y", None)]
    make = lambda rows: spark.createDataFrame(rows, "key string, v int")
    assert found(compare(make(rows), make(rows[::-1]), "key")) == []
    assert found(compare(make(rows), make([(None, 1), (None, 3), *rows[2:]]), "key")) == [("None", "differs")]
    assert found(compare(make(rows), make([*rows[:3], ("y", 0)]), "key")) == [("x", "differs"), ("y", "differs")]
    assert found(compare(make([("x", i) for i in range(50)]), make([("x", i) for i in range(1, 50)]), "key", small=5)) == [("x", "differs")]
    assert found(compare(make([]), make([("x", 1)]), "key")) == [("x", "right")] and found(compare(make([]), make([]), "key")) == []
    with pytest.raises(ValueError):
        compare(make(rows), make(rows).withColumnRenamed("v", "w"), "key")
