"""Keyed tables: changes against plain dictionaries, what is rewritten and read, changes at the same time, null keys."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.keyed import KeyedTable, StaleTable, bucketed

SCHEMA = T.StructType([T.StructField("tenant", T.StringType()), T.StructField("file", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("n", T.IntegerType())])
KEYS = ["tenant", "file"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(table):
    return {(r["tenant"], r["file"]): (r["sha"], r["n"]) for r in table.read().collect()}


def files(table):
    return {b: sorted(os.listdir(f"{table.path}/{f}")) for b, f in table.folders.items()}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(random.Random(i).choice("tttuv"), i, f"s{i % 50}", i) for i in range(2000)]
    return KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, KEYS, ["tenant"], buckets=16, spread=4, blooms=("sha",)).put(frame(spark, rows))


def test_changes_against_a_dictionary(spark, tmp_path):
    r = random.Random(3)
    table, want = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, KEYS, ["tenant"], buckets=8), {}
    assert table.read().count() == 0
    for step in range(8):
        rows = [(r.choice("tu"), r.randrange(30), r.choice(("a", "b", None)), r.choice((1, 2, None))) for _ in range(r.randint(0, 25))]
        kind = ("put", "update", "insert_absent", "delete")[step % 4]
        least = lambda x: tuple((v is not None, v) for v in x)
        best = {}
        for x in sorted(rows, key=least):
            best[x[:2]] = x[2:]
        if kind == "delete":
            table = table.delete(frame(spark, rows))
            for k in best:
                want.pop(k, None)
        else:
            if kind == "update":
                rows = [(*k, *v) for k, v in best.items()]
            table = getattr(table, kind)(frame(spark, rows))
            for k, v in best.items():
                if kind == "update":
                    v = tuple(b if b is not None else a for a, b in zip(want.get(k, (None, None)), v, strict=True))
                if kind != "insert_absent" or k not in want:
                    want[k] = v
        assert held(table) == want and held(KeyedTable(spark, table.path)) == want


def test_only_touched_buckets_are_rewritten(spark, table):
    five = min(table.folders)
    one = table.read().select("*", table.bucket().alias("b")).where(F.col("b") == int(five))
    some = one.limit(5).drop("b").withColumn("n", F.lit(-1))
    before, folders = files(table), dict(table.folders)
    after = table.put(some)
    assert {b for b in folders if after.folders[b] != folders[b]} == {five}
    assert {b: f for b, f in files(after).items() if b != five} == {b: f for b, f in before.items() if b != five}
    assert after.read().where("n = -1").count() == 5 and after.read().count() == 2000


def test_readers_see_one_version(spark, table):
    old = table.read()
    new = table.put(frame(spark, [("t", i, "new", 0) for i in range(5000, 5100)]))
    gone = new.delete(new.read().where("file < 1000"))
    assert old.count() == 2000 and new.read().count() == 2100 and gone.read().where("file < 1000").count() == 0
    assert KeyedTable(spark, table.path).version == gone.version == 3


def test_a_stale_change_is_refused(spark, table):
    other = KeyedTable(spark, table.path).put(frame(spark, [("t", 1, "theirs", 1)]))
    folders = sorted(os.listdir(f"{table.path}/data"))
    with pytest.raises(StaleTable):
        table.put(frame(spark, [("u", 2, "mine", 2)]))
    assert held(KeyedTable(spark, table.path)) == held(other) and sorted(os.listdir(f"{table.path}/data")) == folders
    assert held(table.refresh().put(frame(spark, [("u", 2, "mine", 2)])))[("u", 2)] == ("mine", 2)


def test_clean(spark, table):
    for i in range(3):
        table = table.put(frame(spark, [("t", i, "new", i)]))
    want = held(table)
    table.clean()
    assert held(KeyedTable(spark, table.path)) == want and len(os.listdir(f"{table.path}/manifests")) <= 2
    left = {f"data/{c}/{b}" for c in os.listdir(f"{table.path}/data") for b in os.listdir(f"{table.path}/data/{c}") if not b.startswith(".")}
    assert left == set(table.folders.values())


def test_rows_without_a_key_are_refused(spark, table):
    for row in ((None, 1, "x", 1), ("t", None, "x", 1)):
        with pytest.raises(Exception, match="a row without"):
            table.put(frame(spark, [row]))
    assert KeyedTable(spark, table.path).version == 1
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark, table.path, SCHEMA, KEYS)
    with pytest.raises(ValueError):
        table.get(tenant="t")


def rows_read(df):
    """What the scan of an executed plan put out, before the filter."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_lookups_read_their_buckets_alone(spark, table):
    want = held(table)
    assert [tuple(r) for r in table.get(tenant=next(t for t, f in want if f == 7), file=7).collect()] == [(next(t for t, f in want if f == 7), 7, "s7", 7)]
    assert rows_read(table.get(tenant="t", file=7)) < 400 and table.get(tenant="none", file=7).count() == 0
    part = table.of_partition(tenant="u")
    assert {(r["tenant"], r["file"]) for r in part.collect()} == {k for k in want if k[0] == "u"}
    assert rows_read(part) < 1400 and len({table.folders[b] for b in table.folders}) == len(table.folders)


def test_sorted_rows_and_blooms_spare_row_groups(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, KEYS, buckets=1, blooms=("sha",))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.row.count.limit", "500")
    try:
        table = table.put(spark.range(10_000).select(F.lit("t").alias("tenant"), F.col("id").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("sha"), F.lit(1).alias("n")))
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.row.count.limit")
    assert rows_read(table.get(tenant="t", file=4321)) <= 500
    sha = table.read().where("file = 77").first()["sha"]
    assert rows_read(table.read().where(F.col("sha") == sha)) <= 500 and rows_read(table.read()) == 10_000


def test_bucketed_tables_join_without_an_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = bucketed(spark.range(1000).select("id", F.lit("a").alias("x")), "keyed_a", ["id"], 4)
        b = bucketed(spark.range(500, 1500).select("id", F.lit("b").alias("y")), "keyed_b", ["id"], 4)
        both = a.join(b, "id")
        assert both.count() == 500 and "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS keyed_a")
        spark.sql("DROP TABLE IF EXISTS keyed_b")
