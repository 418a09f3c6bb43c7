"""Streams of several batches: jobs once each, failed files again, restarts; duplicate rules as files arrive."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import duplicates
from millrace.streaming import duplicates as stream_duplicates
from millrace.streaming.dispatch import jobs, notices, statuses
from millrace.streaming.ingest import ingest

SCHEMA = "key string, at long, file_id string, status string"


def run(spark, tmp, batches, **options):
    """Jobs of batches of notices (key, at) and statuses (file_id, at, status); each batch is a run of its own."""
    for i, batch in enumerate(batches):
        rows = [(x[0], x[1], None, None) if len(x) == 2 else (None, x[1], x[0], x[2]) for x in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp / "in" / f"b{i}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp / "in"))
        changes = stream.withColumns({"tenant_id": F.lit("t"), "dataset_id": F.lit("d")})
        events = notices(stream, F.col("at")).unionByName(statuses(changes, F.col("at"), F.col("status")))
        ingest(jobs(events, **options), str(tmp / "out"), str(tmp / "cp")).awaitTermination()
    return spark.read.parquet(str(tmp / "out"))


def test_a_file_noticed_in_two_batches_has_one_job(spark, tmp_path):
    five = [(f"raw/t/d/{i}/a.pdf", 1) for i in range(5)]
    for name in ("x", "y"):
        spark.createDataFrame(five, "key string, at long").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema("key string, at long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    ingest(jobs(notices(stream, F.col("at"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out"))
    assert made.count() == made.select("job_id").distinct().count() == 5


def test_failed_files_run_again_and_done_ones_do_not(spark, tmp_path):
    a, b = "raw/t/d/a/x.pdf", "raw/t/d/b/x.pdf"
    batches = [[(a, 1), (a, 2), (b, 1), ("raw/short", 1), (None, 1)], [("a", 5, "FAILED"), ("b", 5, "COMPLETE"), (b, 6)], [(a, 7), (a, 7), (b, 7)], [(a, 9), ("a", 9, "FAILED"), (a, 8)]]
    made = sorted((r["file_id"], r["attempt"]) for r in run(spark, tmp_path, batches).collect())
    # in the last batch the notice of 8 finds the file in work; the failure of 9 comes before the notice of 9
    assert made == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_only_registered_files(spark, tmp_path):
    batches = [[("raw/t/d/a/x.pdf", 1), ("raw/t/d/b/x.pdf", 3), ("b", 2, "UPLOADED_PENDING")], [("a", 4, "UPLOADED_PENDING")], [("raw/t/d/a/x.pdf", 5)]]
    assert sorted(r["file_id"] for r in run(spark, tmp_path, batches, registered=True).collect()) == ["a", "b"]


def test_job_ids_of_first_attempts_are_those_of_a_table(spark, tmp_path):
    from millrace.streaming.ingest import dispatch

    made = run(spark, tmp_path, [[("raw/t/d/a/x.pdf", 1)]])
    table = dispatch(spark.createDataFrame([("raw/t/d/a/x.pdf",)], "key string"), None)
    assert made.first()["job_id"] == table.first()["job_id"]


def files(n=400, seed=11):
    r = random.Random(seed)
    prints = [r.getrandbits(63) for _ in range(12)]
    rows = []
    for i in range(n):
        p = r.choice([*prints, None])
        if p is not None:
            for _ in range(r.choice((0, 1, 2, 4))):
                p ^= 1 << r.randrange(63)
        name = r.choice(("plan", "Plan", "spec", "", "note")) + r.choice(("_Rev-A", "_Rev-B", " v2", "", "_rev_C")) + ".pdf"
        rows.append((r.choice("ttu"), r.choice((2**60 + i, i)), r.choice((None, i // 3)) if i < 5 else i // 3, r.choice(("", None, *"abcdef")), p, r.choice((name, None)), r.choice(("", "issue 7", None))))
    return rows


KIND = "tenant_id string, file_id long, created_at long, raw_sha256 string, simhash long, filename string, text string"


def streamed(spark, tmp, rows, cuts, made):
    ordered = sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[1]))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(ordered[a:b], KIND).repartition(2).write.parquet(str(tmp / "in" / f"b{i}"))
        stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(str(tmp / "in"))
        ingest(made(stream), str(tmp / "out"), str(tmp / "cp")).awaitTermination()
    return spark.read.parquet(str(tmp / "out"))


key = lambda r: str(tuple(r))


@pytest.mark.parametrize("cuts", [[], [7, 8, 230]])
def test_duplicates_as_files_arrive(spark, tmp_path, cuts):
    rows = files()
    table = spark.createDataFrame(rows, KIND)
    got = streamed(spark, tmp_path / "e", rows, cuts, stream_duplicates.exact_duplicates).drop("batch")
    want = duplicates.exact_duplicates(table, visibility="as_of").select(*got.columns)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count()
    found = streamed(spark, tmp_path / "r", rows, cuts, lambda s: stream_duplicates.recent_duplicates(s, "text", limit=20))
    near = duplicates.near_duplicates(table, limit=20, visibility="as_of")
    assert sorted(found.where("matches > 0").select(*near.columns).collect(), key=key) == sorted(near.collect(), key=key) and near.count()
    other = duplicates.superseded(table, "text", limit=20, visibility="as_of")
    assert sorted(found.where("other_file_id IS NOT NULL").select(*other.columns).collect(), key=key) == sorted(other.collect(), key=key) and other.count()


def test_near_fingerprints_that_differ_in_the_highest_bit(spark, tmp_path):
    top = -(2**63)  # as a long; its distances to the others are 1 and 2
    rows = [("t", 1, 1, None, 0, "", ""), ("t", 2, 2, None, top, "", ""), ("t", 3, 3, None, 1, "", "")]
    got = streamed(spark, tmp_path, rows, [2], stream_duplicates.recent_duplicates)
    near = sorted((r["file_id"], [tuple(x) for x in r["near"]]) for r in got.collect())
    assert near == [(2, [(1, 1)]), (3, [(2, 2), (1, 1)])]
    table = duplicates.near_duplicates(spark.createDataFrame(rows, KIND), visibility="as_of")
    assert near == sorted((r["file_id"], [tuple(x) for x in r["near"]]) for r in table.collect())


def test_states_are_tables_that_are_read_again_when_a_batch_is_repeated(spark, tmp_path):
    from millrace.streaming.held import WHOLE, Held

    kind = "tenant_id string, raw_sha256 string, created_at long, file_id long"
    made = stream_duplicates.exact_duplicates(spark.createDataFrame([], kind))
    assert isinstance(made, Held) and isinstance(jobs(notices(spark.createDataFrame([], "key string, at long"), F.col("at"))), Held)
    at, n = str(tmp_path / "held"), 2 * WHOLE + 3
    for i in range(n):
        batch = spark.createDataFrame([("t", "a", i, i), ("t", f"b{i % 4}", i, 100 + i), (None, "a", i, 200 + i)], kind).coalesce(1)
        for _ in range(2 if i % 5 == 1 else 1):  # some are repeated
            got = {(r["tenant_id"], r["file_id"]): (r["group_id"], r["matches"], list(r["match_ids"])) for r in made.step(batch, i, at).collect()}
        want = {("t", i): (0, i, list(range(min(i, 5)))), (None, 200 + i): (200, i, [200 + x for x in range(min(i, 5))])} if i else {}
        if i > 3:
            want["t", 100 + i] = (100 + i % 4, i // 4, [100 + i % 4 + 4 * x for x in range(min(i // 4, 5))])
        assert got == want
    import os

    assert len([v for v in os.listdir(at) if v[0].isdigit()]) < 2 * WHOLE + 2
