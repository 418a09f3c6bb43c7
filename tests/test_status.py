"""Status machines: against a plain fold, with hot keys, ties of form, refused events and known starts."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import status
from millrace.operators.catalog import STATES


def plain(events, kind, start=None):
    out, at = [], dict(start or {})
    for k, t, i, s in sorted(events, key=lambda e: (e[0] is not None, e[0], e[1] is not None, e[1], e[2])):
        was = at.get(k)
        yes = s is not None and s in STATES[kind].get(was, ())
        at[k] = s if yes else was
        out.append((k, t, i, s, was, yes, at[k]))
    return out, at


def log(kind, n, seed=1):
    r = random.Random(seed)
    every = sorted({s for to in STATES[kind].values() for s in to}) + ["BOGUS", None]
    return [(r.choice(("hot", "hot", "a", "b", "c", None)), r.choice((None, *range(n // 3))), i, r.choice(every)) for i in range(n)]


KIND = "k string, t long, i long, status string"


@pytest.mark.parametrize("kind", sorted(STATES))
@pytest.mark.parametrize("run", [256, 3])
def test_against_a_plain_fold(spark, monkeypatch, kind, run):
    monkeypatch.setattr(status, "RUN", run)
    events = log(kind, 700)
    got = status.replay(spark.createDataFrame(events, KIND).withColumn("extra", F.lit(1)).repartition(3), kind, ["k"], ["t", "i"])
    want, last = plain(events, kind)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert {r["k"]: r["status"] for r in status.standing(got, ["k"], ["t", "i"]).collect()} == last
    assert any(w[5] for w in want) and any(not w[5] for w in want)


def test_known_starts(spark):
    events = [("a", 1, 1, "COMPLETE"), ("b", 1, 2, "COMPLETE"), (None, 1, 3, "FAILED")]
    start = {"a": "PROCESSING", None: "PROCESSING", "z": "FAILED"}
    got = status.replay(spark.createDataFrame(events, KIND), "file", ["k"], ["t", "i"], spark.createDataFrame(list(start.items()), "k string, status string"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain(events, "file", start)[0]))


def test_times_of_both_forms_are_one_order(one):
    times = ["2024-01-01T00:00:01Z", "2024-01-01T00:00:00.999Z", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01.001Z"]
    got = sorted(times, key=lambda t: one(status.moment(F.lit(t))))
    assert got == [times[2], times[1], times[0], times[3]] and one(status.moment(F.lit("soon"))) is None


def test_an_upload_sets_its_dataset_back(spark):
    at = lambda n: F.lit(n).cast("long")
    files = spark.createDataFrame([("t", "d", "f")], "tenant_id string, dataset_id string, file_id string")
    dataset, file = status.uploads(files, at(1))
    later = [("t", "d", n, s) for n, s in enumerate(("CHUNKED", "INDEXING", "READY"), 2)]
    events = dataset.unionByName(spark.createDataFrame(later, "tenant_id string, dataset_id string, at long, status string")).unionByName(status.uploads(files, at(9))[0])
    rows = status.replay(events, "dataset", ["tenant_id", "dataset_id"], ["at"])
    assert [(r["was"], r["now"], r["accepted"]) for r in rows.orderBy("at").collect()] == [(None, "UPLOADED", True), ("UPLOADED", "CHUNKED", True), ("CHUNKED", "INDEXING", True), ("INDEXING", "READY", True), ("READY", "UPLOADED", True)]
    (got,) = status.replay(file, "file", ["tenant_id", "dataset_id", "file_id"], ["at"]).collect()
    assert got["accepted"] and got["now"] == "UPLOADED_PENDING"


def test_no_events(spark):
    assert status.replay(spark.createDataFrame([], KIND), "file", ["k"], ["t"]).collect() == []
