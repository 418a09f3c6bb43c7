"""Question tables and the vector index: against plain cosine over all rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import search, vector_index

CHUNKS = "tenant_id string, dataset_id string, chunk_id string, embedding array<float>"
QUESTIONS = "question_id long, tenant_id string, dataset_id string, vector array<float>, k int"


def plain(questions, chunks):
    out = []
    for qid, t, d, v, k in questions:
        if v is None or t is None or d is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        q, found = np.array(v, np.float32).astype(float), []
        for ct, cd, cid, e in chunks:
            if (ct, cd) == (t, d) and cid is not None and e is not None and len(e) == len(v) and all(x is not None and np.isfinite(x) for x in e) and any(e):
                c = np.array(e, np.float32).astype(float)
                found.append((-(q * c).sum() / (np.sqrt((q * q).sum()) * np.sqrt((c * c).sum())), cid))
        k = 8 if k is None else min(max(k, 1), 20)
        out += [(qid, cid, -s, n) for n, (s, cid) in enumerate(sorted(found)[:k], 1)]
    return out


def data(n_questions, n_chunks, seed=3, size=6, datasets=5):
    r = random.Random(seed)
    v = lambda: [round(r.uniform(-1, 1), 2) for _ in range(size)]
    place = lambda: ("t", "d0") if r.random() < 0.4 else (r.choice("tu"), f"d{r.randrange(datasets)}")
    chunks = [(*place(), f"c{i:05d}", v()) for i in range(n_chunks)]
    chunks += [(*c[:2], f"copy{i}", [2 * x for x in c[3]] if i % 2 else c[3]) for i, c in enumerate(chunks[: n_chunks // 4])]
    chunks += [("t", "d0", "zero", [0.0] * size), ("t", "d0", "null", None), ("t", "d0", "hole", [None, *v()[1:]]), ("t", "d0", "nan", [float("nan"), *v()[1:]]), ("t", "d0", None, v()), (None, "d0", "lost", v())]
    questions = [(i, *place(), v(), r.choice((None, 0, 1, 3, 8, 20, 99))) for i in range(n_questions)]
    questions += [(n_questions, "t", "d0", None, 5), (n_questions + 1, "t", "d0", [0.0] * size, 5), (n_questions + 2, "t", "none such", v(), 5), (n_questions + 3, None, "d0", v(), 5), (n_questions + 4, "t", "d0", chunks[0][3], 20)]
    return questions, chunks


def frames(spark, questions, chunks):
    return spark.createDataFrame(questions, QUESTIONS).repartition(3), spark.createDataFrame(chunks, CHUNKS).repartition(3)


def same(got, want):
    got = sorted(tuple(r) for r in got.select("question_id", "chunk_id", "score", "n").collect())
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], atol=1e-12)


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "asked": 3}])
def test_questions_against_plain(spark, sizes):
    questions, chunks = data(60, 300)
    same(search.nearest(*frames(spark, questions, chunks), **sizes), plain(questions, chunks))


def test_thousands_of_questions(spark):
    questions, chunks = data(3000, 400, 9)
    same(search.nearest(*frames(spark, questions, chunks), block=64, asked=256), plain(questions, chunks))


def test_vectors_of_other_sizes_do_not_meet(spark):
    questions, chunks = data(10, 50)
    more = [(*c[:2], c[2] + "x", c[3] + [0.5] if c[3] else None) for c in chunks if c[2]]
    same(search.nearest(*frames(spark, questions, chunks + more)), plain(questions, chunks))


def test_empty_tables(spark):
    questions, chunks = frames(spark, *data(5, 20))
    assert search.nearest(questions.limit(0), chunks).collect() == [] and search.nearest(questions, chunks.limit(0)).collect() == []


def test_hits_have_the_chunks_columns(spark):
    questions, chunks = frames(spark, *data(5, 20))
    found = search.hits(search.nearest(questions, chunks), chunks, ["chunk_id", "dataset_id"])
    assert found.columns == ["question_id", "chunk_id", "dataset_id", "score", "n"]


def clustered(n, seed=2, size=16, groups=40):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, size))
    return (centres[r.integers(0, groups, n)] + 0.25 * r.normal(size=(n, size))).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = clustered(6000)
    r = random.Random(4)
    chunks = [("t", "big" if r.random() < 0.8 else f"small{r.randrange(6)}", f"c{i:05d}", v.tolist()) for i, v in enumerate(x)]
    chunks += [("t", "big", f"copy{i}", chunks[i][3]) for i in range(0, 300, 3)] + [("t", "big", "zero", [0.0] * 16), ("t", "big", "null", None), (None, "big", "lost", [1.0] * 16)]
    path = str(tmp_path_factory.mktemp("index"))
    made = vector_index.build(spark.createDataFrame(chunks, CHUNKS).repartition(4), path, sample=2000, rows_a_list=100, levels=6)
    asked = [(i, *chunks[40 * i][:2], (np.array(chunks[40 * i][3]) + 0.1).tolist(), r.choice((None, 1, 20))) for i in range(120)]
    return made, chunks, asked, path


def test_every_row_is_in_one_list(spark, index):
    made, chunks, _, path = index
    rows = made.rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("keys"), F.countDistinct("list").alias("lists")).collect()
    assert sum(r["n"] for r in rows) == len(chunks) - 3 == sum(r["keys"] for r in rows)
    lists = {r["dataset_id"]: r["lists"] for r in rows}
    assert lists["big"] > 32 and all(1 <= n <= 4 for d, n in lists.items() if d != "big")
    assert sum(r["n"] for r in made.lists.collect()) == len(chunks) - 3
    again = vector_index.opened(spark, path, made.rows)
    assert again.rows.count() == made.rows.count() and np.array_equal(again.tree.centre, made.tree.centre) and np.array_equal(again.tree.cut, made.tree.cut)


def test_exact_search_of_the_index(spark, index):
    made, chunks, asked, _ = index
    questions = spark.createDataFrame(asked + [(500, "t", "big", [0.0] * 16, 3), (501, "t", "none such", [1.0] * 16, 3)], QUESTIONS)
    same(vector_index.find(made, questions, probes=2), plain(asked, chunks))


def test_recall_and_rows_read(spark, index):
    made, chunks, asked, _ = index
    asked = [(*a[:4], 20) for a in asked]
    questions = spark.createDataFrame(asked, QUESTIONS)
    want = {(q, c) for q, c, _, _ in plain(asked, chunks)}
    got = {(r["question_id"], r["chunk_id"]) for r in vector_index.find(made, questions, probes=6, exact=False).collect()}
    recall, read = len(want & got) / len(want), vector_index.rows_read(made, questions, 6)
    print("recall at 20:", recall, "rows read:", read)
    assert recall >= 0.9 and read < 0.4


def test_one_question_reads_its_lists_alone(spark, index):
    made, chunks, asked, _ = index
    qid, t, d, v, _ = next(a for a in asked if a[2] == "big")
    found = vector_index.find_one(made, t, d, v, 5, probes=3)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        filters = vector_index.find_one(made, t, d, v, 5, probes=3)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"list#\d+ IN \(\d+,\d+,\d+\)", filters.split("PushedFilters")[0]) and found.count() == 5
    everything = vector_index.find_one(made, t, d, v, 5, probes=1000)
    assert [r["chunk_id"] for r in everything.collect()] == [c for _, c, _, _ in plain([(qid, t, d, v, 5)], chunks)]


def test_index_of_nothing(spark, index, tmp_path):
    made, _, asked, _ = index
    questions = spark.createDataFrame(asked, QUESTIONS)
    empty = vector_index.build(spark.createDataFrame([], CHUNKS), str(tmp_path / "none"))
    assert empty.rows.count() == 0 and vector_index.find(empty, questions.limit(0), exact=False).collect() == []
    assert vector_index.find(made, questions.limit(0)).collect() == []
