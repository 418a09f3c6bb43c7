"""Decontamination: against a plain scan, on odd inputs, in small shards and blocks; proximity likewise."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import positional_index as X

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def windows(text, window):
    w = tokens(text)
    return {tuple(w[i : i + window]) for i in range(max(len(w) - window + 1, 1))} if w else set()


def plain(docs, items, window=10):
    whose = {}
    for item, text in items:
        for p in windows(text, window):
            whose.setdefault(p, set()).add("null" if item is None else str(item))
    lengths = sorted({len(p) for p in whose})
    out = []
    for doc_id, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in whose:
                    hit.update(range(i, i + n))
                    found |= whose[p]
        out.append((doc_id, len(w), len(hit), len(found), sorted(found)))
    return out


def plain_close(docs, items, window, distance):
    """Documents and items of which a phrase's rarest word (ties: first by bytes, then by place) has the others near."""
    n = {}
    for _, text in docs:
        for w in tokens(text):
            n[w] = n.get(w, 0) + 1
    out = set()
    for row, (_, text) in enumerate(docs):
        w = tokens(text)
        for item, t in items:
            for p in windows(t, window):
                if all(x in n for x in p):
                    rare = min(p, key=lambda x: (n[x], x.encode()))
                    if any(x == rare and all(y in w[max(0, i - distance) : i + distance + 1] for y in p) for i, x in enumerate(w)):
                        out.add((row, str(item)))
    return out


def made(seed=4, n=150):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(("A", "b", "C.", "d'e", "é", "日本", "x9", "_", "ONE two")) for _ in range(k))
    items = [(i, text(r.choice((1, 3, 9, 10, 11, 14, 40)))) for i in range(30)] + [(30, None), (31, " .. "), (None, "no id item of words that are more than ten here"), (5, "second text of one item id five that has more than ten words")]
    docs = [(i, text(r.randint(0, 60))) for i in range(n)]
    docs += [(i, f"{text(5)} {r.choice(items)[1] or ''}, {text(3)} {(r.choice(items)[1] or '').upper()}") for i in range(n, 2 * n)]
    docs += [(1, None), (2, ""), (None, items[3][1]), (7, items[4][1]), (7, items[4][1]), (8, "filler word " * 60_000 + items[6][1] + " tail" * 10)]
    return docs, items


def frames(spark, docs, items):
    odd = lambda df: df.withColumns({c: F.lit(7) for c in ("shard", "place", "terms", "n_hit", "items", "block", "words", "bytes")})
    return odd(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), odd(spark.createDataFrame(items, "item_id long, text string"))


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 2000, "block_bytes": 3000}])
@pytest.mark.parametrize("window", [10, 3])
def test_against_plain(spark, sizes, window):
    docs, items = made()
    got = [tuple(r) for r in X.contamination(*frames(spark, docs, items), window=window, **sizes).collect()]
    assert sorted(got, key=key) == sorted(plain(docs, items, window), key=key)
    assert any(g[2] for g in got) and not all(g[2] for g in got)


def test_pieces_of_a_long_item(spark):
    item = " ".join(f"w{i}" for i in range(400))
    docs = [(1, item), (2, " ".join(f"w{i}" for i in range(30, 41))), (3, "w30 w31")]
    docs_, items = frames(spark, docs, [(9, item)])
    pieces = X.phrases(items, 10, 320)
    assert pieces.count() > 10
    assert sorted(tuple(r) for r in X.contamination(docs_, items, block_bytes=320).collect()) == plain(docs, [(9, item)])


def test_candidates_in_steps(spark, monkeypatch):
    """A phrase's list of rarest words that is longer than a step."""
    docs, items = [(1, "a b " * 500)], [(1, "a b a")]
    whole = [tuple(r) for r in X.contamination(*frames(spark, docs, items)).collect()]
    row = X.build(frames(spark, docs, items)[0]).toArrow().to_batches()[0]
    block = X.Phrases([("1", X.words("a b a"))], {b"a": 500, b"b": 500}, 10)
    shard = X.Shard({c: row.column(c)[0] for c in row.schema.names}, X.pa.array(block.terms, X.pa.binary()))
    assert sum(len(p) for p, _ in shard.candidates(block, 7)) == 500 and whole == [(1, 1000, 999, 1, ["1"])]


@pytest.mark.parametrize("distance", [2, 6])
def test_proximity(spark, distance):
    docs, items = made(6, 40)
    docs, items = docs[:80], [x for x in items if x[1] and x[0] is not None]
    numbered = [(row, text) for row, (_, text) in enumerate(docs)]
    index = X.build(frames(spark, numbered, items)[0], 500)
    found = X.matches(index, frames(spark, docs, items)[1], window=4, within=distance, block_bytes=3000)
    got = {(r["doc_id"], r["item_id"]) for r in found.join(X.places(index), ["shard", "place"]).collect()}
    assert got == plain_close(docs, items, 4, distance) and got


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "some text"), (2, None)], [(1, "some text")])
    none = sorted(tuple(r) for r in X.contamination(docs, items.limit(0)).collect())
    assert none == [(1, 2, 0, 0, []), (2, 0, 0, 0, [])]
    assert X.contamination(docs.limit(0), items).collect() == []


def test_shards_are_read_one_by_one(spark):
    """Each shard is a row group, and its positions are bytes: a reader holds one of them, however many a task has."""
    import pyarrow.parquet as pq

    rows = [(i, " ".join(f"w{i % 7} x{k}" for k in range(40))) for i in range(60)]
    index = X.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1000)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert index.count() > 10 and sum(g.num_row_groups for g in groups) == index.count()
    assert index.schema["positions"].dataType.typeName() == "binary"
