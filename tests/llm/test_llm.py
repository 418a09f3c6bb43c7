"""The ten operators and the pipeline: against plain versions, libraries or round trips, and on odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, "same text here"), (4, "same text here"), (4, "same text here"), (None, "no id at all"), (5, LONG), (6, "é \n\x00 日本 😀"), (7, " \n \t ")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("n_tokens", "score", "node", "chunk", "piece", "n_lines", "y", "label", "row", "h1", "ids")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def corpus(n=120, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(200)]
    return [(i, " ".join(r.choice(vocabulary[: r.choice((20, 200))]) for _ in range(r.randint(0, 60)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- 1: language model ---


def plain_lm(rows, folds=5, held=1, cells=None):
    """Scores by the definition, with EM over single held-out events (of cells as wide as the operator's, or not rounded for 0)."""
    from millrace.llm import deleted_interpolation as D

    CELLS, ROUNDS = D.CELLS if cells is None else cells, D.ROUNDS  # noqa: N806

    name = lambda i: str(i).encode()
    part = {i: 2 if zlib.crc32(name(i)) % folds == held else zlib.crc32(b"part of " + name(i)) >> 8 & 1 for i, _ in rows}
    words = {i: [*t.encode().lower().split(), b""] for i, t in rows}
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in words.items():
        if part[i] < 2:
            one[part[i]].update(w)
            two[part[i]].update(zip([b"", *w], w, strict=False))
    v, size = len(one[0] | one[1]), [sum(c.values()) for c in one]
    bucket = lambda c: c.bit_length()
    near = lambda p: p * (v + 1) if not CELLS else 2.0 ** (np.round(CELLS * np.log2(p * (v + 1))) / CELLS) if p else 0.0
    events = defaultdict(list)
    for kept, out in ((0, 1), (1, 0)):
        for (a, b), n in two[out].items():
            c = one[kept][a]
            events[bucket(c)].append((n, (1.0, near(one[kept][b] / size[kept] if size[kept] else 0), near(two[kept][a, b] / c if c else 0))))
    weights = {}
    for b, rows_ in events.items():
        w = [1 / 3] * 3
        for _ in range(ROUNDS):
            new = [1e-3] * 3
            for n, p in rows_:
                share = [x * y for x, y in zip(w, p, strict=True)]
                new = [x + n * y / sum(share) for x, y in zip(new, share, strict=True)]
            w = [x / sum(new) for x in new]
        weights[b] = w
    one, two, n, out = one[0] + one[1], two[0] + two[1], sum(size), {}
    for i, w in words.items():
        total = 0.0
        for a, b in zip([b"", *w], w, strict=False):
            l0, l1, l2 = weights[min(weights, key=lambda x: (abs(x - bucket(one[a])), x))] if weights else (1 / 3,) * 3
            p = l0 / (v + 1) + (l1 * one[b] / n if n else 0)
            total += math.log10(p + l2 * two[a, b] / one[a] if one[a] else p / (l0 + l1 * (n > 0)))
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out[i] = (part[i] == 2, len(w), sum(one[x] > 0 for x in w), n, base, total)
    return out


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 150, "BUCKET": 40, "GROUP": 3}, {"CHUNK": 150, "GROUP": 1}])
def test_lm_against_plain(spark, monkeypatch, sizes):
    """With one chunk a task, and with many chunks in groups, whose sums go in two levels."""
    from millrace.llm import deleted_interpolation as D

    for name, n in sizes.items():
        monkeypatch.setattr(D, name, n)
    rows = corpus() + [(500, "word " * 3000), (501, "")]
    got = {r["doc_id"]: tuple(r)[1:] for r in D.score(frame(spark, rows)).collect()}
    want = plain_lm(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:] == pytest.approx(w[4:], rel=1e-9)


def test_lm_rounding_is_small(spark):
    """Scores of held-out texts, in sum, against EM over estimates that are not rounded."""
    from millrace.llm.deleted_interpolation import score

    rows = corpus(400, 5)
    got = {r["doc_id"]: r["score"] for r in score(frame(spark, rows)).collect() if r["held_out"]}
    exact = {i: x[5] for i, x in plain_lm(rows, cells=0).items() if x[0]}
    coarse = {i: x[5] for i, x in plain_lm(rows, cells=2).items() if x[0]}
    off = lambda a: abs(sum(a.values()) / sum(exact.values()) - 1)
    print("held-out sums:", sum(exact.values()), sum(got.values()), sum(coarse.values()))
    assert got.keys() == exact.keys() and off(got) < 1e-4 and 10 * off(got) < off(coarse)


def test_lm_weights():
    from millrace.llm.deleted_interpolation import CELLS, ZERO, maximise, pack, unpack

    key = lambda b, two, one: (b << 40) + ((two + 1) << 20) + one + 1
    good, bad = ZERO + 10 * CELLS, -1
    w = maximise(np.array([key(3, good, ZERO), key(1, bad, good)]), np.array([1000.0, 1000.0]))
    assert w[3][2] > 0.95 and w[1][1] > 0.95 and all(x.min() > 0 and x.sum() == pytest.approx(1) for x in w.values())
    for a in ([], [0, 0], [1, 2**63, 5]):
        assert unpack(pack(np.array(a, np.uint64)), len(a)).tolist() == a


def test_lm_odd(odd, none):
    from millrace.llm.deleted_interpolation import score

    rows = score(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 7)} == {1} and [r["n_tokens"] for r in rows if r["doc_id"] is None] == [5]
    assert score(none).count() == 0


# --- 2: top-k ---


@pytest.mark.parametrize("hot", [0, 60])
def test_top_k_against_plain(spark, monkeypatch, hot):
    from millrace.llm import block_topk as B

    r = np.random.default_rng(1)
    x = np.floor(64 * r.normal(0, 0.3, (400, 8))).astype(int)
    x[:hot] = x[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<long>")
    got = defaultdict(list)
    for row in B.top_k(df, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    for q in range(0, 400, 20):
        s = x @ x[q]
        assert got[q] == [(i, s[i]) for i in sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:7]]


def best_by_hand(rows, k, asked=lambda i: i is not None and i % 20 == 0):
    """rows of (vec_id, whole numbers): all scores of each row that is asked, row by row."""
    out = []
    for at, (q, x) in enumerate(rows):
        if asked(q):
            s = [(min(max(sum(a * b for a, b in zip(x, y, strict=True)), -(2**63)), 2**63 - 1), c) for j, (c, y) in enumerate(rows) if j != at and len(x) == len(y)]
            s.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
            out += [(q, n + 1, c, v) for n, (v, c) in enumerate(s[:k])]
    return Counter(out)


def test_search_skips_nothing():
    from millrace.llm.block_topk import BLOCK, search

    r = np.random.default_rng(2)
    x, ids = r.integers(-9, 9, (5 * BLOCK + 3, 4)).astype(float), r.permutation(5 * BLOCK + 3)
    low = np.full(6, np.iinfo(np.int64).min)
    for (_, at, s), q in zip(search(ids[:6], x[:6], low, ids, ids, x, 5), range(6), strict=True):
        want = sorted(((-(x[i] @ x[q]), ids[i]) for i in range(len(x)) if ids[i] != ids[q]))[:5]
        assert [(-a, b) for a, b in zip(s, ids[at], strict=True)] == want


def test_products_are_exact():
    from millrace.llm.block_topk import bounds, product

    r = np.random.default_rng(3)
    for most in (100, 2**28, 2**45, 2**70):
        a, b = (np.floor(r.uniform(-most, most, (4, 5))) for _ in range(2))
        want = [[min(max(sum(int(x) * int(y) for x, y in zip(u, v, strict=True)), -(2**63)), 2**63 - 1) for v in b] for u in a]
        assert product(a, b).tolist() == want
        assert (bounds(a, b.max(0)[None], b.min(0)[None]) >= product(a, b).max(1)[:, None]).all()


@pytest.mark.parametrize("small", [False, True])
def test_top_k_repeated_ids_large_and_odd_vectors(spark, monkeypatch, small):
    """Query rows that repeat an id with other and with equal vectors, ids that are null, components of any finite size, extra
    columns with the operator's own names; the SQL says the same where its numbers are large enough."""
    from millrace.llm import block_topk as B

    if small:
        for name, n in (("SHARD", 7), ("QUERIES", 2), ("BLOCK", 3), ("TOGETHER", 2)):
            monkeypatch.setattr(B, name, n)
    nan, inf, r = float("nan"), float("inf"), random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(20, [0.5, 0.5, -0.5]), (20, [0.5, 0.5, -0.5]), (20, [-1.0, 0.25, 0.0]), (None, [0.9, 0.9, -0.9]), (3, [600000.0, 0.0, 1.0]), (40, [-600000.0, 2.0, 1e9])]
    huge = [(60, [1e30, 1.0, 1.0]), (61, [-1e30, 5.0, 5.0])] if small else []
    odd = [(0, [nan, 1.0, 1.0]), (2, [inf, 1.0, 1.0]), (3, None), (6, [None, 1.0, 1.0])]
    other = [(80, [1.0]), (81, [0.5]), (100, []), (101, [])]
    df = spark.createDataFrame(rows + huge + odd + other, "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit(7) for c in ("row", "score", "rank", "number", "size", "keys", "block", "shard", "kind")})
    got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in B.top_k(B.whole(df), F.col("vec_id") % 20 == 0, 20).collect())
    whole = [(i, [math.floor(64 * v) for v in x]) for i, x in rows + huge + other]
    assert got == best_by_hand(whole, 20)
    if not small:
        import duckdb

        from millrace.llm.queries import OP2_SQL

        con = duckdb.connect()
        con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
        con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(x) for x in rows + odd])
        assert Counter(con.sql(OP2_SQL).fetchall()) == best_by_hand(whole[: len(rows)], 20)


def test_blocks_of_clustered_vectors_are_skipped(spark, monkeypatch):
    """Most visits and whole shards are spared where vectors lie in groups; the results are those of all products."""
    from millrace.llm import block_topk as B

    monkeypatch.setattr(B, "SHARD", 16 * 2048)
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (60, 16))
    x = np.floor(64 * (centres[r.integers(0, 60, 20_000)] + r.normal(0, 0.05, (20_000, 16)))).astype(int)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, x array<long>").withColumn("row", F.lit(1))
    tally = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
    got = defaultdict(list)
    for row in B.top_k(df, F.col("vec_id") % 100 == 0, 10, tally).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    for q in range(0, 20_000, 100):
        s = x @ x[q]
        s[q] = -(10**9)
        assert got[q] == [(int(i), int(s[i])) for i in np.lexsort((np.arange(len(s)), -s))[:10]]
    visits, met = (t.value for t in tally)
    print("visits", visits, "of", met, "of", 200 * -(-20_000 // B.BLOCK))
    assert visits < 0.5 * met


def test_top_k_odd(spark):
    from millrace.llm.block_topk import top_k, whole

    df = spark.createDataFrame([(0, [1.0, -0.01]), (4, [0.5, 0.5]), (4, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [r["x"] for r in whole(df).where("vec_id = 0").collect()] == [[64, -1]]
    rows = top_k(whole(df), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 4, 64 * 32 - 32), (0, 2, 4, 64 * 32 - 32)]
    assert top_k(whole(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(ValueError, match="positive"):
        top_k(whole(df), F.lit(True), 0)


# --- 3: token counts ---


def unigram():
    from tokenizers import Tokenizer, models, normalizers

    from millrace.llm.token_counts import read_pieces

    pieces = read_pieces(P.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items(), *((f"<0x{i:02X}>", 0.0) for i in range(256))], unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_token_counts_against_library(spark):
    from millrace.llm.token_counts import Counter as Counts
    from millrace.llm.token_counts import count_tokens, read_pieces

    t, r = unigram(), random.Random(5)
    texts = ["".join(r.choice("the onaé  ▁\n日x😀qzst") for _ in range(r.randint(1, 16))) for _ in range(1500)]
    c = Counts(read_pieces(P.path("piece_bpe_32k.model")))
    assert [c.count(x)[1] for x in texts] == [len(t.encode(x).ids) for x in texts]
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(frame(spark, list(enumerate(texts[:50]))), P.path("piece_bpe_32k.model")).collect()}
    assert got == {i: len(t.encode(x).ids) for i, x in enumerate(texts[:50])}


def test_viterbi_ties_and_whole_texts():
    from millrace.llm.token_counts import Counter as Counts

    c = Counts({"a": -1.0, "b": -1.0, "ab": -2.0})
    assert c.viterbi("ab") == (-2.0, 1, 0)  # the piece that starts first stays
    assert Counts({"a▁b": -1.5, "a": -1.0}).parts is False
    assert Counts({}).viterbi("é") == (-10.0, 2, 1)


def test_token_counts_odd(odd, none):
    from millrace.llm.token_counts import count_tokens

    path = P.path("piece_bpe_32k.model")
    rows = count_tokens(odd, path).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert count_tokens(none, path).count() == 0


# --- 4: near-duplicates ---


def groups(rows, similar=0.8):
    """Classes by comparing all pairs."""
    from millrace.llm.dart_minhash import Elements

    maker = Elements()
    words = [maker.words(t or "") for _, t in rows]
    sets = [set(maker.elements(w).tolist()) for w in words]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if words[i].tobytes() == words[j].tobytes() or (sets[i] and sets[j] and both >= similar * (len(sets[i]) + len(sets[j]) - both)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def copies(seed=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, base = [], [word() for _ in range(200)]
    for _ in range(80):  # a large group of near copies, close and less close
        w = base.copy()
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for _ in range(30):
        t = " ".join(word() for _ in range(r.randint(1, 60)))
        rows += [t] * r.randint(1, 3)
    return list(enumerate(rows))


def test_near_duplicates_against_plain(spark):
    from millrace.llm.dart_minhash import keep_one, near_duplicates

    rows = copies()
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == groups(rows)
    kept = keep_one(frame(spark, rows).withColumn("more", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "more"] and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_keep_one_keeps_a_row_of_each_class(spark):
    """Different texts under null and under one repeated id; copies of a numbered text under null; a repeated id in two classes."""
    from millrace.llm.dart_minhash import keep_one

    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(30))
    alone, numbered, shared = [text() for _ in range(5)], text(), [text() for _ in range(4)]
    rows = [(None, t) for t in alone] + [(None, alone[0]), (None, numbered), (1, numbered), (2, numbered)]
    rows += [(7, t) for t in shared] + [(7, shared[0]), (3, shared[1]), (7, numbered), (None, None), (None, "")]
    kept = keep_one(frame(spark, rows).withColumn("more", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "more"]
    got = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert got == Counter([*((None, t) for t in alone), (1, numbered), (7, shared[0]), (3, shared[1]), (7, shared[2]), (7, shared[3]), (None, "")])


def test_null_ids_are_linked_like_others(spark):
    """Near copies among rows without id, between such rows and numbered ones, and under one repeated id."""
    from millrace.llm.dart_minhash import keep_one, near_duplicates

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for ids in ((None, None, None), (None, 11, None), (7, 7, 7), (7, None, 5), (None,), (9, 9)):
        base = [word() for _ in range(200)]
        rows += [(d, " ".join([*base[:-1], word()])) for d in ids]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    members = {}
    for k, c in groups(numbered).items():
        members.setdefault(c, []).append(rows[k][0])
    assert len(members) == 6
    least = {c: min((d for d in ids if d is not None), default=None) for c, ids in members.items()}
    want = Counter((d, least[c]) for c, ids in members.items() for d in ids)
    assert Counter((r["doc_id"], r["class_id"]) for r in near_duplicates(frame(spark, rows)).collect()) == want
    assert Counter(r["doc_id"] for r in keep_one(frame(spark, rows)).collect()) == Counter(least.values())


def test_blocks_find_the_same_links(spark, monkeypatch):
    from millrace.llm import dart_minhash as D

    monkeypatch.setattr(D, "BLOCK", 7)
    rows = copies(4)
    assert {r["doc_id"]: r["class_id"] for r in D.near_duplicates(frame(spark, rows)).collect()} == groups(rows)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """One bucket of many nodes that have half of their elements in common: split by the elements where similar nodes meet."""
    from millrace.llm import dart_minhash as D

    monkeypatch.setattr(D, "BLOCK", 5)
    r, common = random.Random(8), list(range(40))
    sets = []
    for _ in range(25):
        own = common + [r.randrange(1000, 10**6) for _ in range(40)]
        sets += [own, [r.randrange(10**6) if r.random() < 0.12 else e for e in own]]
    sets = [sorted(set(s)) for s in sets]
    alike = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    want = {(i, j) for i in range(50) for j in range(i) if alike(sets[i], sets[j])}
    assert 5 < len(want) < 25
    linker = D.Linker(spark.createDataFrame(list(enumerate(sets)), "node long, elements array<long>").cache(), 0.8)
    filed = spark.createDataFrame([(b, i, len(s)) for b in (1, 2) for i, s in enumerate(sets)], "band long, node long, n int")
    largest = []
    monkeypatch.setattr(D.Linker, "merge", lambda self, edges: largest.append({(r["b"], r["a"]) for r in edges.collect()}))
    linker.link_within(filed)
    assert largest == [want]
    parts = linker.split(filed.select(F.col("band").alias("key"), "node", "n", F.col("node").alias("component")))
    assert parts.groupBy("key").count().agg(F.max("count")).first()[0] <= 4


def test_hot_keys_are_dealt(spark):
    from millrace.llm.common import hot_join

    rows = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, v long").cache()
    table = rows.select("k").distinct().withColumn("t", F.col("k") * 2)
    for how, n in (("inner", 3000), ("left", 3001)):
        got = hot_join(rows, table, "k", how, least=100)
        assert got.columns == ["k", "v", "t"] and got.count() == n and got.where("t <> 2 * k").count() == 0


def test_signatures_estimate_similarity():
    from millrace.llm.dart_minhash import mix, signatures

    r = np.random.default_rng(0)
    a = mix(np.arange(1, 301).astype(np.uint64))
    x, y = signatures([a[:200], a[100:]], k=2000)
    assert abs((x == y).mean() - 1 / 3) < 0.05
    wa = r.integers(1, 5, 300) * 0.7
    wb = np.where(r.random(300) < 0.5, wa, wa * 1.6)
    x, y = signatures([a, a], [wa, wb], k=2000)
    assert abs((x == y).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05
    assert (signatures([a[:1]], k=64) < np.iinfo(np.uint64).max).all()


def test_weighted_elements(spark):
    from millrace.llm.dart_minhash import near_duplicates

    rows = [(1, "a b c d e " * 3), (2, "a b c d e " * 30), (3, "a b c d e " * 29)]
    by = lambda w: {r["doc_id"]: r["class_id"] for r in near_duplicates(frame(spark, rows), weights=w).collect()}
    assert by("set") == {1: 1, 2: 1, 3: 1} and by("counts") == {1: 1, 2: 2, 3: 2}


def test_near_duplicates_odd(odd, none):
    from millrace.llm.dart_minhash import near_duplicates

    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert by == {1: 1, 2: 1, 3: 3, 4: 3, None: None, 5: 5, 6: 6, 7: 1}
    assert near_duplicates(none).count() == 0


# --- 5: packing ---


def pieces_of(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            yield i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, capacity):
    from millrace.llm.pattern_packing import pack

    rows = corpus() + [(500, LONG), (501, None), (502, "")]
    got = pack(frame(spark, rows), P.path("word_bpe_49k.json"), capacity).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(pieces_of(rows, capacity))
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    total = sum(r["length"] for r in got)
    assert len(used) <= -(-total // capacity) * 1.03 + 1


def test_pack_counts():
    from millrace.llm.pattern_packing import pack_counts

    counts = np.zeros(65, np.int64)
    counts[[1, 3, 20, 31, 33, 40, 44, 64]] = [7, 900, 1000, 500, 500, 10, 10, 4]
    plan = pack_counts(counts, 64)
    back = np.zeros(65, np.int64)
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            back[x] += n
    assert (back == counts).all() and pack_counts(np.zeros(65, np.int64), 64) == []


def test_word_ids_like_the_library():
    from millrace.llm.word_tokens import WordIds

    w = WordIds(P.path("word_bpe_49k.json"))
    texts = ["the THE. É́ it's <|endoftext|>", "a\x1fb c", "", "ſ µ ª x&&& 12ab ''s", "naïve!!! ÿŸß"]
    r = random.Random(3)
    texts += ["".join(r.choice(["Foo", "bar", "ÉTÉ", "ª", "µ", "'s", "12", ".", "!!", "?,", " ", "  ", "\n", "\t", "日", "İ", "é"]) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    assert w.pack(texts) == [np.array(e.ids, "<u4").tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_odd(odd, none):
    from millrace.llm.pattern_packing import pack

    assert len({(r["sequence_id"], r["offset"]) for r in pack(odd, P.path("word_bpe_49k.json")).collect()}) >= len(ODD)
    assert pack(none, P.path("word_bpe_49k.json")).count() == 0


# --- 6 and 9: classifiers ---


def labelled(spark, n=500):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.6, r.random() < 0.4
        words = [word() for _ in range(r.randint(20, 90))]
        if r.random() < 0.5:
            words[3] = r.choice(["women", "muslim", "deaf"])
        if toxic:
            words[5] = r.choice(["blorgon", "snivelak"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("label", "folds", "held"), [("quality", 3, 1), ("toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, label, folds, held):
    from millrace.llm.byte_cnn import fit_quality, score_texts
    from millrace.llm.toxicity import fit_toxicity

    docs, labels = labelled(spark)
    fit = fit_quality if label == "quality" else fit_toxicity
    # labels of held-out rows are wrong on purpose: they must not be learned
    wrong = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, 1 - F.col(label)).otherwise(F.col(label)))
    model = fit(docs, wrong, label, folds, held)
    rows = score_texts(docs, model).join(labels, "doc_id").collect()
    test = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % folds == held]
    assert sum((r["score"] >= 0.5) == r[label] for r in test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_neutral_mentions_do_not_move_scores():
    from millrace.llm.toxicity import fit

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    sets, y = [], []
    for _ in range(400):  # insults come with a group's name much more often than other texts do
        bad = r.random() < 0.5
        s = {word() for _ in range(12)}
        if bad:
            s.add("blorgon")
        if r.random() < (0.8 if bad else 0.2):
            s.add("muslim")
        sets.append(s)
        y.append(float(bad))
    with_swaps, without = fit(sets, np.array(y), swap=20.0), fit(sets, np.array(y), swap=0.0)
    change = lambda m: abs(float(np.diff(m.scores(["some people here", "some muslim people here"]))[0]))
    assert change(with_swaps) < 0.05 and change(with_swaps) <= change(without) and with_swaps.scores(["you blorgon"])[0] > 0.5


def test_swaps_hold_terms_among_many_short_texts():
    """The weight of swaps as it is in use, and more pairs than 4000."""
    from millrace.llm.toxicity import fit

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    sets, y = [], []
    for i in range(4000):
        bad = i % 2
        s = {word() for _ in range(12)}
        if bad and r.random() < 0.6:
            s.add("blorgon")
        if r.random() < (0.3 if bad else 0.03):
            s.add("muslim")
        sets.append(s)
        y.append(float(bad))
    log_odds = lambda p: np.log(p / (1 - p))
    change = lambda m: abs(float(np.diff(log_odds(m.scores(["some people here", "some muslim people here"])))[0]))
    model, free = fit(sets, np.array(y)), fit(sets, np.array(y), swap=0.0)
    assert change(free) > 2 and change(model) < change(free) / 2
    assert model.scores(["you blorgon"])[0] > 0.9


def test_network_covers_whole_texts():
    from millrace.llm.byte_cnn import CHUNK, HOP, ByteCnn, chunks, starts

    for n in (0, 1, CHUNK, CHUNK + 1, CHUNK + HOP, 5000):
        at = starts(n)
        assert at[0] == 0 and (at[-1] + CHUNK >= n) and (np.diff(at) <= HOP).all()
    m = ByteCnn()
    texts = ["", "a", "x" * 5000, "Ü" * 700, LONG]
    one_by_one = [float(m.scores([t])[0]) for t in texts]
    assert m.scores(texts).tolist() == pytest.approx(one_by_one, rel=1e-5) and chunks(b"abc").shape == (1, CHUNK)
    assert m.scores([]).tolist() == []


def test_network_learns():
    from millrace.llm.byte_cnn import ByteCnn

    texts = ["aaaa bbbb " * 30, "ZZZZ!!!! " * 30] * 12
    y = np.array([1.0, 0.0] * 12, np.float32)
    p = ByteCnn().fit([t.encode() for t in texts], y, epochs=15).scores(texts)
    assert ((p > 0.5) == y).all()


def plain_network(m, data):
    """One text's logit, number by number."""
    from millrace.llm.byte_cnn import CHUNK, FILTERS, STRIDE, WIDTH, starts

    data = data + bytes(max(0, CHUNK - len(data)))
    pooled = []
    for at in starts(len(data)):
        c = data[at : at + CHUNK]
        pooled.append([max(sum(float(m.table[k][c[j + k]][f]) for k in range(WIDTH)) for j in range(0, CHUNK - WIDTH + 1, STRIDE)) for f in range(FILTERS)])
    columns = list(zip(*pooled, strict=True))
    f = np.array([*map(max, columns), *(sum(c) / len(c) for c in columns), *map(min, columns)])
    return float(np.tanh(f @ m.w1 + m.b1) @ m.w2 + m.b2[0] + m.shift)


def test_network_against_plain_and_differences():
    """Scores against a plain forward pass; the gradient against differences of the loss, for texts of more chunks than PART."""
    from millrace.llm import byte_cnn as B

    r = random.Random(4)
    texts = ["".join(r.choice("abcé \n日Z!") for _ in range(n)) for n in (0, 40, 700, 3000)]
    m = B.ByteCnn(3)
    want = [1 / (1 + math.exp(-plain_network(m, t.encode()))) for t in texts]
    assert m.scores(texts).tolist() == pytest.approx(want, rel=1e-4)
    for n in ("table", "w1", "b1", "w2", "b2"):
        setattr(m, n, getattr(m, n).astype(float))
    sets, y = [t.encode() for t in texts], np.array([1.0, 0.0, 1.0, 0.0])
    part, B.PART = B.PART, 3
    try:
        _, grad = m.gradient(sets, y)
    finally:
        B.PART = part
    for n, g in grad.items():
        value, places = getattr(m, n), np.argsort(-np.abs(g).ravel())[:6]
        for at in (np.unravel_index(i, g.shape) for i in places):
            before, step, loss = value[at], 1e-5, []
            for sign in (1, -1):
                value[at] = before + sign * step
                loss.append(m.gradient(sets, y)[0])
            value[at] = before
            assert (loss[0] - loss[1]) / (2 * step) == pytest.approx(float(g[at]), rel=1e-3, abs=1e-6)


def test_labelled_rows_are_learned_whole_and_bounded(spark, monkeypatch):
    """Texts of 40 chunks; one labelled id has many copies and another text."""
    from millrace.llm.byte_cnn import ByteCnn, fit_quality, sample

    r = random.Random(9)
    docs = [(i, "".join(r.choice("aeiou lmnrsté") for _ in range(17_000))) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    rows = frame(spark, docs + [docs[4]] * 50 + [(4, "other")])
    got, counts = sample(rows, labels, "quality", 3, 1, 15)
    taken = [x["doc_id"] for x in got.collect()]
    free = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(taken) == len(set(taken)) == 30 and sum(counts.values()) == len(free) and set(taken) <= set(free)
    seen = []
    monkeypatch.setattr(ByteCnn, "fit", lambda self, sets, y: seen.append((sets, y.tolist())) or self)
    fit_quality(rows, labels, "quality", 3, 1)
    want = {docs[i][1].encode(): i % 2 for i in free if i != 4}
    got = {s: y for s, y in zip(*seen[0], strict=True) if s not in (b"other", docs[4][1].encode())}
    assert got == want and len(seen[0][0]) == len(free)


def rewritten(texts):
    """Pairs of texts that should score alike, by rewriting them: an identity term into another one of its kind, a term put in."""
    from millrace.llm.toxicity import IDENTITIES, MENTION

    kinds = [v.split() for v in IDENTITIES.values()]
    every = sorted(t for terms in kinds for t in terms)
    words = lambda t: t.split()
    swapped, mentioned = [], []
    for i, t in enumerate(texts):
        for term in sorted(set(words(t)) & set(every)):
            (terms,) = (k for k in kinds if term in k)
            other = terms[(terms.index(term) + 1 + i % (len(terms) - 1)) % len(terms)]
            swapped.append((t, " ".join(other if w == term else w for w in words(t))))
    swapped += [(t, every[(i + 1) % len(every)]) for i, t in enumerate(every)]
    for i, t in enumerate(sorted((t for t in texts if t), key=lambda t: (len(set(words(t))), sorted(set(words(t)))))):
        mentioned.append((t, f"{t} {every[i % len(every)]}"))
    mentioned += [("", " ".join(MENTION).format(t)) for t in every]
    return swapped, mentioned


def plain_logistic(texts, y, names, swap, square):
    """Weights by many small steps down the definition's slope, all pairs as single rows of rewritten texts."""
    from millrace.llm.toxicity import features

    row = lambda t: np.array([1.0 if n in {f for w in t.split() for f in features(w)} else 0.0 for n in names])
    x = np.array([[*row(t), 1.0] for t in texts])
    kinds = []
    for pairs in rewritten(texts):
        d = np.array([[*(row(a) - row(b)), 0.0] for a, b in pairs])
        kinds.append(d[(d != 0).any(1)])
    w = np.zeros(x.shape[1])
    hold = np.append(np.full(len(names), 2 * square), 0.0)
    for _ in range(6000):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + hold * w
        for d in kinds:
            g += 2 * swap * d.T @ (d @ w) / len(d)
        w -= 0.05 * g
    return w


def test_toxicity_against_plain():
    """The fit against plain descent over rewritten texts, the penalty at its default; scores against plain sums of weights. Words
    that share a term's beginning and copies with both labels are among the texts."""
    from millrace.llm import toxicity as X

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcd") for _ in range(3))
    texts, y = [], []
    for i in range(300):
        bad = i % 2
        s = {word() for _ in range(8)}
        for w, often, else_ in (("blorgon", 0.7, 0.1), ("muslim", 0.5, 0.2), ("womanly", 0.6, 0.1), ("woman", 0.4, 0.2), ("whiteboard", 0.1, 0.4)):
            if r.random() < (often if bad else else_):
                s.add(w)
        texts.append(" ".join(sorted(s)))
        y.append(float(bad))
    y = np.array(y)
    model = X.fit([set(t.split()) for t in texts + texts[:40] * 2], np.append(y, [*y[:40], *(1 - y[:40])]), square=0.01)
    y[:40] = (2 * y[:40] + 1 - y[:40]) / 3
    names = sorted({*model.weights, *(t for v in X.IDENTITIES.values() for t in v.split())})
    assert {"woma*", "woman*", "womanly", "white*"} & set(names)
    w = plain_logistic(texts, y, names, X.SWAP, 0.01)
    got = np.array([model.weights.get(n, 0.0) for n in names] + [model.bias])
    assert np.abs(got - w).max() < 0.02
    for text in ("You BLORGON, muslim!", "", "nothing known"):
        known = {f for t in set(X._WORD.findall(text.lower())) for f in X.features(t)}
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0) for f in known))), rel=1e-9)


def test_every_feature_that_stands_out_is_learned():
    """A thousand of them, and rows that share all but a few words, of opposite labels."""
    from millrace.llm import toxicity as X

    r = random.Random(5)
    bad, good = ([f"{p}{i:03d}" for i in range(500)] for p in ("x", "y"))
    common = [f"w{i}" for i in range(50)]
    letters = str.maketrans("0123456789", "abcdefghij")
    sets, y = [], []
    for i in range(600):
        own = r.sample(bad if i % 2 else good, 200)
        sets.append({w.translate(letters) for w in [*common, *own]})
        y.append(float(i % 2))
    model = X.fit(sets, np.array(y))
    assert sum(w.translate(letters) in model.weights for w in bad + good) == 1000
    assert all(model.weights[w.translate(letters)] > 0 for w in bad) and all(model.weights[w.translate(letters)] < 0 for w in good)
    base = {f"same{i}" for i in range(50)}
    pairs = [(base | {"vile"}, 1.0), (base | {"kind"}, 0.0)]
    sets, y = zip(*([(s | {f"n{k}" for k in range(j)}, label) for j in range(40) for s, label in pairs]), strict=True)
    model = X.fit([{w.translate(letters) for w in s} for s in sets], np.array(y))
    assert model.weights["vile"] > 0.5 > -0.5 > model.weights["kind"]


def test_neutral_mentions_are_fewer_false_positives():
    """The penalty as it is in use: neutral texts that mention a group are called toxic less often than without it."""
    from millrace.llm.toxicity import IDENTITIES, fit

    r, terms = random.Random(21), [t for v in IDENTITIES.values() for t in v.split()]
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    sets, y = [], []
    for i in range(3000):
        bad, s = i % 2, {word() for _ in range(6)}
        if bad and r.random() < 0.5:
            s.add("blorgon")
        if r.random() < (0.6 if bad else 0.02):
            s.add(r.choice(terms[:20]))
        sets.append(s)
        y.append(float(bad))
    neutral = [" ".join([r.choice(terms[:20]), *(word() for _ in range(6))]) for _ in range(500)]
    rate = lambda m: float((m.scores(neutral) >= 0.5).mean())
    without, model = rate(fit(sets, np.array(y), swap=0.0)), fit(sets, np.array(y))
    print("false positives on neutral mentions:", without, rate(model))
    assert rate(model) < 0.3 < 0.9 < without and model.scores(["you blorgon"])[0] > 0.9


def test_classifiers_odd(spark, odd, none):
    """Ids whose labels differ, null ids and null labels teach nothing; then all scores are the labels' smoothed share."""
    from millrace.llm.byte_cnn import fit_quality, score_texts
    from millrace.llm.toxicity import fit_toxicity

    labels = spark.createDataFrame([(3, 1, 1), (3, 0, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    for fit, want in ((fit_quality, 1 / 2), (fit_toxicity, 2 / 3)):
        rows = score_texts(odd, fit(odd, labels)).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD) and {round(r["score"], 6) for r in rows} == {round(want, 6)}
        assert score_texts(none, fit(none, labels.limit(0))).count() == 0
    both = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (4, 1, 1), (5, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for fit in (fit_quality, fit_toxicity):
        got = defaultdict(set)
        for r in score_texts(odd, fit(odd, both)).collect():
            assert 0 <= r["score"] <= 1
            got[{None: "", "": ""}.get(dict(ODD).get(r["doc_id"]), r["doc_id"])].add(r["score"])
        assert all(len(v) == 1 for v in got.values())  # equal texts, equal scores; null as the empty text


# --- 7: byte-level BPE ---


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    from millrace.llm.byte_bpe import coder, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return *coder(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def test_bpe_like_the_library(bpe):
    encoder, decoder, library = bpe
    r = random.Random(7)
    texts = ["".join(r.choice("aab é\n\t    'sllveÜß日本語1234 !?…😀\x1f\x1c\x85́‍½²Ⅳ٣ ") for _ in range(r.randint(0, 20))) for _ in range(3000)] + ["a  b", " a", "a ", "x\n y", "antidisestablishmentarianism" * 4]
    for t in texts:
        packed = encoder.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(t), repr(t)
        assert "".join(decoder.stream(packed, 2)) == t


def test_bpe_of_a_pattern_in_which_spaces_end_matches():
    import tiktoken

    from millrace.llm.byte_bpe import coder, read_ranks

    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), r"\w+ ?|\s+|[^\w\s]+ ?"
    encoder, library = coder(path, pattern)[0], tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    for t in ("one two three", "a  b c", " lead and end ", "x, y; z", ""):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode_ordinary(t), repr(t)


def test_transducer_forgets_and_waits_little(bpe, monkeypatch):
    from millrace.llm import byte_bpe as B

    monkeypatch.setattr(B, "STEPS", 50)
    t = bpe[0].transducer
    for w in (b"hello", b" interessanterweise", bytes(range(256)), b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaa"):
        assert np.frombuffer(t.encode(w), "<u4").tolist() == (t.merged(w) if w not in t.ranks else [t.ranks[w]])
    longest = max(map(len, t.ranks))
    assert all(len(held) <= longest for state in t.states for held, _, _ in state)


def test_one_long_match_is_linear(bpe, monkeypatch):
    """A million letters without a space; the table of states starts anew within the match."""
    import time

    from millrace.llm import byte_bpe as B

    monkeypatch.setattr(B, "STEPS", 100_000)
    encoder, decoder, library = bpe
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyzé", k=1_000_000))
    began = time.time()
    packed = encoder.encode(text)
    assert time.time() - began < 60 and len(encoder.transducer.steps) <= 100_001
    assert "".join(decoder.stream(packed)) == text
    part = text[:200_000]
    assert np.frombuffer(encoder.encode(part), "<u4").tolist() == library.encode_ordinary(part)


def test_ranks_out_of_order():
    from millrace.llm.byte_bpe import Transducer

    ranks = {bytes([i]): i + 10 for i in range(97, 101)} | {b"ab": 3, b"bc": 2, b"abc": 1, b"cd": 0}
    t = Transducer(ranks)
    assert not t.in_order
    r = random.Random(3)
    for _ in range(300):
        w = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 9)))
        assert np.frombuffer(t.encode(w), "<u4").tolist() == ([ranks[w]] if w in ranks else t.merged(w))


def test_utf8_machine():
    from millrace.llm.byte_bpe import Utf8

    r = random.Random(11)
    for _ in range(3000):
        b = bytes(r.choice([0x41, 0xE0, 0xA0, 0x80, 0xF0, 0x9F, 0xC3, 0xA9, 0xED, 0xFF, 0xF4, 0x90]) for _ in range(r.randint(0, 12)))
        m, cut = Utf8(), sorted(r.randint(0, len(b)) for _ in range(4))
        assert "".join(m.feed(b[i:j]) for i, j in zip([0, *cut], [*cut, len(b)], strict=True)) + m.close() == b.decode("utf-8", "replace")


def test_bpe_odd(odd, none):
    from millrace.llm.byte_bpe import decode, encode, round_trip

    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = round_trip(odd, path, P.PATTERN).collect()
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == want
    back = decode(encode(odd, path, P.PATTERN), path, P.PATTERN).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t in ODD)
    assert round_trip(none, path, P.PATTERN).count() == 0


# --- 8: lines ---


def plain_lines(rows):
    """rows (id, text) with distinct ids, in order of ids."""
    first, out = {}, {}
    blank = lambda x: not x.strip(" \t\r\x0b\f")
    for i, text in rows:
        lines = (text or "").split("\n")
        counted = [k for k, x in enumerate(lines) if not blank(x)]
        gone = set()
        for p in range(len(counted) - 2):
            w = tuple(lines[k].removesuffix("\r") for k in counted[p : p + 3])
            at = first.setdefault(w, (i, p))
            if at[0] != i or p >= at[1] + 3:
                gone.update(counted[p : p + 3])
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(counted), len(gone))
    return out


def test_lines_against_plain(spark):
    from millrace.llm.line_dedup import dedup_lines

    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(["a", "b", "c", "a\r", "", " ", "d%d" % i]) for _ in range(r.randint(0, 14)))) for i in range(150)] + [(200, "a\n" * 9), (201, None)]
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in dedup_lines(frame(spark, rows)).collect()}
    assert got == plain_lines(rows)


def test_lines_odd(odd, none):
    from millrace.llm.line_dedup import dedup_lines

    out = dedup_lines(odd)
    assert set(out.columns) == {*odd.columns, "n_removed"} and out.where("n_removed = 0").count() == len(ODD)
    assert dedup_lines(none).count() == 0


def test_lines_with_clashing_names(spark):
    from millrace.llm.line_dedup import dedup_lines

    rows = [(1, "a\nb\nc"), (2, "x\na\nb\nc\ny"), (None, "a\nb\nc\nz"), (2, "a\nb\nc"), (5, None)]
    names = ("_gone", "_doc", "_row", "_left", "found", "FOUND_", "row", "gone", "h1", "first", "at", "n_lines")
    wide = frame(spark, rows).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    plain = sorted(map(str, dedup_lines(frame(spark, rows)).select("doc_id", "text").collect()))
    assert sorted(map(str, dedup_lines(wide).select("doc_id", "text").collect())) == plain
    left = dedup_lines(wide, counts=False)
    assert left.columns == wide.columns and {tuple(r)[2:] for r in left.collect()} == {tuple(range(len(names)))}


# --- 10: Ogg ---


def test_ogg_round_trips_and_faults():
    from millrace.llm.ogg import SERIALS, checksum, demux, load, payload_of, store

    def slow(data):
        r = 0
        for b in data:
            r ^= b << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if r >> 31 else r << 1
        return r

    assert all(checksum(d) == slow(d) for d in (b"", b"a", bytes(range(256))))
    for n in (0, 1, 63, 64, 65, 255 * 16, 4096, 4097, 70_000, 255 * 4096):
        p = payload_of("é" * (n // 2) + "x" * (n % 2))
        back, feature = load(store(p))
        assert back == p and len(p) % 64 == 0 and len(p) >= max(64, n) and "faults=0" in feature
    media = store(payload_of("abc" * 40_000))
    streams, bad = demux(media)
    assert not bad and [s.seconds()[1] for s in streams.values()] == [0.625, 0.625] and streams[SERIALS[0]].seconds()[-1] == pytest.approx(120_000 / 8000, abs=0.01)
    broken = bytearray(media)
    broken[60_000] ^= 1
    assert "faults=0" not in load(bytes(broken))[1] and "faults=0" not in load(media[:-9])[1]
    assert load(b"no media")[0] == b"" and load(b"")[0] == b""
    assert load(b"junk" + media)[0] == load(media)[0]


def plain_ogg(media):
    """Pages (serial, number, flags, granule, lacing, body) of sound media, read byte by byte, and each stream's packets."""
    pages, at = [], 0
    while at < len(media):
        n = media[at + 26]
        lacing = list(media[at + 27 : at + 27 + n])
        num = lambda a, b, at=at: int.from_bytes(media[at + a : at + b], "little")
        pages.append((num(14, 18), num(18, 22), media[at + 5], num(6, 14), lacing, media[at : at + 27 + n + sum(lacing)]))
        at += 27 + n + sum(lacing)
    packets = defaultdict(lambda: [b""])
    for serial, _, _, _, lacing, raw in pages:
        body = raw[27 + len(lacing) :]
        for v in lacing:
            packets[serial][-1] += body[:v]
            body = body[v:]
            if v < 255:
                packets[serial].append(b"")
    return pages, {s: p[:-1] for s, p in packets.items()}


def test_ogg_pages_lost_swapped_repeated_and_cut():
    from millrace.llm.ogg import SERIALS, demux, load, store

    payload = bytes(random.Random(1).randrange(256) for _ in range(320_000))
    media = store(payload)
    pages, packets = plain_ogg(media)
    streams, bad = demux(media)
    assert not bad and {s: v.packets for s, v in streams.items()} == packets
    assert sum(p[2] & 1 for p in pages) > 20  # packets go over page borders
    assert b"".join(packets[SERIALS[0]][1:]) == payload
    raw = [p[5] for p in pages]
    fine = "faults=0 "
    for i in range(len(raw)):
        assert fine not in load(b"".join(raw[:i] + raw[i + 1 :]))[1], i  # lost
        assert fine not in load(b"".join(raw[: i + 1] + raw[i:]))[1], i  # repeated
        assert fine not in load(b"".join(raw)[: sum(map(len, raw[: i + 1])) - 1])[1], i  # cut
    of = [i for i, p in enumerate(pages) if p[0] == SERIALS[0]]
    for i, j in zip(of, of[1:], strict=False):
        other = raw.copy()
        other[i], other[j] = raw[j], raw[i]
        assert fine not in load(b"".join(other))[1], i  # swapped within a stream
    # what a page's loss leaves of the sound is whole packets of it
    left = demux(b"".join(raw[: of[3]] + raw[of[3] + 1 :]))[0][SERIALS[0]]
    assert all(p in packets[SERIALS[0]] for p in left.packets) and len(left.packets) < len(packets[SERIALS[0]])


def test_ogg_features_and_times_against_plain():
    from millrace.llm.ogg import FRAMES, RATE, SERIALS, demux, load, store

    r = random.Random(2)
    for n in (64, 5056, 70_016):
        payload = bytes(r.choice(b"aeiou \xc3\xa9") for _ in range(n))
        pages, packets = plain_ogg(store(payload))
        x = [b - 128 for b in payload]
        mean, rms = sum(x) / n, (sum(v * v for v in x) / n) ** 0.5
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        want = f"streams=2 pages={len(pages)} packets={sum(map(len, packets.values()))} faults=0 seconds={n / RATE:.6f} mean={mean:.4f} rms={rms:.4f} crossings={crossings} range={min(payload)}-{max(payload)}"
        assert load(store(payload)) == (payload, want)
        for s in demux(store(payload))[0].values():
            ends = [min(k * FRAMES, n) / RATE for k in range(len(s.packets))]
            known = [(t, e) for t, e in zip(s.seconds(), ends, strict=True) if t == t]
            assert [t for t, _ in known] == pytest.approx([e for _, e in known]) and s.seconds()[-1] == n / RATE
        assert len(packets[SERIALS[0]]) == 1 + -(-n // FRAMES)


def test_ogg_odd(odd, none):
    from millrace.llm.ogg import digest_texts, packets, payload_of, read_media, store_texts

    rows = digest_texts(odd).collect()
    want = Counter((i, hashlib.sha256(payload_of(t or "")).hexdigest()) for i, t in ODD)
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in rows) == want
    media = store_texts(odd)
    assert read_media(media.withColumn("media", F.when(F.col("doc_id") != 3, F.col("media")))).where("length(payload) = 0").count() == 2
    assert packets(media).where("doc_id = 2").count() == 4 and digest_texts(none).count() == 0


# --- what they share ---


def test_written_tables_can_be_removed(spark):
    from millrace.llm.common import remove_written, written

    assert written(spark.range(5)).count() == 5
    assert remove_written(spark) and not remove_written(spark)


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(260):
        bad, toxic = i % 4 == 0, i % 5 == 0
        lines = [[word() for _ in range(12)] for _ in range(5)]
        if toxic:
            lines[2][3] = "blorgon"
        text = "\n".join(" ".join(x) for x in lines)
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, docs[1][1], "en", "s", 1), (1001, docs[2][1].replace("\n", " "), "en", "s", 1), (1002, docs[2][1].replace("\n", " ") + " more", "en", "s", 1), (1003, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {i for i, *_ in docs if i < 260 and i % 4 and i % 5}
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in C.STAGES[:-1]:
        before, at = at.columns, C.common.written(stage(spark, at, str(tmp_path)))
        assert at.columns == before
        seen[name] = {x["doc_id"]: x["text"] for x in at.collect()}
    assert len(kept - seen["toxicity"].keys()) <= 6 and sum(i % 4 == 0 for i in seen["quality"] if i < 260) <= 3
    assert sum(i % 5 == 0 for i in seen["toxicity"] if i < 260) <= 4
    lines = plain_lines(sorted((i, t) for i, t in seen["toxicity"].items()))
    assert {i: t for i, (t, _, _) in lines.items()} == seen["line_dedup"] and seen["line_dedup"].get(1000, "") == ""
    classes = groups(sorted(seen["line_dedup"].items()))
    assert set(seen["near_dedup"]) == set(classes.values())
    final = C.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in final.collect()} == set(seen["near_dedup"])
    empty = at.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_odd_rows_and_names(spark, tmp_path):
    """Null ids, one id with two texts, and columns with names that stages use themselves: rows stay apart, columns as they are."""
    import corpus_pipeline as C

    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7)))
    text = lambda: "\n".join(" ".join(word() for _ in range(12)) for _ in range(4))
    docs = [(i, text()) for i in range(60)]
    docs += [(None, text()), (None, text()), (7, text()), (7, text()), (None, docs[3][1]), (8, docs[8][1])]
    labels = [(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(0, 4)]
    names = ("_gone", "node", "score", "y", "row", "found", "n_lines", "n_removed", "class_id", "hash", "piece", "offset", "at", "_part")
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(names)} | {"n_chars": F.length("text").cast("long")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES[2:4]:
        before, at = at.columns, C.common.written(stage(spark, at, str(tmp_path)))
        rows = at.collect()
        assert at.columns == before and {tuple(x[n] for n in names) for x in rows} == {tuple(range(len(names)))}, name
        assert all(x["n_chars"] == len(x["text"]) for x in rows)
        if name == "line_dedup":
            assert len(rows) == len(docs)
    texts = Counter((x["doc_id"], x["text"]) for x in rows)
    # emptied copies are one class; every other text is a class of its own
    assert sum(not t for _, t in texts) == 1 and Counter(t for _, t in texts if t) == Counter({t for _, t in docs})
    for name, stage in C.STAGES[:2]:  # few labels: these keep or reject, but neither lose columns nor crash
        got = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
        assert got.columns == before and set(map(str, got.collect())) <= set(map(str, spark.read.parquet(str(tmp_path / "documents.parquet")).collect())), name
    packed = C.run(spark, str(tmp_path))
    assert packed.count() == packed.select("sequence_id", "offset").distinct().count() > 0
