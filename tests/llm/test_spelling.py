"""Spelling variants: against all pairs, on odd inputs, with groups over several shelves; automata against plain sets."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import spelling as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, odds=199, least=5, times=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % odds == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * k else None
    out = []
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, k, len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def corpus(seed=2, n=250):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(40)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "Straße", "STRASSE", "ÀÉÎõü÷×y", "short", "x"]
    weight = [r.choice((1, 6, 40, 300)) for _ in base]
    docs = [(i, " ".join(r.choices(base, weight, k=r.randint(0, 60)))) for i in range(n)]
    return docs + [(1, None), (2, ""), (None, "aaaaaa_babab1ababab\n" * 9), (7, "Straße"), (7, "Straße"), (8, "-.- 12 日本"), (9, "longwordrepeated " * 30_000), (10, "z" * 20_000 + " " + "z" * 20_001)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(7) for c in ("word", "n", "half", "form", "root")})


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize("odds,shelf", [(199, S.SHELF), (3, 4), (3, 1)])
def test_against_all_pairs(spark, odds, shelf):
    docs = corpus()
    got = S.variants(frame(spark, docs), odds=odds, shelf=shelf).select("word", "n", "n_near", "form", "form_n", "root")
    want = plain(docs, odds)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert any(w[3] for w in want) and any(w[3] and w[3] != w[5] for w in want) or odds == 199


def test_counts_flushed_within_a_task(spark, monkeypatch):
    docs = corpus(3, 60)
    whole = {tuple(r) for r in S.count_words(frame(spark, docs)).collect()}
    monkeypatch.setattr(S, "HELD", 3)
    monkeypatch.setattr(S, "LONG", 10)
    assert {tuple(r) for r in S.count_words(frame(spark, docs)).collect()} == whole


def test_forms_of_forms(spark):
    """Chains of forms of any length lead to one root."""
    made = [(f"w{i}", f"w{i + 1}" if i < 20 else None) for i in range(21)] + [("alone", None)]
    got = {r["word"]: r["root"] for r in S.roots(spark.createDataFrame(made, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w20" for i in range(21)}, "alone": "alone"}


def test_empty_table(spark):
    assert S.variants(frame(spark, corpus()).limit(0)).collect() == []


def test_automaton():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 7))) for _ in range(400)})
    a = S.Automaton(words)
    assert a.size[a.start] == len(words)
    for i, w in enumerate(words):
        state, number = a.walk(w, a.start)
        assert number == i and a.final[state]
    # minimal: no two states accept the same endings
    endings = {}
    for s in range(len(a.letters)):
        endings[s] = frozenset(({""} if a.final[s] else set()) | {c + e for c, t in a.letters[s].items() for e in endings[t]})
    assert len(set(endings.values())) == len(endings)
    for w in words[::7]:
        for cut in (0, 1, len(w)):
            assert {words[i] for i in a.one_error(w[:cut], w[cut:])} - {w} == {v for v in words if v[:cut] == w[:cut] and one_edit(v[cut:], w[cut:])}
