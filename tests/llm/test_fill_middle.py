"""Fill-in-the-middle: against a plain version, on odd inputs, and across windows of long texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import fill_middle as M

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a <P> b c d"), (5, "one"), (6, "é \x00 日本 😀  end \n"), (None, "no id at all here"), (7, "same same same"), (7, "same same same"), (7, "other text of one id"), (8, "w < S> <<P <S \n" * 50), (9, "long text " * 30_000), (10, "x" * 50_000 + " " * 50_000), (11, " nbsp em space")]


def plain(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+", text)
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def rows(spark, made):
    return spark.createDataFrame(made, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("n", "form", "output", "prefix_chars")})


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize("rate,window", [(50, 1 << 20), (100, 64)])
def test_against_plain(spark, rate, window):
    r = random.Random(5)
    made = ODD + [(i, "".join(r.choice("ab <SPM>\n") for _ in range(r.randint(0, 80)))) for i in range(100, 400)]
    got = M.fill_in_middle(rows(spark, made), rate=rate, window=window).withColumn("restored", M.restored())
    got = [tuple(x) for x in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    assert sorted(got, key=key) == sorted((plain(i, t, rate=rate) for i, t in made), key=key)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert M.fill_in_middle(rows(spark, ODD).limit(0)).collect() == []


@pytest.mark.parametrize("sentinels", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("PP", "<S>", "<M>"), ("<P", "<P>", "<M>")])
def test_sentinels_that_overlap(sentinels):
    with pytest.raises(ValueError):
        M.restored(F.lit("x"), F.lit("psm"), sentinels)


def test_windows_of_a_long_text():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    text = ("ab  c\n" * 30 + "x" * 100 + " " * 70) * 3
    splitter = Split(Regex(M.UNITS), "isolated")
    assert list(M.unit_ends(text, splitter, 16)) == [m.end() for m in re.finditer(M.UNITS, text)]
