import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import construction as C
from millrace.functions import text as X


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a\r\nb\rc", "a\nb\nc"), ("a \t  b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("  x \n", "x"), ("", ""),
    ],
)
def test_normalize_whitespace(one, raw, clean):
    assert one(X.normalize_whitespace(F.lit(raw))) == clean


@pytest.mark.parametrize(
    ("raw", "joined"),
    [
        ("mid-\ndle", "middle"), ("par-\nt", "part"), ("pa-\nrt", "pa-\nrt"), ("AS-\nxyz", "AS-\nxyz"), ("was-\nxyz", "wasxyz"), ("a-\nb-\nc", "ab-\nc"), ("1-\na", "1-\na"), ("SW-\nMS", "SW-\nMS"),
    ],
)
def test_dehyphenate(one, raw, joined):
    """A letter joins once; letters that stand side by side in a protected word, and standards' prefixes, stay."""
    assert one(X.dehyphenate(F.lit(raw))) == joined


def test_lines_and_removal(one):
    assert one(X.split_lines(F.lit(" a \n\n b\n"))) == ["a", "b"]
    none = F.array().cast("array<string>")
    assert one(X.remove_lines(F.lit(" a \n\nb"), none)) == " a \n\nb"
    assert one(X.remove_lines(F.lit(" a \n\nb"), F.array(F.lit("b")))) == "a"


def test_snippet_and_tokens(one):
    assert one(X.snippet(F.lit(" a  b "), 10)) == "a b"
    assert one(X.snippet(F.lit("abcd efgh"), 5)) == "abcd..."
    assert one(X.snippet(F.lit(None).cast("string"), 5)) == ""
    assert one(X.tokens(F.lit("Él 12-ab"))) == ["l", "12", "ab"]


def test_hashes(one):
    h = int(hashlib.md5(b"abc").hexdigest(), 16) & (2**64 - 1)
    assert int(one(X.unsigned(X.token_hash(F.lit("abc"))))) == h
    assert one(X.chunk_id(F.lit("doc-1"), F.lit(3), F.lit(2))) == "doc-1#p3#c2"
    a, b = (one(X.content_hash(F.lit("doc-1"), F.lit(1), F.lit(i), F.lit("Text"))) for i in (0, 1))
    assert a == hashlib.sha256(b"doc-1|1|0|Text").hexdigest() and a != b


def test_stats(one):
    s = one(X.extraction_stats(F.lit("")))
    assert (s["text_length"], s["non_alpha_ratio"], s["repeated_line_ratio"]) == (0, 1.0, 0.0)
    s = one(X.extraction_stats(F.lit("a\na\n!!")))
    assert s["non_alpha_ratio"] == pytest.approx(2 / 6, abs=1e-4) and s["repeated_line_ratio"] == pytest.approx(1 / 3, abs=1e-4)


@pytest.mark.parametrize(
    ("name", "text", "found"),
    [("x_Rev-B.pdf", "", "Rev-B"), ("lev3.pdf", "", "v3"), ("x.pdf", "see Issue 4 and Version 2", "Version 2"), ("x.pdf", "none", None), ("x.pdf", " " * 2000 + "Rev A", None)],
)
def test_revision(one, name, text, found):
    assert one(C.revision(F.lit(name), F.lit(text))) == found


def test_dates_and_names(one):
    assert one(C.document_date(F.lit("2021-01-02 and 3 march 2020"))) == "3 march 2020"
    assert one(C.document_date(F.lit("nothing"))) is None
    assert one(C.base_name(F.lit("Plan_Rev-B.pdf"))) == "Plan"
    assert one(C.base_name(F.lit("Plan v2.1.pdf"))) == "Plan"
    assert one(C.base_name(F.lit("a-issue_3.dwg"))) == "a"


def test_standards(one):
    assert one(C.standards(F.lit("as/nzs 3000:2018 , AS/NZS 3500.1 was 2019 NCC  2022"))) == ["AS 2019", "AS/NZS 3000:2018", "AS/NZS 3500.1", "NCC 2022"]
    assert one(C.standard_title(F.lit("as/nzs 3500.9:2021"))) == "Plumbing and drainage"
    assert one(C.standard_title(F.lit("AS 9999"))) is None


def test_kinds(one):
    assert one(C.document_type(F.lit("nothing here"))).asDict() == {"doc_type": "general", "confidence": 0.0}
    tie = one(C.document_type(F.lit("change order, payment claim")))
    assert tie["doc_type"] == "variation" and tie["confidence"] == 0.5  # the earlier kind wins
    assert one(C.discipline(F.lit("plumbing and drainage, concrete"))) == "hydraulic"
    assert one(C.discipline(F.lit("x"))) is None
    assert one(C.section_reference(F.lit("intro\n4.1.2 Scope"))) == "4.1.2"
    assert one(C.section_reference(F.lit("APPENDIX C then clause 7"))) == "clause 7"


def test_query_expansion(one):
    assert one(C.expand_query(F.lit("the itp and SWMS"))) == "the itp and SWMS (Safe Work Method Statement)"
    assert one(C.expand_query(F.lit("pcx"))) == "pcx"
    assert one(C.abbreviation(F.lit("eot"))) == "Extension of Time"


def test_drawings_and_garbled(one):
    assert one(C.is_drawing(F.lit(""), F.lit("FloorPlan.pdf"))) and one(C.is_drawing(F.lit("see A-101"), F.lit("x")))
    assert not one(C.is_drawing(F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert one(C.garbled_ratio(F.lit(""))) == 0.0
    assert one(C.garbled_ratio(F.lit("[[[[ " + "x" * 25 + " ok"))) == pytest.approx(2 / 3)


def test_errors(one):
    e = lambda s: one(C.error_message(F.lit(s)))
    assert e('{"Cause": "{\\"errorMessage\\": \\"bad\\"}"}') == "bad"
    assert e('{"Cause": "plain"}') == "plain" and e('{"Error": "E"}') == "E" and e("{}") == "Pipeline failed" and e("oops") == "oops"


def test_hyphen_pattern_is_plain_text():
    assert re.search(X.HYPHENS, "S-\nW")


def test_atoms_are_found_in_one_pass(spark):
    """Atoms that overlap, begin or end alike, or need a word's edge, each against a plain search; the records' text is read by one pass."""
    import random

    from millrace.functions import patterns as P

    own = [r"works", r"steelwork", r"earthworks", r"ductwork", r"\bDB\b", r"BCA", r"claim\s+#", r"meeting", r"AS/?NZS", r"NZS", r"3600", r"36", r"\bVO\d+", r"road\s*works", r"[|]{3,}", r"v\d{2}", r"\d{4}-\d{2}", r"Z"]
    r = random.Random(5)
    bits = ["works", "steelworks", "EarthWorks", "ductwork", "db", "BcA", "claim #", "meeting", "as/nzs", "ASNZS", "3600", "36", "vo7", "road", "|||", "V12", "2021-07", " ", " ", "\n", "é", "z", "K"]
    texts = ["", "roadworks", "adb dba", "adb dba db", "1steelworks"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(300)]
    may = P.guarded(F.col("t"), own, lambda t, may: F.array(*may))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", may.alias("may"), F.array(*(F.rlike("t", F.lit(f"(?i){p}")) for p in own)).alias("has")).collect()
    flagged = {p: {row["t"] for row in rows if row["may"][i]} for i, p in enumerate(own)}
    for i, p in enumerate(own):
        assert {row["t"] for row in rows if row["has"][i]} <= flagged[p], p
    assert "1steelworks" in flagged["works"] and "adb dba" not in flagged[r"\bDB\b"] and "roadworks" not in flagged["steelwork"]
    plan = spark.createDataFrame([("t",)], "t string").select(C.metadata("t").alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?i)(?=[") == 1


def test_metadata_is_that_of_each_part(spark):
    import random

    r = random.Random(6)
    bits = ["SWMS ", "technical specification ", "site meeting minutes ", "AS/NZS 3000:2018 ", "AS 3600 ", "ncc 2022", " DB ", "roadworks ", "\n4.1 Scope ", "APPENDIX C ", "clause 7.2 ", " A-101 ", "x" * 90, "é " * 40, "word "]
    texts = [None, ""] + ["".join(r.choice(bits) for _ in range(r.choice((3, 30, 600)))) for _ in range(60)]
    parts = F.struct(C.document_type("t").alias("k"), C.discipline("t").alias("d"), C.standards("t").alias("s"), C.section_reference("t").alias("r"))
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select(C.metadata("t").alias("m"), parts.alias("p")).collect():
        m, p = row["m"], row["p"]
        assert (m["doc_type"], m["doc_type_confidence"], m["discipline"], m["standards_referenced"], m["section_reference"]) == (*p["k"], p["d"], p["s"], p["r"])


def test_collapsed_white_space(spark):
    texts = ["", " ", "a b", "a  b", "a\tb", "a \t b", "\n a\x0b\x0cb \r", "a  b", "a\n\nb c\td  "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.collapse("t").alias("c")).collect()
    assert all(row["c"] == re.sub(r"[ \t-\r]+", " ", row["t"]).strip(" ") for row in got)
