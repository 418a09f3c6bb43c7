import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.lexicon import SECTION_LINES
from millrace.functions.text import hamming
from millrace.operators import catalog, chunking, duplicates, pages, quality, retrieval, vectors


def simhash_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r["simhash"] for r in duplicates.simhash(df, ["id"]).orderBy("id").collect()]


def plain_simhash(text):
    import hashlib
    import re

    words = re.findall(r"[a-z0-9]+", (text or "").lower())
    hashes = [int(hashlib.md5(w.encode()).hexdigest(), 16) & (2**64 - 1) for w in words]
    bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) >= len(hashes)) if words else 0
    return bits - 2**64 if bits >> 63 else bits


def test_simhash(spark, one):
    texts = ["invoice 17 for concrete works in may", "invoice 18 for concrete works in may", "staff policy on leave and travel", "", None, "a"]
    got = simhash_of(spark, *texts)
    assert got == [plain_simhash(t) for t in texts]
    assert one(hamming(F.lit(0).cast("long"), F.lit(7).cast("long"))) == 3


def test_headers_and_boilerplate(spark):
    rows = [("d", i, f"Head\nNotice to all\nbody {i}\nrest {i}\nFoot {'x' if i < 9 else i}") for i in range(10)] + [("e", 0, None), ("e", 1, "")]
    df = spark.createDataFrame(rows, "doc string, page_number int, text string")
    lists = {r["doc"]: r for r in pages.removal_lists(df, ["doc"]).collect()}
    assert lists["d"]["headers"] == ["Head", "Notice to all"] and lists["d"]["footers"] == ["Foot x"] and lists["d"]["confidence"] == 0.3
    assert lists["d"]["boilerplate"] == ["Foot x", "Notice to all"]  # "Head" is too short
    assert lists["e"]["headers"] == []
    out = {(r["doc"], r["page_number"]): r["text"] for r in pages.normalize_pages(df, ["doc"]).collect()}
    assert out["d", 3] == "body 3\nrest 3" and out["e", 0] == ""


def files(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, file_id long, filename string, created_at long, raw_sha256 string, simhash long")


def test_duplicates(spark):
    df = files(spark, [("t", 1, "p_Rev-A.pdf", 1, "h", 0), ("t", 2, "p_Rev-B.pdf", 2, "h", 1), ("t", 3, "P_Rev-C.pdf", 3, "", 255), ("u", 4, "p_Rev-A.pdf", 4, "h", 0), ("t", 5, "q.pdf", 5, None, None)])
    exact = {r["file_id"]: (r["group_id"], r["matches"], r["match_ids"]) for r in duplicates.exact_duplicates(df).collect()}
    assert exact == {1: (1, 1, [2]), 2: (1, 1, [1])}
    near = {r["file_id"]: [(x["file_id"], x["distance"]) for x in r["near"]] for r in duplicates.near_duplicates(df).collect()}
    assert near == {1: [(2, 1)], 2: [(1, 1)]}
    newer = {r["file_id"]: (r["other_file_id"], r["other_revision"]) for r in duplicates.superseded(df).collect()}
    assert newer == {1: (3, "Rev-C"), 2: (3, "Rev-C"), 3: (2, "Rev-B")}
    assert duplicates.newest(df, 2).where("tenant_id = 't'").count() == 2
    pairs = duplicates.simhash_pairs(df).collect()
    assert [(r["a"], r["b"], r["distance"]) for r in pairs] == [(0, 1, 1)]
    assert duplicates.exact_duplicates(df.limit(0)).count() == duplicates.near_duplicates(df.limit(0)).count() == 0


def test_visibility_by_arrival(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ttttu"), i, f"{rng.choice('pq')}_Rev-{rng.choice('ABC')}.pdf", rng.randrange(90), rng.choice("hhhhi"), rng.choice([0, 1, 255, 1 << 40])) for i in range(300)]
    rows += [(None, 900, "p_Rev-A.pdf", 1, "h", 0), (None, 901, "p_Rev-B.pdf", 2, "h", 0), ("t", 902, "p.pdf", None, "h", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several blocks, though the rows are few
    try:
        df = files(spark, rows)
        assert duplicates.by_arrival(df, ["tenant_id"]).groupBy("tenant_id").agg(F.count_distinct("n"), F.max("n"), F.count("*")).where("tenant_id = 't'").collect()[0][1:] == (sum(r[0] == "t" for r in rows),) * 3
        exact = {r["file_id"]: (r["group_id"], r["matches"], r["match_ids"]) for r in duplicates.exact_duplicates(df, visibility="as_of").collect()}
        near = {r["file_id"]: (r["matches"], [(x["file_id"], x["distance"]) for x in r["near"]]) for r in duplicates.near_duplicates(df, visibility="as_of").collect()}
        newer = {r["file_id"]: (r["revision"], r["other_file_id"], r["other_revision"]) for r in duplicates.superseded(df, visibility="as_of").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = ({}, {}, {})
    for tenant in "tu":
        came = sorted((r for r in rows if r[0] == tenant), key=lambda r: (-1 if r[3] is None else r[3], r[1]))
        for i, (_, id_, name, _, sha, bits) in enumerate(came):
            same = [r[1] for r in came[:i] if r[4] == sha]
            recent = came[max(0, i - 49) : i][::-1]
            found = [(r[1], (r[5] ^ bits).bit_count()) for r in recent if bits is not None and r[5] is not None and (r[5] ^ bits).bit_count() <= 3]
            rev = name[2:7] if "Rev" in name else None
            other = [(r[1], r[2][2:7]) for r in recent if "Rev" in r[2] and rev and r[2][0] == name[0] and r[2][2:7] != rev]
            if same:
                want[0][id_] = (same[0], len(same), same[:5])
            if found:
                want[1][id_] = (len(found), found[:5])
            if other:
                want[2][id_] = (rev, *other[0])
    assert (exact, near, newer) == want
    assert duplicates.near_duplicates(df.limit(0), visibility="as_of").count() == duplicates.exact_duplicates(df.limit(0), visibility="as_of").count() == 0
    with pytest.raises(ValueError):
        duplicates.near_duplicates(df, visibility="later")


@pytest.mark.parametrize("visibility", ["snapshot", "as_of"])
def test_near_duplicates_among_all(spark, visibility):
    """A file's partners are all files within the distance, however many newer ones there are, in groups of any size."""
    import random

    rng = random.Random(8)
    centres = [rng.getrandbits(63) for _ in range(12)] + [-1, -(1 << 63)]
    flipped = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(62), k))
    rows = [(rng.choice("ttttu"), i, "n.pdf", rng.choice([None, *range(90)]), "h", flipped(rng.choice(centres), rng.choice((0, 0, 1, 2, 3, 4)))) for i in range(400)]
    rows += [("t", 1000 + i, "n.pdf", -1, "h", 0) for i in range(150)] + [("t", 2000, "n.pdf", 5, "h", None), (None, 2001, "n.pdf", 5, "h", 0), ("t", None, "n.pdf", 5, "h", 0)]
    want = {}
    for tenant in "tu":
        came = sorted((r for r in rows if r[0] == tenant and r[1] is not None), key=lambda r: (-2 if r[3] is None else r[3], r[1]))
        for i, r in enumerate(came):
            others = (came[:i] if visibility == "as_of" else came[:i] + came[i + 1 :])[::-1]
            apart = [(o[1], ((r[5] ^ o[5]) & (1 << 64) - 1).bit_count()) for o in others if None not in (r[5], o[5])]
            if found := [x for x in apart if x[1] <= 3]:
                want[tenant, r[1]] = (len(found), found[:5])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["tenant_id"], r["file_id"]): (r["matches"], [tuple(x) for x in r["near"]]) for r in duplicates.near_duplicates(files(spark, rows), limit=None, visibility=visibility).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and max(n for n, _ in got.values()) > 50
    assert duplicates.near_duplicates(files(spark, rows).limit(0), limit=None, visibility=visibility).count() == 0


def old_copies(spark):
    """Pages and files of a tenant: two near copies, and 60 others that came later."""
    body = " ".join(f"word{i % 97} clause{i}" for i in range(150))
    texts = [body, body + " only2", *(" ".join(f"other{(i * 37 + k * k) % 1009}" for k in range(60)) for i in range(60))]
    raw = spark.createDataFrame([("t", i, 1, x) for i, x in enumerate(texts, 1)], "tenant_id string, file_id long, page_number int, text string")
    return raw, files(spark, [("t", i, "q.pdf", i, f"h{i}", 0) for i in range(1, len(texts) + 1)]).drop("simhash")


def test_old_near_duplicates_are_found(spark):
    """Near copies with more than 50 newer files, which a look at the newest ones alone would miss."""
    import json

    from millrace.plans.readiness import reports

    got = {r["file_id"]: [json.loads(x["evidence"]) for x in r["findings"] if x["type"] == "NEAR_DUPLICATE"] for r in reports(*old_copies(spark)).collect()}
    assert [x["matches"][0]["file_id"] for i in (1, 2) for x in got[i]] == [2, 1] and got[1][0]["links"] == got[2][0]["links"] == 1


def test_payloads_have_old_near_duplicates(spark):
    import json

    from millrace.plans import payloads
    from millrace.plans.readiness import reports

    made = payloads.quality_reports(reports(*old_copies(spark)).withColumn("dataset_id", F.lit("d")))
    got = {r["file_id"]: {x["type"]: x for x in json.loads(r["payload"])["findings"]} for r in made.collect()}
    assert got[1]["NEAR_DUPLICATE"]["evidence"] == {"matches": [{"file_id": 2, "distance": got[2]["NEAR_DUPLICATE"]["evidence"]["matches"][0]["distance"]}], "links": 1}


def test_readiness(one):
    f = F.array(*(F.struct(F.lit(s).alias("severity")) for s in ("CRITICAL", "WARN", "INFO", None, "OTHER")))
    assert one(quality.readiness(f)) == 100 - 40 - 15 - 5 - 5
    assert one(quality.summary(f)).asDict() == {"CRITICAL": 1, "WARN": 1, "INFO": 2}
    many = F.array_repeat(F.struct(F.lit("CRITICAL").alias("severity")), 3)
    assert one(quality.readiness(many)) == 0
    warnings = quality.chunk_warnings(F.array(F.lit(499), F.lit(500), F.lit(1500), F.lit(1501)))
    assert [w["type"] for w in one(warnings)] == ["CHUNK_TOO_SMALL", "CHUNK_TOO_LARGE"]
    assert one(quality.adjusted(F.lit(5), warnings)) == 0


def test_rules(spark):
    rows = [(1, "short", "a.pdf"), (2, "", "plan.dwg"), (3, "technical specification " * 20 + "1 May 2020", "s.pdf"), (4, "!" * 400, "x.pdf"), (5, "same line\n" * 60, "y.pdf")]
    df = spark.createDataFrame(rows, "id int, text string, filename string")
    from millrace.functions.text import extraction_stats

    df = quality.with_facts(df.withColumn("stats", extraction_stats("text")))
    got = {r["id"]: [f["type"] for f in r["f"]] for r in df.select("id", F.array_compact(F.array(*quality.text_findings(F.col("stats")))).alias("f")).collect()}
    assert got[1] == ["LOW_TEXT_VOLUME", "MISSING_DATE"]
    assert got[2] == ["DRAWING_LOW_TEXT", "HIGH_NON_ALPHA_RATIO", "MISSING_DATE"]
    assert got[3] == ["MISSING_REVISION"]
    assert got[4] == ["POOR_OCR_QUALITY", "HIGH_NON_ALPHA_RATIO", "MISSING_DATE"]
    assert got[5] == ["REPEATED_LINES", "MISSING_DATE"]


def test_whole_report(spark):
    from millrace.plans.readiness import reports

    raw = spark.createDataFrame([("t", 1, 1, "Header line\nwords " * 30), ("t", 1, 2, "Header line\nother " * 30), ("t", 2, 1, None)], "tenant_id string, file_id long, page_number int, text string")
    meta = spark.createDataFrame([("t", 1, "a.pdf", 1, "x"), ("t", 2, "b.pdf", 2, "x")], "tenant_id string, file_id long, filename string, created_at long, raw_sha256 string")
    got = {r["file_id"]: r for r in reports(raw, meta).collect()}
    assert "EXACT_DUPLICATE" in [f["type"] for f in got[1]["findings"]] and got[2]["chunk_count"] == 0 and 0 <= got[1]["readiness"] <= 100


def test_report_with_all_rules_on_other_files(spark):
    """Copies, near copies, another revision, headers and chunk warnings in one report; findings in the rules' order."""
    import json

    from millrace.plans.readiness import reports

    body = " ".join(f"word{i % 97} clause{i}" for i in range(150))
    page = lambda text: f"ACME Works\nIssued for construction\n{text}\nPrinted copy"
    raw = [("t", f, p, page(f"{body}{p}" + (f" only{f}" if f == 3 else "") + f"\nend of {p}")) for f in (1, 2, 3) for p in (1, 2, 3)] + [("t", 4, 1, "other " * 500), ("u", 5, 1, page(body)), ("t", 6, 1, "tiny")]
    meta = [("t", 1, "plan_Rev-A.pdf", 1, "x"), ("t", 2, "plan_Rev-B.pdf", 2, "x"), ("t", 3, "q.pdf", 3, "y"), ("t", 4, "r.pdf", 4, "z"), ("u", 5, "plan_Rev-A.pdf", 5, "x"), ("t", 6, "s.pdf", 6, None)]
    rows = reports(spark.createDataFrame(raw, "tenant_id string, file_id long, page_number int, text string"), spark.createDataFrame(meta, "tenant_id string, file_id long, filename string, created_at long, raw_sha256 string"))
    got = {r["file_id"]: r for r in rows.collect()}
    kinds = {f: [x["type"] for x in r["findings"]] for f, r in got.items()}
    evidence = lambda f, kind: json.loads(next(x["evidence"] for x in got[f]["findings"] if x["type"] == kind))
    assert kinds[1][:3] == ["EXACT_DUPLICATE", "NEAR_DUPLICATE", "SUPERSEDED_VERSION"] and kinds[3][0] == "NEAR_DUPLICATE"
    assert evidence(1, "EXACT_DUPLICATE") == {"matchingFileIds": [2], "matches": 1}
    assert evidence(2, "SUPERSEDED_VERSION") == {"currentRevision": "Rev-B", "otherFileId": 1, "otherRevision": "Rev-A"}
    assert {m["file_id"] for m in evidence(3, "NEAR_DUPLICATE")["matches"]} == {1, 2}
    assert evidence(1, "HEADER_FOOTER_REMOVAL") == {"headers": ["ACME Works", "Issued for construction"], "footers": ["Printed copy"]}
    assert not {"EXACT_DUPLICATE", "NEAR_DUPLICATE", "SUPERSEDED_VERSION", "HEADER_FOOTER_REMOVAL"} & {*kinds[4], *kinds[5]}
    assert kinds[6][-1] == "CHUNK_TOO_SMALL" and "LOW_TEXT_VOLUME" in kinds[6]
    from millrace.functions.lexicon import DEDUCTIONS as cost

    for r in got.values():
        own = [x for x in r["findings"] if not x["type"].startswith("CHUNK")]
        chunk = len(r["findings"]) - len(own)
        score = max(0, min(100, 100 - sum(cost[x["severity"]] for x in own)))
        assert r["readiness"] == max(0, min(100, score - 3 * chunk))
        assert r["summary"].asDict() == {s: sum(x["severity"] == s for x in r["findings"]) for s in cost}
    assert got[1]["chunk_count"] > 1


# --- chunks: a plain version over one document ---

BREAK = re.compile(r"\n[^\S\n]*(?:" + "|".join(p.replace(r"\s+", r"[^\S\n]+") for p in SECTION_LINES) + ")", re.IGNORECASE | re.ASCII)


def plain_cut(text, longest, sections=True):
    out = []
    while text:
        head = text[:longest]
        if len(text) <= longest:
            end = len(text)
        elif sections and (m := BREAK.search(head, 1)):
            end = m.start()
        else:
            end = head.rfind(" ") if head.rfind(" ") > longest * 0.6 else longest
        out.append(text[:end].strip())
        text = text[end:]
    return [x for x in out if x]


def plain_chunks(pages, shortest=800, longest=1200, overlap=200, sections=True):
    done, held, span = [], "", []
    for number, text in pages:
        for piece in plain_cut((text or "").strip(), longest, sections):
            if held and len(held) >= shortest and len(held) + 1 + len(piece) > longest:
                done.append((held, min(span), max(span), len(held)))
                room = longest - len(piece) - 1
                tail = held[-overlap:].strip() if overlap else ""
                held, span = f"{tail[-room:] if room > 0 else ''} {piece}".strip(), [span[-1], number]
            else:
                held, span = f"{held} {piece}".strip(), [*span, number]
    return done + ([(held, min(span), max(span), len(held))] if held else [])


def native_chunks(spark, docs, **options):
    rows = [(i, [(n, t) for n, t in pages]) for i, pages in enumerate(docs)]
    df = spark.createDataFrame(rows, "id int, pages array<struct<page_number:int,text:string>>")
    made = df.select("id", chunking.chunks(F.col("pages"), **options).alias("c"))
    return [[tuple(x) for x in r["c"]] for r in made.orderBy("id").collect()]


def test_chunks_of_two_pages(spark):
    (made,) = native_chunks(spark, [[(1, "A" * 900), (2, "B" * 900)]])
    assert [(n, a, b) for _, a, b, n in made] == [(900, 1, 1), (1101, 1, 2)]


def test_sections_end_pieces_and_cutting_ends(spark):
    texts = ["intro " * 30 + "\nSECTION 2 next\n" + "word " * 600, "\nSECTION 1\n" + "x" * 3000, "x" * 2500, "", " \n\u2003"]
    got = [r["c"] for r in spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", chunking.cut(F.col("t")).alias("c")).orderBy("id").collect()]
    assert got[0][0] == ("intro " * 30).strip() and got[0][1].startswith("SECTION 2")
    assert got[2] == ["x" * 1200, "x" * 1200, "x" * 100] and got[3:] == [[], []]
    assert got == [plain_cut(t.strip(), 1200) for t in texts]


@pytest.mark.parametrize("options", [{}, {"shortest": 20, "longest": 50, "overlap": 10}, {"shortest": 0, "longest": 40, "overlap": 0}, {"shortest": 30, "longest": 45, "overlap": 60, "sections": False}])
def test_chunks_against_plain(spark, options):
    r = random.Random(8)
    marks = ["\nSECTION 2 of", "\n  Clause 4", "\nPART A", "\n1.2.3 Title", "\nB2.1", "\n", " ", "  ", "\u00a0", "😀é", "word", "longerword ", "x" * 30, "\t\r\n", "\nAPPENDIX", " 4"]
    text = lambda n: "".join(r.choice(marks) for _ in range(n))
    docs = [[(n, r.choice((None, "", text(r.randint(1, 40)), text(r.randint(100, 900))))) for n in range(1, r.randint(1, 6))] for _ in range(60)]
    docs += [[(2, "late"), (1, "early page"), (3, "x" * 5000)], [], [(1, text(20_000))]]
    assert native_chunks(spark, docs, **options) == [plain_chunks(d, **options) for d in docs]


def test_chunks_are_native(spark):
    df = spark.createDataFrame([("d", 1, "text")], "doc string, page_number int, text string")
    plan = chunking.chunk_documents(df, ["doc"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chunk_records(spark):
    df = spark.createDataFrame([("d", 2, "risk assessment " * 40), ("d", 1, "SWMS text"), ("e", 1, None)], "doc string, page_number int, text string")
    made = chunking.chunk_documents(df, ["doc"])
    rows = chunking.records(made, "doc", tenant=F.lit("t"), dataset=F.lit("s"), filename=F.lit("f"), created_at=F.lit("now"), model=F.lit("m"), source_uri=F.lit("")).collect()
    assert [r["chunk_id"] for r in rows] == ["d#p1#c0"] and rows[0]["doc_type"] == "swms"


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>, content_hash string, created_at long, doc_type string")


def test_new_rows_without_a_key_are_refused(spark):
    kept = chunk_table(spark, [("x", "old", [1.0], "h", 1, "rfi"), (None, "lost", [1.0], "h", 1, "rfi")])
    new = chunk_table(spark, [("x", "new", [2.0], "i", 2, "itp")])
    assert sorted(str(r["chunk_id"]) + r["text"] for r in vectors.upsert(kept, new).collect()) == ["Nonelost", "xnew"]
    with pytest.raises(Exception, match="without chunk_id"):
        vectors.upsert(kept, kept).collect()


def test_keyed_changes(spark):
    a = chunk_table(spark, [("x", "old", [1.0], "h", 1, "rfi"), ("y", "old", [1.0], "h", 1, "rfi")])
    b = chunk_table(spark, [("x", "new", [2.0], "i", 2, "itp"), ("z", "new", None, "i", 2, "itp")])
    got = {r["chunk_id"]: (r["text"], r["doc_type"]) for r in vectors.upsert(a, b).collect()}
    assert got == {"x": ("new", "rfi"), "y": ("old", "rfi"), "z": ("new", "itp")}
    assert {r["chunk_id"] for r in vectors.insert_absent(a, b).collect()} == {"x", "y"}
    assert vectors.delete_documents(a, a.where("chunk_id = 'x'"), ("chunk_id",)).count() == 1


def test_top_k(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None)], "chunk_id string, embedding array<float>")
    assert [(r["chunk_id"], r["score"]) for r in vectors.top_k(df, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    assert [vectors.clamp_k(k) for k in (0, 3.7, 50, "5", None, float("nan"), True)] == [1, 3, 20, 8, 8, 8, 8]
    got = spark.createDataFrame([("a b",), (None,)], "t string").select(vectors.checked(vectors.embed("t"), 1024).alias("v")).collect()
    assert len(got[0]["v"]) == 1024
    with pytest.raises(Exception, match="embedding size"):
        df.select(vectors.checked("embedding", 3)).collect()


def test_repair(spark):
    df = spark.createDataFrame([("c9", "", 1, 0, "hello"), (None, "d2", 1, 1, "  ")], "chunkId string, doc_id string, page int, chunk_index int, text string")
    lit = lambda v: F.lit(v)
    rows = vectors.repair(df, lit("t"), lit("s"), lit("d"), lit("u"), lit("f"), lit("now"), lit("m")).collect()
    assert [(r["chunk_id"], r["doc_id"], r["tenant_id"]) for r in rows] == [("c9", "d", "t")]


def test_citations(spark):
    rows = [("c1", "d1", None, 3, "x  y", "rfi", None, "Clause 4", None, 0.5), ("c2", "d1", "f.pdf", None, None, None, None, None, ["AS 1"], 0.9)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, filename string, page int, text string, doc_type string, discipline string, section_reference string, standards_referenced array<string>, score double")
    r = retrieval.citations(df).first()
    assert [c["chunk_id"] for c in r["citations"]] == ["c2", "c1"] and r["sources"] == "[S1] f.pdf\n\n\n[S2] source [RFI] p3 §Clause 4\nx y"
    assert retrieval.shaped(df).where("text = ''").count() == 1


def test_history(spark):
    df = spark.createDataFrame([(1, i, "system" if i == 0 else "user") for i in range(6)], "conv int, turn int, role string")
    assert [r["turn"] for r in retrieval.history(df, ["conv"], ["turn"], 3).orderBy("turn").collect()] == [1, 2]
    assert [r["turn"] for r in retrieval.history(df, ["conv"], ["turn"], 3, "recent").orderBy("turn").collect()] == [3, 4, 5]


def test_catalog(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, updated_at int")
    changes = spark.createDataFrame([(2, "c"), (3, "d")], "id int, s string")
    assert sorted(tuple(r) for r in catalog.update(t, changes, ["id"], F.lit(9)).collect()) == [(1, "a", 1), (2, "c", 9), (3, "d", 9)]
    assert catalog.update(t, changes.select("id"), ["id"]) is t
    assert sorted(r["s"] for r in catalog.put(t, spark.createDataFrame([(1, "z", 5)], t.schema), ["id"]).collect()) == ["b", "z"]
    log = catalog.audit(spark.createDataFrame([], "type string, event_id string"), spark.createDataFrame([("A",), ("A",)], "type string"))
    assert log.select("event_id").distinct().count() == 2
    d = spark.createDataFrame([("t", "x"), ("t", "y")], "tenant_id string, dataset_id string")
    f = spark.createDataFrame([("t", "x", "READY"), ("t", "x", "FAILED")], "tenant_id string, dataset_id string, status string")
    figures = catalog.dataset_figures(d, f)
    assert {r["dataset_id"]: r["total"] for r in figures.collect()} == {"x": 2, "y": 0} and catalog.totals(figures).first()["ready_percent"] == 50
    assert catalog.totals(figures.limit(0)).first()["ready_percent"] == 0


def test_states(one):
    ok = lambda kind, a, b: one(catalog.allowed(kind, F.lit(a).cast("string"), F.lit(b)))
    assert ok("file", None, "UPLOADED_PENDING") and ok("file", "FAILED", "PROCESSING") and not ok("file", "COMPLETE", "PROCESSING") and not ok("job", None, "RUNNING")


def test_eligibility(spark):
    df = spark.createDataFrame([("a", "READY"), ("b", "READY"), ("a", "INDEXING"), (None, None)], "tenant_id string, status string")
    assert [r[0] for r in df.select(retrieval.eligible(df, F.lit("a"))).collect()] == [200, 404, 409, 404]


def test_spread(spark, tmp_path):
    from millrace.session import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/few")
    few, many = spark.read.parquet(f"{tmp_path}/few"), spark.range(0, 100, 1, cores)
    assert spread(few).rdd.getNumPartitions() == cores and sorted(r.id for r in spread(few).collect()) == list(range(100))
    assert spread(many) is many


def test_simhash_of_long_and_odd_texts(spark):
    import hashlib

    def plain(words):
        h = [int(hashlib.md5(w.encode()).hexdigest()[16:], 16) for w in words]
        bits = sum(1 << i for i in range(64) if sum(1 if x >> i & 1 else -1 for x in h) >= 0) if h else 0
        return bits - (1 << 64) if bits >> 63 else bits

    words = {1: ["alpha", "beta"] * 70000 + ["gamma"], 2: ["alpha", "beta"], 3: [], 4: []}
    rows = [(i, " ".join(w) or ("- -" if i == 4 else None)) for i, w in words.items()]
    got = {r["i"]: r["simhash"] for r in duplicates.simhash(spark.createDataFrame(rows, "i int, text string"), ["i"]).collect()}
    assert got == {i: plain(w) for i, w in words.items()}


def test_small_predicates_and_shapes(spark, one):
    """Jobs of a dataset, active datasets, artifacts, keys, moments, nested hits, shown standards and turns."""
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "job long, dataset_id string")
    assert [r["job"] for r in catalog.of_dataset(jobs, F.lit("a")).collect()] == [1]
    files = spark.createDataFrame([("t", "a", "COMPLETE"), ("t", "a", "UPLOADED_PENDING"), ("t", "b", "FAILED"), ("t", "c", None)], "tenant_id string, dataset_id string, status string")
    assert {r["dataset_id"]: r["active"] for r in catalog.active(files).collect()} == {"a": True, "b": False, "c": False}
    stored = spark.createDataFrame([("t", "d", 1, "a.pdf", "k"), ("t", "d", 2, "a.pdf", ""), ("t", "d", 3, None, None)], "tenant_id string, dataset_id string, file_id long, filename string, raw_key string")
    assert [r[0] for r in stored.orderBy("file_id").select(catalog.raw_key()).collect()] == ["k", "raw/t/d/2/a.pdf", "raw/t/d/3/document.pdf"]
    moment = F.lit("2024-03-01 12:00:01.234").cast("timestamp")
    assert (one(catalog.iso(moment)), one(catalog.iso(moment, True))) == ("2024-03-01T12:00:01Z", "2024-03-01T12:00:01.234Z")
    assert spark.sql("SELECT map('x', 'k') AS artifacts").select(catalog.artifact("x"), catalog.artifact("y")).first() == ("k", None)
    hit = spark.sql("SELECT 'c' AS chunk_id, 'd' AS doc_id, 'f' AS filename, 1 AS page, 't' AS text, 'rfi' AS doc_type, null AS discipline, null AS section_reference, array('1', '2', '3', '4') AS standards_referenced, 0.5D AS score")
    row = retrieval.nested(hit).first()
    assert (row["_id"], row["_score"], row["_source"]["text"], row["_source"]["page"]) == ("c", 0.5, "t", 1)
    assert hit.select(retrieval.shown_standards(F.struct("standards_referenced"))).first()[0] == ["1", "2", "3"]
    asked = lambda n, before: one(retrieval.turn(F.lit("why"), F.lit("[S1] f"), F.lit(n), F.lit(before)))
    assert asked(1, 0)["prompt"] == "Question:\nwhy\n\nSources:\n[S1] f\n\nAnswer:" and asked(1, 0)["answer"] is None
    assert "user asks: why\n" in asked(0, 2)["prompt"] and asked(0, 0) == (None, retrieval.NO_ANSWER)


def test_retrieve(spark):
    rows = [("c1", "t", "d", [1.0, 0.0]), ("c2", "t", "d", [0.6, 0.8]), ("c3", "u", "d", [1.0, 0.0]), ("c4", "t", "e", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id string, tenant_id string, dataset_id string, embedding array<double>")
    df = df.withColumns({c: F.lit(None).cast(k) for c, k in vectors.HIT_KINDS.items() if c != "chunk_id"})
    asked = []
    found = retrieval.retrieve(df, "t", "d", " what does the RFI say ", lambda q: asked.append(q) or [1.0, 0.0], size=2)
    assert [(r["chunk_id"], r["score"]) for r in found.collect()] == [("c1", 1.0), ("c2", pytest.approx(0.6))]
    assert asked[0].startswith("what does the RFI say (")
    with pytest.raises(ValueError, match="size is not 1024 but 2"):
        retrieval.retrieve(df, "t", "d", "q", lambda q: [1.0, 0.0])
    with pytest.raises(ValueError, match="needed"):
        retrieval.retrieve(df, "t", "d", "  ", lambda q: [1.0, 0.0], size=2)


def test_upsert_of_repeated_keys(spark):
    old = chunk_table(spark, [("x", "old", [1.0], "h", 1, "rfi")])
    new = chunk_table(spark, [("x", "first", [2.0], "h", 2, "a"), ("x", "second", [3.0], "h", 3, "b"), ("n", "one", [1.0], "h", 1, "c"), ("n", "two", [1.0], "h", 4, "d")])
    got = {r["chunk_id"]: (r["text"], r["doc_type"]) for r in vectors.upsert(old, new).collect()}
    assert got == {"x": ("second", "rfi"), "n": ("two", "d")} and vectors.upsert(old, new).count() == 2


def test_missing_fields(spark):
    df = spark.createDataFrame([("d", "f.pdf", None), (" ", "", "x"), (None, "f", "x")], "dataset_id string, filename string, content_type string")
    assert [r[0] for r in df.select(catalog.missing_fields("file")).collect()] == [["content_type"], ["filename"], ["dataset_id"]]
    df = spark.createDataFrame([("d", "\n ",), ("d", "q")], "dataset_id string, query string")
    assert [r[0] for r in df.select(catalog.missing_fields("query")).collect()] == [["query"], []]


def test_sorted_datasets(spark):
    df = spark.createDataFrame([("b", 1), ("A", 3), (None, 2)], "name string, created_at long")
    names = lambda how: [r["name"] for r in catalog.sorted_datasets(df, how).collect()]
    assert (names("newest"), names("oldest"), names("name-asc"), names("name-desc")) == (["A", None, "b"], ["b", None, "A"], [None, "A", "b"], ["b", "A", None])


def test_all_near_fingerprints(spark):
    """Three of six parts join all pairs up to distance 3, wherever the bits differ."""
    import random

    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(40)]
    prints = sorted({b ^ sum(1 << i for i in r.sample(range(63), d)) for b in base for d in (0, 1, 2, 3, 4)})
    df = spark.createDataFrame([("t", i, "f", i, None, s) for i, s in enumerate(prints)], "tenant_id string, file_id long, filename string, created_at long, raw_sha256 string, simhash long")
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    got = [(x["a"], x["b"]) for x in duplicates.simhash_pairs(df).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_options(spark):
    from millrace import options

    assert options.of(spark) == options.Options() and options.of(spark, longest=900).chunking["longest"] == 900
    spark.conf.set("spark.millrace.top_k", "5")
    spark.conf.set("spark.millrace.sections", "false")
    try:
        got = options.of(spark, top_k=6)
        assert got.top_k == 6 and got.sections is False and options.of(spark).top_k == 5
    finally:
        spark.conf.unset("spark.millrace.top_k")
        spark.conf.unset("spark.millrace.sections")
    for wrong in ({"shortest": 2000}, {"top_k": 21}, {"visibility": "none"}, {"overlap": -1}):
        with pytest.raises(ValueError):
            options.Options(**wrong)


def test_requests_give_rows_once(spark):
    from millrace.operators import requests

    asked = spark.createDataFrame([(1, "t", " Works "), (2, "t", ""), (3, "u", None)], "request_id long, tenant_id string, name string")
    made = requests.create_datasets(asked, F.lit(5))
    assert {r["request_id"]: (r["code"], r["missing"], r["dataset_id"] is not None) for r in made.answers.collect()} == {1: (201, [], True), 2: (400, ["name"], False), 3: (400, ["name"], False)}
    (row,) = made.rows.collect()
    assert (row["name"], row["status"], row["created_at"]) == ("Works", "UPLOADED", 5) and made.rows.collect() == requests.create_datasets(asked, F.lit(5)).rows.collect()
    assert [r["metadata"] for r in made.events.collect()] == [{"datasetId": row["dataset_id"], "name": "Works"}]
    files = spark.createDataFrame([(1, "t", row["dataset_id"], "a.pdf", "x"), (2, "t", row["dataset_id"], "b.pdf", "x"), (3, "u", row["dataset_id"], "c.pdf", "x"), (4, "t", None, "d.pdf", "x")], "request_id long, tenant_id string, dataset_id string, filename string, content_type string")
    got = requests.presign(files, made.rows, F.lit(6))
    assert {r["request_id"]: r["code"] for r in got.answers.collect()} == {1: 200, 2: 200, 3: 404, 4: 400}
    assert got.rows.count() == got.events.count() == 2 and [tuple(r) for r in got.datasets.collect()] == [("t", row["dataset_id"], "UPLOADED", 6)]
    assert all(r["raw_key"] == f"raw/t/{r['dataset_id']}/{r['file_id']}/{r['filename']}" for r in got.rows.collect())


def test_models_get_bounded_numbers_of_texts(spark):
    def size_of(texts):  # each vector says how many texts the model got at once
        return [[float(len(texts))]] * len(texts)

    df = spark.range(0, 1000, 1, 1).select(vectors.embed(F.col("id").cast("string"), size_of).alias("v"))
    sizes = [r["v"][0] for r in df.collect()]
    assert len(sizes) == 1000 and max(sizes) <= 256


def test_pages_are_prepared_once(spark, tmp_path):
    from millrace.plans.readiness import prepare

    spark.createDataFrame([("t", "a", 1, "one two"), ("t", "a", 2, "three")], "tenant_id string, file_id string, page_number int, text string").write.parquet(str(tmp_path / "rawpages"))
    files = spark.createDataFrame([("t", "a", "a.pdf", 1, "x"), ("t", "b", "b.pdf", 2, "y")], "tenant_id string, file_id string, filename string, created_at int, raw_sha256 string")
    made = prepare(spark.read.parquet(str(tmp_path / "rawpages")), files)
    assert not any("rawpages" in f for f in made.inputFiles())  # they are read before, for the fingerprints and the texts together
    assert {r["file_id"]: r["text"] for r in made.collect()} == {"a": "one two\n\nthree", "b": ""}
