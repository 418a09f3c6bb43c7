"""Queries of the driver's tables, each with the SQL that it is held against.

The tables have no construction vocabulary, so some queries put words into the texts by a rule that both sides share: DECOR, a
SQL expression. Roles: documents are files or pages (source: tenant; doc_id: file, and recency), embeddings are chunks (label:
dataset), conversations are messages, events are the audit log, orders and customers are keyed rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import construction as C
from millrace.functions import lexicon as L
from millrace.functions import text as X
from millrace.operators import catalog, chunking, duplicates, pages, quality, requests, retrieval, search, status, vector_index, vectors
from millrace.session import shared_dir, spread, stored
from millrace.streaming.held import Held

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LF = "chr(10)"
DECOR = f"""(CASE CAST(doc_id % 11 AS INT)
 WHEN 0 THEN 'SECTION 3.2 General conditions of contract AS/NZS 3000:2018 and NCC 2022, Rev B of 3 March 2021. '
 WHEN 1 THEN 'Safe work method statement SWMS with risk assessment, 12/05/2020, electrical switchboard MCC. '
 WHEN 2 THEN 'DWG-1042 drawing number A-101 reinforcement and concrete to AS 3600 , AS 1170.2:2021 issue 4 '
 WHEN 3 THEN 'Technical specification , division 15: HVAC ductwork ventilation 2021-07-30 version 2.1 '
 WHEN 4 THEN 'mid-' || {LF} || 'dle par-' || {LF} || 'tial AS-' || {LF} || 'New pa-' || {LF} || 'rt SW-' || {LF} || 'MS  two   spaces' || chr(9) || 'tab' || chr(13) || {LF} || {LF} || {LF} || {LF} || 'end '
 WHEN 5 THEN 'Request for information RFI-12 TQ 7 plumbing drainage stormwater AS/ NZS 3500.1 May 2019 '
 WHEN 6 THEN 'Minutes of meeting, site meeting: progress claim no. 4 glazing and flooring amendment-2 ' || {LF} || '4.1.2 Scope of works '
 WHEN 7 THEN 'Inspection and test plan ITP hold points witness point fire sprinkler hydrant APPENDIX C [[[[ |||| '
 ELSE '' END || coalesce(text, ''))"""
NAME = """(source || CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '_Rev-A.pdf' WHEN 1 THEN '_Rev-B.pdf' WHEN 2 THEN ' v2.1.pdf' WHEN 3 THEN '-issue_3.dwg' WHEN 4 THEN '-amendment 2.pdf' ELSE '.pdf' END)"""
ORACLE_DECOR = f"SELECT doc_id, lang, source, {DECOR} AS text, {NAME} AS filename FROM documents"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "conversations") else rows


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(DECOR).alias("text"), F.expr(NAME).alias("filename"))


def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# --- SQL that mirrors the column functions, in the oracle's dialect ---


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def s_clean(x: str) -> str:
    hyphens = X.HYPHENS.replace("\\n", "\n")
    joined = f"regexp_replace({x}, {lit(hyphens)}, '\\1\\2\\3', 'g')"
    lines = f"regexp_replace(regexp_replace({joined}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return s_strip(f"regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def s_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '')"


def s_first(candidates: list[tuple[str, str]]) -> str:
    return "coalesce(" + ", ".join(f"nullif({s_strip(f'regexp_extract({c}, {lit(p)}, 0)')}, '')" for c, p in candidates) + ")"


def s_count(x: str, patterns: list[str], flags: str = "(?i)") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, {lit(flags + p)}))" for p in patterns) + ")"


def s_revision(name: str, text: str | None = None) -> str:
    return s_first([(c, p) for c in [name, *([f"substr({text}, 1, 2000)"] if text else [])] for p in L.REVISION_PATTERNS])


def s_base(name: str) -> str:
    for p in L.NAME_SUFFIXES:
        name = f"regexp_replace({name}, {lit(p)}, '', 'g')"
    return s_strip(name)


def s_date(x: str) -> str:
    return s_first([(f"substr({x}, 1, 3000)", f"(?i){p}") for p in L.DATE_PATTERNS])


def s_drawing(x: str, name: str) -> str:
    return "(" + " OR ".join([f"regexp_matches({name}, {lit(L.DRAWING_NAME)})", *(f"regexp_matches(substr({x}, 1, 2000), {lit('(?i)' + p)})" for p in L.DRAWING_PATTERNS)]) + ")"


def s_garbled(x: str) -> str:
    words = f"len(list_filter(regexp_split_to_array(substr({x}, 1, 5000), '\\s+'), lambda x: x <> ''))"
    return f"(CASE WHEN {words} = 0 THEN 0.0 ELSE {s_count(f'substr({x}, 1, 5000)', L.GARBLED_PATTERNS, '')}::DOUBLE / {words} END)"


def s_standards(x: str) -> str:
    found = " || ".join(f"regexp_extract_all({x}, {lit('(?i)' + p)})" for p in L.STANDARD_PATTERNS)
    spelt = "replace(regexp_replace(upper(" + s_strip("s") + "), '\\s+', ' ', 'g'), '/ ', '/')"
    return f"list_sort(list_distinct(list_transform({found}, lambda s: {spelt})))"


def s_best(x: str, table: dict[str, list[str]]) -> tuple[str, str]:
    """Columns k0, k1, ...; and the name of the greatest one, the first of equals."""
    cols = ", ".join(f"{s_count(x, p)} AS k{i}" for i, p in enumerate(table.values()))
    top = f"greatest({', '.join(f'k{i}' for i in range(len(table)))})"
    return cols, f"CASE WHEN {top} = 0 THEN NULL " + " ".join(f"WHEN k{i} = {top} THEN {lit(n)}" for i, n in enumerate(table)) + " END"


def s_snippet(x: str, n: int) -> str:
    c = s_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    return f"(CASE WHEN length({c}) <= {n} THEN {c} ELSE {s_strip(f'left({c}, {n})')} || '...' END)"


# --- text ---


@query("clean_text", f"WITH d AS ({ORACLE_DECOR}) SELECT doc_id, {s_clean('text')} AS text, len({s_lines(s_clean('text'))}) AS n_lines FROM d")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pages.clean_pages(decorated(spark, sf_dir))
    return docs.select("doc_id", "text", F.size(X.split_lines("text")).cast("long").alias("n_lines"))


@query("extraction_stats", f"""WITH d AS ({ORACLE_DECOR}), s AS (SELECT doc_id, text, {s_lines('text')} AS l FROM d)
SELECT doc_id, length(text)::INTEGER AS text_length, CASE WHEN text = '' THEN 1.0 ELSE round(length(regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g'))::DOUBLE / length(text), 4) END AS non_alpha_ratio,
 CASE WHEN len(l) = 0 THEN 0.0 ELSE round(1 - len(list_distinct(l))::DOUBLE / len(l), 4) END AS repeated_line_ratio FROM s""")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.extraction_stats("text")
    return decorated(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", "s.text_length", "s.non_alpha_ratio", "s.repeated_line_ratio")


PAGED = f"""SELECT source, doc_id AS page_number, 'ACME Works ' || source || {LF} || 'Page of the file' || {LF} || coalesce(text, '') || {LF} || CASE WHEN doc_id % 10 < 7 THEN 'Printed copies are uncontrolled' ELSE 'x' END || {LF} || 'Issued for review' AS text FROM documents"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("_millrace_documents")
    return spark.sql(PAGED.replace("FROM documents", "FROM _millrace_documents"))


@query("repeated_edges", f"""WITH p AS (SELECT source, {s_lines('text')} AS l FROM ({PAGED})), t AS (SELECT source, count(*) AS pages FROM p GROUP BY 1),
e AS (SELECT source, 'header' AS kind, unnest(l[1:2]) AS line FROM p UNION ALL SELECT source, 'footer', unnest(l[greatest(len(l) - 1, 1):len(l)]) FROM p)
SELECT source, kind, line, count(*) AS n FROM e JOIN t USING (source) WHERE length(line) > 3 GROUP BY source, kind, line, pages HAVING count(*) >= greatest(2, floor(pages * 0.6::DOUBLE))""")
def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.repeated_edges(_paged(spark, sf_dir), ["source"])


@query("boilerplate", f"""WITH p AS (SELECT source, list_distinct({s_lines('text')}) AS l FROM ({PAGED})), t AS (SELECT source, count(*) AS pages FROM p GROUP BY 1), e AS (SELECT source, unnest(l) AS line FROM p)
SELECT source, line, count(*) AS n FROM e JOIN t USING (source) WHERE length(line) > 4 GROUP BY source, line, pages HAVING count(*) >= greatest(2, floor(pages * 0.7::DOUBLE))""")
def boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.boilerplate(_paged(spark, sf_dir), ["source"])


@query("normalized_pages", f"""WITH c AS (SELECT source, page_number, {s_clean('text')} AS text FROM ({PAGED})), p AS (SELECT source, page_number, text, {s_lines('text')} AS l FROM c),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY 1),
e AS (SELECT source, 'h' AS kind, unnest(l[1:2]) AS line FROM p UNION ALL SELECT source, 'f', unnest(l[greatest(len(l) - 1, 1):len(l)]) FROM p),
g AS (SELECT source, line FROM e JOIN t USING (source) WHERE length(line) > 3 GROUP BY source, kind, line, pages HAVING count(*) >= greatest(2, floor(pages * 0.6::DOUBLE))
 UNION SELECT source, line FROM (SELECT source, unnest(list_distinct(l)) AS line FROM p) JOIN t USING (source) WHERE length(line) > 4 GROUP BY source, line, pages HAVING count(*) >= greatest(2, floor(pages * 0.7::DOUBLE))),
r AS (SELECT source, list(line) AS gone FROM g GROUP BY 1)
SELECT source, page_number, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x: NOT list_contains(gone, x)), chr(10)) END AS text FROM p LEFT JOIN r USING (source)""")
def normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.normalize_pages(_paged(spark, sf_dir), ["source"]).select("source", "page_number", "text")


@query("content_hashes", f"""SELECT doc_id, sha256(coalesce(text, '')) AS raw_sha256, doc_id || '#p' || (doc_id % 7) || '#c' || (doc_id % 3) AS chunk_id,
 sha256(doc_id || '|' || (doc_id % 7) || '|' || (doc_id % 3) || '|' || {s_strip("regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')")}) AS content_hash FROM documents""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"text": F.coalesce("text", F.lit("")), "page": F.col("doc_id") % 7, "i": F.col("doc_id") % 3})
    return docs.select("doc_id", F.sha2("text", 256).alias("raw_sha256"), X.chunk_id("doc_id", "page", "i").alias("chunk_id"), X.content_hash("doc_id", "page", "i", "text").alias("content_hash"))


@query("snippets", f"SELECT item_id, {s_snippet('text', 260)} AS snippet, left(text, 60) AS title FROM benchmark")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.snippet("text", 260).alias("snippet"), retrieval.title(F.col("text")).alias("title"))


# --- what texts say of themselves ---

_KINDS, _KIND = s_best("substr(text, 1, 5000)", L.DOCUMENT_TYPES)
_KIND_SUM = " + ".join(f"k{i}" for i in range(len(L.DOCUMENT_TYPES)))
_KIND_TOP = "greatest(" + ", ".join(f"k{i}" for i in range(len(L.DOCUMENT_TYPES))) + ")"
_TRADES, _TRADE = s_best("substr(text, 1, 10000)", L.DISCIPLINES)


@query("document_types", f"WITH d AS (SELECT doc_id, {_KINDS} FROM ({ORACLE_DECOR})) SELECT doc_id, coalesce({_KIND}, 'general') AS doc_type, CASE WHEN {_KIND_SUM} = 0 THEN 0.0 ELSE round({_KIND_TOP}::DOUBLE / ({_KIND_SUM}), 3) END AS confidence FROM d")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", C.document_type("text").alias("k")).select("doc_id", "k.*")


@query("disciplines", f"WITH d AS (SELECT doc_id, {_TRADES} FROM ({ORACLE_DECOR})) SELECT doc_id, {_TRADE} AS discipline FROM d")
def disciplines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", C.discipline("text").alias("discipline"))


_REFS = s_first([("substr(text, 1, 500)", f"(?im){p}") for p in L.SECTION_REFERENCES])


@query("references", f"""WITH d AS ({ORACLE_DECOR}) SELECT doc_id, {s_revision('filename', 'text')} AS revision, {s_date('text')} AS document_date, {s_base('filename')} AS base_name, {s_drawing('text', 'filename')} AS is_drawing,
 round({s_garbled('text')}, 4) AS garbled_ratio, {_REFS} AS section_reference, array_to_string({s_standards('text')}, ';') AS standards FROM d""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select(
        "doc_id", C.revision("filename", "text").alias("revision"), C.document_date("text").alias("document_date"), C.base_name("filename").alias("base_name"), C.is_drawing("text", "filename").alias("is_drawing"),
        F.round(C.garbled_ratio("text"), 4).alias("garbled_ratio"), C.section_reference("text").alias("section_reference"), F.array_join(C.standards("text"), ";").alias("standards"),
    )


_TITLES = "(VALUES " + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in L.STANDARDS.items()) + ") AS t(k, v)"
_NAMES = "(VALUES " + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in L.ABBREVIATIONS.items()) + ") AS t(k, v)"


@query("standard_titles", f"""WITH s AS (SELECT DISTINCT unnest({s_standards('text')}) AS standard FROM ({ORACLE_DECOR})), n AS (SELECT standard, regexp_replace(standard, ':\\d{{4}}$', '') AS k FROM s)
SELECT standard, coalesce(a.v, b.v) AS title FROM n LEFT JOIN (SELECT * FROM {_TITLES}) a ON n.k = a.k LEFT JOIN (SELECT * FROM {_TITLES}) b ON regexp_replace(n.k, '\\.\\d+$', '') = b.k""")
def standard_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decorated(spark, sf_dir).select(F.explode(C.standards("text")).alias("standard")).distinct()
    return found.select("standard", C.standard_title("standard").alias("title"))


_ABBR = f"element_at(array({', '.join(lit(a) for a in L.QUERY_ABBREVIATIONS)}), CAST((conv_id + turn) % {len(L.QUERY_ABBREVIATIONS)} AS INT) + 1)"
_DUCK_ABBR = _ABBR.replace("element_at(array(", "list_extract(list_value(")
_EXPANDED = "CASE " + " ".join(f"WHEN regexp_matches(q, '(?i)\\b{a}\\b') THEN q || {lit(' (' + L.ABBREVIATIONS[a] + ')')}" for a in L.QUERY_ABBREVIATIONS) + " ELSE q END"


@query("query_expansion", f"""WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'what is ' || lower({_DUCK_ABBR}) || ' here? ' ELSE '' END || text AS q, {_DUCK_ABBR} AS a FROM conversations)
SELECT conv_id, turn, {_EXPANDED} AS expanded, v AS full_name FROM q LEFT JOIN {_NAMES} ON a = k""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("a", F.expr(_ABBR))
    q = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("what is "), F.lower("a"), F.lit(" here? "))).otherwise(F.lit("")), F.col("text"))
    return rows.select("conv_id", "turn", C.expand_query(q).alias("expanded"), C.abbreviation(F.lower("a")).alias("full_name"))


# --- fingerprints and duplicates ---

_PRINTS = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(t), 17, 16))::UBIGINT AS h, count(*) AS n FROM tok GROUP BY doc_id, t),
v AS (SELECT doc_id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1::UBIGINT = 1 THEN n ELSE -n END) AS v FROM h, range(64) r(i) GROUP BY doc_id, i),
fp AS (SELECT d.doc_id, d.lang, coalesce(f.s, 0::UBIGINT) AS s FROM documents d LEFT JOIN (SELECT doc_id, bit_or(CASE WHEN v >= 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS s FROM v GROUP BY doc_id) f USING (doc_id))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the language is the tenant, a greater id is newer."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("lang").alias("tenant_id"), "source", F.col("doc_id").alias("file_id"), F.expr(NAME).alias("filename"), F.col("doc_id").alias("created_at"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("raw_sha256"), F.coalesce("text", F.lit("")).alias("text"))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return files.join(duplicates.simhash(files, ["file_id"]), "file_id")


@query("simhash", f"WITH {_PRINTS} SELECT doc_id, s::VARCHAR AS simhash FROM fp")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.simhash(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", X.unsigned("simhash").alias("simhash"))


@query("exact_duplicates", """WITH f AS (SELECT lang AS tenant_id, doc_id AS file_id, sha256(coalesce(text, '')) AS h FROM documents), g AS (SELECT tenant_id, h, min(file_id) AS group_id, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) > 1)
SELECT tenant_id, file_id, group_id, n - 1 AS matches FROM f JOIN g USING (tenant_id, h)""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_duplicates(_files(spark, sf_dir)).drop("match_ids")


_RECENT = "recent AS (SELECT lang, doc_id, s, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM fp QUALIFY r <= 50)"


@query("near_duplicates_recent", f"""WITH {_PRINTS}, {_RECENT}
SELECT f.lang AS tenant_id, f.doc_id AS file_id, count(*)::INTEGER AS matches, array_to_string((list(o.doc_id ORDER BY o.r))[1:5], ',') AS near FROM fp f JOIN recent o ON f.lang = o.lang AND f.doc_id <> o.doc_id AND bit_count(xor(f.s, o.s)) <= 3 GROUP BY 1, 2""")
def near_duplicates_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates.near_duplicates(_printed(spark, sf_dir))
    return found.select("tenant_id", "file_id", "matches", F.array_join(F.transform("near", lambda r: r["file_id"].cast("string")), ",").alias("near"))


@query("simhash_pairs", f"""WITH {_PRINTS}, u AS (SELECT DISTINCT lang, s FROM fp)
SELECT a.lang AS tenant_id, least(a.s::VARCHAR, b.s::VARCHAR) AS a, greatest(a.s::VARCHAR, b.s::VARCHAR) AS b, bit_count(xor(a.s, b.s))::INTEGER AS distance FROM u a JOIN u b ON a.lang = b.lang AND a.s < b.s AND bit_count(xor(a.s, b.s)) <= 3""")
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = duplicates.simhash_pairs(_printed(spark, sf_dir)).withColumns({"a": X.unsigned("a"), "b": X.unsigned("b")})
    return p.select("tenant_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("distance").cast("int").alias("distance"))


@query("superseded", f"""WITH f AS (SELECT lang, doc_id, {NAME} AS filename, coalesce(text, '') AS text FROM documents), k AS (SELECT *, lower({s_base('filename')}) AS base, {s_revision('filename')} AS rev, {s_revision('filename', 'text')} AS own FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM k QUALIFY r <= 50)
SELECT a.lang AS tenant_id, a.doc_id AS file_id, a.own AS revision, arg_min(b.doc_id, b.r) AS other_file_id, arg_min(b.rev, b.r) AS other_revision FROM k a JOIN n b ON a.lang = b.lang AND a.doc_id <> b.doc_id AND a.base = b.base AND b.rev IS NOT NULL AND b.rev <> a.own
WHERE a.own IS NOT NULL AND a.base <> '' GROUP BY 1, 2, 3""")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.superseded(_files(spark, sf_dir), "text")


@query("exact_duplicates_as_of", """WITH f AS (SELECT lang AS tenant_id, doc_id AS file_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT tenant_id, file_id, first_value(file_id) OVER w AS group_id, row_number() OVER w - 1 AS matches, array_to_string((list(file_id) OVER (PARTITION BY tenant_id, h ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))[1:5], ',') AS match_ids
FROM f WINDOW w AS (PARTITION BY tenant_id, h ORDER BY file_id) QUALIFY matches > 0""")
def exact_duplicates_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates.exact_duplicates(_files(spark, sf_dir), visibility="as_of")
    return found.withColumns({"matches": F.col("matches").cast("long"), "match_ids": F.array_join(F.col("match_ids").cast("array<string>"), ",")})


@query("near_duplicates_as_of", f"""WITH {_PRINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM fp)
SELECT f.lang AS tenant_id, f.doc_id AS file_id, count(*)::INTEGER AS matches, array_to_string((list(o.doc_id ORDER BY o.n DESC))[1:5], ',') AS near FROM n f JOIN n o ON f.lang = o.lang AND o.n BETWEEN f.n - 49 AND f.n - 1 AND bit_count(xor(f.s, o.s)) <= 3 GROUP BY 1, 2""")
def near_duplicates_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates.near_duplicates(_printed(spark, sf_dir), visibility="as_of")
    return found.select("tenant_id", "file_id", "matches", F.array_join(F.transform("near", lambda r: r["file_id"].cast("string")), ",").alias("near"))


@query("superseded_as_of", f"""WITH f AS (SELECT lang, doc_id, {NAME} AS filename, coalesce(text, '') AS text FROM documents), k AS (SELECT *, lower({s_base('filename')}) AS base, {s_revision('filename')} AS rev, {s_revision('filename', 'text')} AS own, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM f)
SELECT a.lang AS tenant_id, a.doc_id AS file_id, a.own AS revision, arg_max(b.doc_id, b.n) AS other_file_id, arg_max(b.rev, b.n) AS other_revision FROM k a JOIN k b ON a.lang = b.lang AND b.n BETWEEN a.n - 49 AND a.n - 1 AND a.base = b.base AND b.rev IS NOT NULL AND b.rev <> a.own
WHERE a.own IS NOT NULL AND a.base <> '' GROUP BY 1, 2, 3""")
def superseded_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.superseded(_files(spark, sf_dir), "text", visibility="as_of")


@query("newest_files", "SELECT lang AS tenant_id, doc_id AS file_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC)::INTEGER AS recency FROM documents QUALIFY recency <= 50")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.newest(_files(spark, sf_dir)).select("tenant_id", "file_id", "recency")


# --- quality ---

_SHORT = "length(text) < 300"
_RULES = {
    "DRAWING_LOW_TEXT": ("INFO", f"{_SHORT} AND drawing"),
    "LOW_TEXT_VOLUME": ("WARN", f"{_SHORT} AND NOT drawing"),
    "POOR_OCR_QUALITY": ("CRITICAL", "garbled > 0.1::DOUBLE"),
    "HIGH_NON_ALPHA_RATIO": ("WARN", "alpha > 0.5"),
    "REPEATED_LINES": ("WARN", "repeated > 0.4"),
    "MISSING_DATE": ("INFO", "ddate IS NULL"),
    "MISSING_REVISION": ("INFO", f"rev IS NULL AND NOT drawing AND kind IN ({', '.join(lit(k) for k in L.REVISED_TYPES)})"),
    "STANDARDS_REFERENCED": ("INFO", "len(standards) > 0"),
}
_FINDINGS = f"""d AS ({ORACLE_DECOR}), e AS (SELECT doc_id, source, filename, text AS raw, {s_clean('text')} AS text FROM d), k AS (SELECT *, {_KINDS} FROM e),
q AS (SELECT doc_id, source, raw AS text, {s_drawing('text', 'filename')} AS drawing, {s_garbled('text')} AS garbled, {s_date('text')} AS ddate, {s_revision('filename', 'text')} AS rev, {_KIND} AS kind, {s_standards('text')} AS standards,
 CASE WHEN raw = '' THEN 1.0 ELSE round(length(regexp_replace(raw, '[A-Za-z0-9\\s]', '', 'g'))::DOUBLE / length(raw), 4) END AS alpha,
 CASE WHEN len({s_lines('raw')}) = 0 THEN 0.0 ELSE round(1 - len(list_distinct({s_lines('raw')}))::DOUBLE / len({s_lines('raw')}), 4) END AS repeated FROM k),
r AS (SELECT doc_id, source, list_filter([{', '.join(f"CASE WHEN {w} THEN '{k}' END" for k, (_, w) in _RULES.items())}], lambda x: x IS NOT NULL) AS types,
 greatest(0, least(100, 100 - ({' + '.join(f'CASE WHEN {w} THEN {L.DEDUCTIONS[s]} ELSE 0 END' for s, w in _RULES.values())}))) AS readiness,
 {', '.join(f"({' + '.join([f'CASE WHEN {w} THEN 1 ELSE 0 END' for s, w in _RULES.values() if s == sev] or ['0'])}) AS {sev.lower()}" for sev in L.DEDUCTIONS)} FROM q)"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each file alone: stats of the raw text, the rest of the cleaned one."""
    docs = decorated(spark, sf_dir).withColumn("stats", X.extraction_stats("text"))
    docs = quality.with_facts(pages.clean_pages(docs))
    found = F.array_compact(F.array(*quality.text_findings(F.col("stats"))))
    return docs.select("doc_id", "source", found.alias("findings"))


@query("quality_findings", f"WITH {_FINDINGS} SELECT doc_id, array_to_string(types, ',') AS types, readiness::INTEGER AS readiness, critical::INTEGER AS critical, warn::INTEGER AS warn, info::INTEGER AS info FROM r")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("findings")
    rows = _assessed(spark, sf_dir).select("doc_id", F.array_join(F.transform(f, lambda x: x["type"]), ",").alias("types"), quality.readiness(f).alias("readiness"), quality.summary(f).alias("s"))
    return rows.select("doc_id", "types", "readiness", *(F.col(f"s.{s}").alias(s.lower()) for s in L.DEDUCTIONS))


@query("readiness_by_source", f"WITH {_FINDINGS} SELECT source, count(*) AS files, round(avg(readiness), 4) AS mean_readiness, count(*) FILTER (WHERE readiness >= 80) AS ready FROM r GROUP BY source")
def readiness_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _assessed(spark, sf_dir).select("source", quality.readiness(F.col("findings")).alias("readiness"))
    return scored.groupBy("source").agg(F.count("*").alias("files"), F.round(F.avg("readiness"), 4).alias("mean_readiness"), F.count_if(F.col("readiness") >= 80).alias("ready"))


@query("findings_by_severity", f"""WITH {_FINDINGS}, x AS (SELECT source, unnest(types) AS type FROM r), y AS (SELECT source, type, CASE type {' '.join(f"WHEN '{k}' THEN '{s}'" for k, (s, _) in _RULES.items())} END AS severity FROM x)
SELECT source, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END::BIGINT AS rank, severity, array_to_string(list_sort(list_distinct(list(type))), ',') AS types, count(*) AS n FROM y GROUP BY source, severity""")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the outer form: for the inner one Spark would test the array's size first, and look for all patterns twice
    rows = _assessed(spark, sf_dir).select("source", F.explode_outer("findings").alias("f")).where("f IS NOT NULL").select("source", "f.type", "f.severity")
    return catalog.by_severity(rows, ["source"]).withColumns({"types": F.array_join("types", ","), "rank": F.col("rank").cast("long")})


# --- chunks ---


#: Files of several pages, each with a heading and a last line of its file's own.
FILED = f"""SELECT doc_id, source, filename, page_number, 'ACME Works ' || source || {LF} || 'Issued for construction' || {LF} || substr(text, (page_number - 1) * 2500 + 1, 2500) || {LF} || 'Printed ' || filename AS text
 FROM (SELECT *, CAST(unnest(range(1, 1 + greatest(1, (length(text) + 2499) // 2500))) AS INT) AS page_number FROM ({ORACLE_DECOR}))"""


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decorated(spark, sf_dir).withColumn("page_number", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length("text") / 2500).cast("int")))))
    text = F.concat(F.lit("ACME Works "), "source", F.lit("\nIssued for construction\n"), F.substring("text", (F.col("page_number") - 1) * 2500 + 1, F.lit(2500)), F.lit("\nPrinted "), "filename")
    return docs.select("doc_id", "source", "filename", "page_number", text.alias("text"))


_BREAK = "(?i)\\n[^\\S\\n]*(?:" + "|".join(p.replace(r"\s+", r"[^\S\n]+") for p in L.SECTION_LINES) + ")"
_AFTER = "substr(left(rest, 1200), 2)"
_SPACE = "length(regexp_extract(left(rest, 1200), '(?s)^(.*) ', 1))"
_CLOSES = "(held <> '' AND length(held) >= 800 AND length(held) + 1 + length(piece) > 1200)"
_TAIL = f"CASE WHEN 1199 - length(piece) > 0 THEN right({s_strip('right(held, 200)')}, 1199 - length(piece)) ELSE '' END"
#: Cuts each page, and folds a document's pieces into chunks: doc_id, chunk_index, text, page_start, page_end.
_CHUNKS = f"""RECURSIVE pg AS ({FILED}),
c AS (SELECT doc_id, page_number, 0 AS k, ''::VARCHAR AS piece, {s_strip('text')} AS rest FROM pg
 UNION ALL SELECT doc_id, page_number, k + 1, {s_strip('left(rest, e)')}, substr(rest, e + 1) FROM (SELECT *, CASE WHEN length(rest) <= 1200 THEN length(rest)
  WHEN regexp_matches({_AFTER}, {lit(_BREAK)}) THEN strpos({_AFTER}, regexp_extract({_AFTER}, {lit(_BREAK)})) WHEN {_SPACE} > 720 THEN {_SPACE} ELSE 1200 END AS e FROM c WHERE rest <> '')),
p AS (SELECT doc_id, page_number AS page, piece, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, k) AS i FROM c WHERE piece <> ''),
f AS (SELECT doc_id, 0::BIGINT AS i, ''::VARCHAR AS held, 0 AS a, 0 AS z, 0 AS last, NULL::VARCHAR AS done, 0 AS done_a, 0 AS done_z FROM (SELECT DISTINCT doc_id FROM p)
 UNION ALL SELECT p.doc_id, p.i, CASE WHEN {_CLOSES} THEN {s_strip(f"({_TAIL}) || ' ' || piece")} ELSE {s_strip("held || ' ' || piece")} END,
  CASE WHEN {_CLOSES} THEN least(last, page) WHEN a = 0 THEN page ELSE least(a, page) END, CASE WHEN {_CLOSES} THEN greatest(last, page) ELSE greatest(z, page) END, page,
  CASE WHEN {_CLOSES} THEN held END, a, z FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
e AS (SELECT doc_id, i, done AS text, done_a AS page_start, done_z AS page_end FROM f WHERE done IS NOT NULL
 UNION ALL SELECT doc_id, i + 1, held, a, z FROM f WHERE held <> '' AND i = (SELECT max(i) FROM p WHERE p.doc_id = f.doc_id)),
ch AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, text, page_start::INTEGER AS page_start, page_end::INTEGER AS page_end, length(text)::INTEGER AS length FROM e)"""


@query("chunks", f"WITH {_CHUNKS} SELECT doc_id, chunk_index, text, page_start, page_end, length FROM ch")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_filed(spark, sf_dir), ["doc_id"])


_RECORDS = f"""{_CHUNKS}, m AS (SELECT *, {_KINDS} FROM ch), t AS (SELECT doc_id AS t_doc, chunk_index AS t_index, {_TRADES} FROM ch),
rec AS (SELECT 't' AS tenant_id, 'd' AS dataset_id, doc_id::VARCHAR AS doc_id, '' AS source_uri, 'f.pdf' AS filename, page_start AS page, doc_id || '#p' || page_start || '#c' || chunk_index AS chunk_id, chunk_index, text,
 '2024-01-01T00:00:00Z' AS created_at, 'hashed' AS embedding_model, sha256(doc_id || '|' || page_start || '|' || chunk_index || '|' || {s_strip("regexp_replace(text, '\\s+', ' ', 'g')")}) AS content_hash, '' AS acl,
 coalesce({_KIND}, 'general') AS doc_type, CASE WHEN {_KIND_SUM} = 0 THEN 0.0 ELSE round({_KIND_TOP}::DOUBLE / ({_KIND_SUM}), 3) END AS doc_type_confidence,
 (SELECT {_TRADE} FROM t WHERE t_doc = m.doc_id AND t_index = m.chunk_index) AS discipline, array_to_string({s_standards('text')}, ';') AS standards_referenced, {_REFS} AS section_reference, page_end FROM m)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.records(chunks(spark, sf_dir), "doc_id", tenant=F.lit("t"), dataset=F.lit("d"), filename=F.lit("f.pdf"), created_at=F.lit("2024-01-01T00:00:00Z"), model=F.lit("hashed"), source_uri=F.lit(""))


@query("chunk_records", f"WITH {_RECORDS} SELECT * EXCLUDE (page_end) FROM rec")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumns({"acl": F.array_join("acl", ";"), "standards_referenced": F.array_join("standards_referenced", ";")})


@query("chunk_warnings", f"WITH {_CHUNKS} SELECT doc_id, CASE WHEN length < 500 THEN 'CHUNK_TOO_SMALL' ELSE 'CHUNK_TOO_LARGE' END AS type, count(*) AS n FROM ch WHERE length < 500 OR length > 1500 GROUP BY 1, 2")
def chunk_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = chunks(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("length").alias("lengths"))
    found = lengths.select("doc_id", F.explode(quality.chunk_warnings(F.col("lengths"))).alias("w"))
    return found.groupBy("doc_id", F.col("w.type").alias("type")).agg(F.count("*").alias("n"))


#: The pages of FILED, cleaned, without their file's repeated lines, and with the lists of those.
_CLEANED = f"""WITH c AS (SELECT *, {s_clean('raw')} AS text FROM (SELECT doc_id, source, filename, page_number, text AS raw FROM ({FILED}))), p AS (SELECT *, {s_lines('text')} AS l FROM c),
t AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1),
e AS (SELECT doc_id, 'h' AS kind, unnest(l[1:2]) AS line FROM p UNION ALL SELECT doc_id, 'f', unnest(l[greatest(len(l) - 1, 1):len(l)]) FROM p UNION ALL SELECT doc_id, 'b', unnest(list_distinct(l)) FROM p),
g AS (SELECT doc_id, kind, line FROM e JOIN t USING (doc_id) WHERE length(line) > CASE kind WHEN 'b' THEN 4 ELSE 3 END GROUP BY doc_id, kind, line, pages HAVING count(*) >= greatest(2, floor(pages * CASE kind WHEN 'b' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END))),
r AS (SELECT doc_id, list(line) AS gone, list_sort(list(line) FILTER (kind = 'h')) AS headers, list_sort(list(line) FILTER (kind = 'f')) AS footers FROM g GROUP BY 1)
SELECT p.doc_id, source, filename, page_number, raw, coalesce(headers, []) AS headers, coalesce(footers, []) AS footers, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x: NOT list_contains(gone, x)), chr(10)) END AS text FROM p LEFT JOIN r USING (doc_id)"""
#: A rule's severity, condition and evidence, in the order of findings.
_EVERY_RULE = {
    "EXACT_DUPLICATE": ("CRITICAL", "exact IS NOT NULL", "exact"),
    "NEAR_DUPLICATE": ("WARN", "near IS NOT NULL", "near"),
    "SUPERSEDED_VERSION": ("WARN", "other IS NOT NULL", "other"),
    "DRAWING_LOW_TEXT": (*_RULES["DRAWING_LOW_TEXT"], """'{"textLength":' || length(text) || ',"isDrawing":true}'"""),
    "LOW_TEXT_VOLUME": (*_RULES["LOW_TEXT_VOLUME"], """'{"textLength":' || length(text) || '}'"""),
    "POOR_OCR_QUALITY": (*_RULES["POOR_OCR_QUALITY"], """'{"errorRatio":' || round(garbled, 4) || '}'"""),
    "HIGH_NON_ALPHA_RATIO": (*_RULES["HIGH_NON_ALPHA_RATIO"], """'{"nonAlphaRatio":' || alpha || '}'"""),
    "REPEATED_LINES": (*_RULES["REPEATED_LINES"], """'{"repeatedLineRatio":' || repeated || '}'"""),
    "HEADER_FOOTER_REMOVAL": ("INFO", "len(headers) + len(footers) > 0", """'{"headers":' || to_json(headers) || ',"footers":' || to_json(footers) || '}'"""),
    "MISSING_DATE": (*_RULES["MISSING_DATE"], "'{}'"),
    "MISSING_REVISION": (*_RULES["MISSING_REVISION"], """'{"docType":"' || kind || '"}'"""),
    "STANDARDS_REFERENCED": (*_RULES["STANDARDS_REFERENCED"], """'{"standards":' || to_json(standards[1:10]) || '}'"""),
}
_ASSESSED = f"""{_CHUNKS.replace(FILED, _CLEANED, 1)},
cleaned AS (SELECT doc_id, source AS lang, filename, any_value(headers) AS headers, any_value(footers) AS footers, string_agg(raw, chr(10) ORDER BY page_number) AS raw, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM pg GROUP BY 1, 2, 3),
{_PRINTS.replace("documents", "cleaned")},
shas AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha FROM documents),
same AS (SELECT a.doc_id, count(*) AS n, (list(b.doc_id ORDER BY b.doc_id))[1:5] AS ids FROM shas a JOIN shas b ON a.source = b.source AND a.sha = b.sha AND a.doc_id <> b.doc_id GROUP BY 1),
alike AS (SELECT a.doc_id, count(*) AS links, (list('{{"file_id":' || b.doc_id || ',"distance":' || bit_count(xor(a.s, b.s)) || '}}' ORDER BY b.doc_id DESC))[1:5] AS found FROM fp a JOIN fp b ON a.lang = b.lang AND a.doc_id <> b.doc_id AND bit_count(xor(a.s, b.s)) <= 3 GROUP BY 1),
revs AS (SELECT doc_id, lang, lower({s_base('filename')}) AS base, {s_revision('filename')} AS rev, {s_revision('filename', 'left(text, 2000)')} AS own, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM cleaned),
newer AS (SELECT a.doc_id, '{{"currentRevision":' || to_json(a.own) || ',"otherFileId":' || arg_min(b.doc_id, b.r) || ',"otherRevision":' || to_json(arg_min(b.rev, b.r)) || '}}' AS other FROM revs a JOIN revs b ON b.r <= 50 AND a.lang = b.lang AND a.doc_id <> b.doc_id AND a.base = b.base AND b.rev IS NOT NULL AND b.rev <> a.own WHERE a.own IS NOT NULL AND a.base <> '' GROUP BY a.doc_id, a.own),
warned AS (SELECT doc_id, count(*) AS chunk_count, coalesce(list(CASE WHEN length < 500 THEN 'CHUNK_TOO_SMALL' ELSE 'CHUNK_TOO_LARGE' END ORDER BY chunk_index) FILTER (length < 500 OR length > 1500), []) AS warnings FROM ch GROUP BY 1),
kinds AS (SELECT *, {_KINDS} FROM cleaned),
facts AS (SELECT kinds.doc_id, lang, headers, footers, raw AS text, {s_drawing('text', 'filename')} AS drawing, {s_garbled('text')} AS garbled, {s_date('text')} AS ddate, {s_revision('filename', 'text')} AS rev, {_KIND} AS kind, {s_standards('text')} AS standards,
 CASE WHEN raw = '' THEN 1.0 ELSE round(length(regexp_replace(raw, '[A-Za-z0-9\\s]', '', 'g'))::DOUBLE / length(raw), 4) END AS alpha,
 CASE WHEN len({s_lines('raw')}) = 0 THEN 0.0 ELSE round(1 - len(list_distinct({s_lines('raw')}))::DOUBLE / len({s_lines('raw')}), 4) END AS repeated,
 CASE WHEN same.n > 0 THEN '{{"matchingFileIds":' || to_json(ids) || ',"matches":' || same.n || '}}' END AS exact, CASE WHEN found IS NOT NULL THEN '{{"matches":[' || array_to_string(found, ',') || '],"links":' || links || '}}' END AS near, other,
 coalesce(chunk_count, 0) AS chunk_count, coalesce(warnings, []) AS warnings
 FROM kinds LEFT JOIN same ON same.doc_id = kinds.doc_id LEFT JOIN alike ON alike.doc_id = kinds.doc_id LEFT JOIN newer ON newer.doc_id = kinds.doc_id LEFT JOIN warned ON warned.doc_id = kinds.doc_id),
found AS (SELECT lang, doc_id, chunk_count, warnings, list_filter([{', '.join(f"CASE WHEN {w} THEN '{k}' END" for k, (_, w, _) in _EVERY_RULE.items())}], lambda x: x IS NOT NULL) AS types,
 list_filter([{', '.join(f"CASE WHEN {w} THEN {e} END" for _, w, e in _EVERY_RULE.values())}], lambda x: x IS NOT NULL) AS evidence,
 {', '.join(f"({' + '.join(f'CASE WHEN {w} THEN 1 ELSE 0 END' for s, w, _ in _EVERY_RULE.values() if s == sev)}) AS {sev.lower()}" for sev in L.DEDUCTIONS)} FROM facts)"""


@query("assessed_files", f"""WITH {_ASSESSED} SELECT lang AS tenant_id, doc_id AS file_id, array_to_string(list_concat(types, warnings), ',') AS types, array_to_string(evidence, '|') AS evidence,
 critical::INTEGER AS critical, (warn + len(warnings))::INTEGER AS warn, info::INTEGER AS info, greatest(0, greatest(0, 100 - ({' + '.join(f"{c} * {s.lower()}" for s, c in L.DEDUCTIONS.items())})) - 3 * len(warnings))::INTEGER AS readiness, chunk_count::INTEGER AS chunk_count FROM found""")
def assessed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over files of several pages, with those on other files of the tenant and the warnings of the chunks."""
    from millrace.plans.readiness import reports

    raw = _filed(spark, sf_dir).withColumnsRenamed({"source": "tenant_id", "doc_id": "file_id"})
    files = _files(spark, sf_dir).withColumn("tenant_id", F.col("source")).select("tenant_id", "file_id", "filename", "created_at", "raw_sha256")
    made = reports(raw.select("tenant_id", "file_id", "page_number", "text"), files)
    of_file = F.filter("findings", lambda f: ~F.startswith(f["type"], F.lit("CHUNK_")))
    types, evidence = F.transform("findings", lambda f: f["type"]), F.transform(of_file, lambda f: f["evidence"])
    return made.select("tenant_id", "file_id", F.array_join(types, ",").alias("types"), F.array_join(evidence, "|").alias("evidence"), *(F.col(f"summary.{s}").alias(s.lower()) for s in L.DEDUCTIONS), "readiness", "chunk_count")


def _assessed_reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = _filed(spark, sf_dir).withColumnsRenamed({"source": "tenant_id", "doc_id": "file_id"}).select("tenant_id", "file_id", "page_number", "text")
    files = _files(spark, sf_dir).withColumn("tenant_id", F.col("source")).select("tenant_id", "file_id", "filename", "created_at", "raw_sha256")
    return raw, files


def s_said(kind: str, place: int, value: str) -> str:
    return "replace(CASE " + kind + " " + " ".join(f"WHEN {lit(k)} THEN {lit(t[place])}" for k, t in L.FINDING_TEXTS.items()) + f" END, '{{}}', coalesce({value}, ''))"


_OWN = "CASE k WHEN 'SUPERSEDED_VERSION' THEN e ->> '$.otherRevision' WHEN 'MISSING_REVISION' THEN e ->> '$.docType' END"
_SEVERITY = "CASE k " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (s, _, _) in _EVERY_RULE.items()) + " END"


@query("quality_payloads", f"""WITH {_ASSESSED},
own AS (SELECT doc_id, unnest(types) AS k, unnest(evidence) AS e, unnest(range(len(types))) AS i FROM found),
said AS (SELECT doc_id, string_agg('{{"type":"' || k || '","severity":"' || {_SEVERITY} || '","description":' || to_json({s_said('k', 0, _OWN)}) || ',"evidence":' || e || ',"recommendation":' || to_json({s_said('k', 1, _OWN)}) || '}}', ',' ORDER BY i) AS said FROM own GROUP BY 1),
odd AS (SELECT doc_id, chunk_index, length, CASE WHEN length < 500 THEN 'CHUNK_TOO_SMALL' ELSE 'CHUNK_TOO_LARGE' END AS k FROM ch WHERE length < 500 OR length > 1500),
warn AS (SELECT doc_id, string_agg('{{"type":"' || k || '","severity":"WARN","description":' || to_json({s_said('k', 0, 'length::VARCHAR')}) || ',"recommendation":' || to_json({s_said('k', 1, 'length::VARCHAR')}) || '}}', ',' ORDER BY chunk_index) AS said FROM odd GROUP BY 1)
SELECT lang AS tenant_id, 'd' AS dataset_id, doc_id AS file_id, 'processed/' || lang || '/d/' || doc_id || '/quality_report.json' AS key,
 '{{"schemaVersion":"1.0","tenantId":"' || lang || '","datasetId":"d","fileId":"' || doc_id || '","readinessScore":' || greatest(0, greatest(0, 100 - ({' + '.join(f"{c} * {s.lower()}" for s, c in L.DEDUCTIONS.items())})) - 3 * len(warnings))
 || ',"summary":{{"CRITICAL":' || critical || ',"WARN":' || (warn + len(warnings)) || ',"INFO":' || info || '}},"findings":[' || concat_ws(',', said.said, w.said) || ']}}' AS payload
FROM found LEFT JOIN said USING (doc_id) LEFT JOIN warn AS w USING (doc_id)""")
def quality_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality reports of assessed_files as JSON."""
    from millrace.plans import payloads
    from millrace.plans.readiness import reports

    return payloads.quality_reports(reports(*_assessed_reports(spark, sf_dir)).withColumn("dataset_id", F.lit("d")))


@query("document_json", f"""WITH cl AS ({_CLEANED}), d AS (SELECT doc_id, source, any_value(filename) AS filename, any_value(headers) AS headers, any_value(footers) AS footers, count(*) AS pages, sum(length(text))::BIGINT AS n,
 '[' || string_agg('{{"pageNumber":' || page_number || ',"text":' || to_json(text) || '}}', ',' ORDER BY page_number) || ']' AS texts FROM cl GROUP BY 1, 2)
SELECT doc_id AS file_id, 'processed/' || source || '/d/' || doc_id || '/document.json' AS key, filename, pages, n AS text_length, to_json(headers)::VARCHAR AS headers, to_json(footers)::VARCHAR AS footers, round(least(1.0, (len(headers) + len(footers))::DOUBLE / pages), 3) AS confidence, sha256(texts) AS pages_sha256 FROM d""")
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON, read again: what they say of the file, and a digest of the array of their pages."""
    from millrace.plans import payloads
    from millrace.plans.readiness import prepare

    made = payloads.documents(prepare(*_assessed_reports(spark, sf_dir)).withColumn("dataset_id", F.lit("d")), F.lit("2024-01-01T00:00:00Z"))
    field = lambda path: F.get_json_object("payload", f"$.{path}")
    # the pages' own text of JSON, between the name of their field and that of the next
    start = F.locate('},"pages":[', F.col("payload")) + F.lit(len('},"pages":'))
    pages = F.substring(F.col("payload"), start, F.length("payload") - start - F.lit(len(',"createdAt":"2024-01-01T00:00:00Z"}') - 1))
    return made.select(
        "file_id", "key", field("sourceFilename").alias("filename"), field("pageCount").cast("long").alias("pages"), field("textLength").cast("long").alias("text_length"), field("normalization.removedHeaderLines").alias("headers"),
        field("normalization.removedFooterLines").alias("footers"), field("normalization.headerFooterConfidence").cast("double").alias("confidence"), F.sha2(pages, 256).alias("pages_sha256"),
    )


# --- SQL ---


@query("sql_chunks", SQL["chunks"])
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over the pages of chunks."""
    from millrace.functions import sql

    sql.register(spark, "millrace_")
    return spark.sql("SELECT * FROM millrace_chunked(TABLE({pages}))", pages=_filed(spark, sf_dir).select("doc_id", "page_number", "text"))


@query("sql_functions", f"""WITH d AS ({ORACLE_DECOR}) SELECT doc_id, {s_clean('text')} AS clean, {s_base('filename')} AS base, {s_snippet('text', 260)} AS start, doc_id::VARCHAR || '#p2#c' || doc_id % 7 AS chunk,
 CASE WHEN text = '' THEN 1.0 ELSE round(length(regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g'))::DOUBLE / length(text), 4) END AS ratio, bit_count(xor(doc_id, 12345))::INTEGER AS distance FROM d""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the SQL functions over documents."""
    from millrace.functions import sql

    sql.register(spark, "millrace_")
    return spark.sql(
        """SELECT doc_id, millrace_clean_text(text) AS clean, millrace_base_name(filename) AS base, millrace_snippet(text) AS start, millrace_chunk_id(doc_id, 2, CAST(doc_id % 7 AS INT)) AS chunk,
         round(millrace_non_alpha_ratio(text), 4) AS ratio, millrace_hamming(doc_id, 12345L) AS distance FROM {docs}""",
        docs=decorated(spark, sf_dir),
    )


# --- vectors ---

_V = "[" + ", ".join(f"{((i * 37) % 19 - 9) / 10}" for i in range(64)) + "]"
QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_SIM = f"list_cosine_similarity(embedding::DOUBLE[], {_V}::DOUBLE[])"


@query("vector_topk", f"SELECT vec_id, round({_SIM}, 6) AS score FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 20, key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_topk_filtered", f"SELECT vec_id, round({_SIM}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_SIM} DESC, vec_id LIMIT 8")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 8, F.col("label") == 3, key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"), F.col("vec_id"), "label", "embedding")
    old = rows.where("vec_id % 3 <> 0").withColumns({"text": F.lit("old"), "created_at": F.lit(1), "doc_type": F.lit("contract")})
    new = rows.where("vec_id % 2 = 0").withColumns({"text": F.lit("new"), "created_at": F.lit(2), "doc_type": F.lit("drawing"), "embedding": F.expr("if(vec_id % 10 = 0, null, embedding)")})
    return old, new


_OLD_NEW = "o AS (SELECT 'c' || vec_id AS k, * FROM embeddings WHERE vec_id % 3 <> 0), n AS (SELECT 'c' || vec_id AS k, vec_id, label FROM embeddings WHERE vec_id % 2 = 0)"


@query("upsert_chunks", f"""WITH {_OLD_NEW} SELECT coalesce(o.k, n.k) AS chunk_id, CASE WHEN n.k IS NULL THEN 'old' ELSE 'new' END AS text, CASE WHEN n.k IS NULL THEN 1 ELSE 2 END AS created_at,
 CASE WHEN o.k IS NULL THEN 'drawing' ELSE 'contract' END AS doc_type, coalesce(o.label, n.label) AS label FROM o FULL JOIN n ON o.k = n.k""")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.upsert(*_two(spark, sf_dir)).select("chunk_id", "text", "created_at", "doc_type", "label")


@query("insert_absent", f"WITH {_OLD_NEW} SELECT k AS chunk_id, 'old' AS text FROM o UNION ALL SELECT k, 'new' FROM n WHERE vec_id % 10 <> 0 AND k NOT IN (SELECT k FROM o)")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.insert_absent(*_two(spark, sf_dir)).select("chunk_id", "text")


@query("delete_documents", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id < 3)")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return vectors.delete_documents(e, e.where("vec_id < 3"), ("label",))


@query("embedded_chunks")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("embedding", vectors.checked(vectors.embed("text"), 1024)).select("doc_id", "chunk_index", "embedding")


#: CRC-32 by its table of 256 words.
_CRC = "crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def s_crc(x: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


def s_votes(texts: str, keys: str, size: int) -> str:
    """CTEs up to votes (keys, place, vote): the stand-in model's vectors before they are brought to length 1."""
    return f"""{_CRC}, word AS (SELECT {keys}, unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM {texts}), hash AS (SELECT word, {s_crc("word")} AS h FROM (SELECT DISTINCT word FROM word), crc),
votes AS (SELECT {keys}, h % {size} AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS vote FROM word JOIN hash USING (word) GROUP BY ALL)"""


@query("embedded_components", f"""WITH {_CHUNKS}, {s_votes("ch", "doc_id, chunk_index", 1024)}, length AS (SELECT doc_id, chunk_index, sqrt(sum(vote * vote))::FLOAT AS n FROM votes GROUP BY 1, 2)
SELECT doc_id, chunk_index, place::INTEGER AS place, round((vote::FLOAT / n)::FLOAT::DOUBLE, 6) AS value FROM votes JOIN length USING (doc_id, chunk_index) WHERE vote <> 0""")
def embedded_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of embedded_chunks that are not 0, a row each."""
    parts = embedded_chunks(spark, sf_dir).select("doc_id", "chunk_index", F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return parts.withColumn("value", F.round(F.col("value").cast("double"), 6))


# --- retrieval ---


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decorated(spark, sf_dir)
    return docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.expr("if(doc_id % 4 = 0, '', filename)").alias("filename"), F.expr("if(doc_id % 3 = 0, null, cast(doc_id % 9 as int))").alias("page"),
        "text", F.expr("if(doc_id % 5 = 0, null, 'rfi')").alias("doc_type"), F.lit(None).cast("string").alias("discipline"), F.expr("if(doc_id % 2 = 0, 'Clause 4', null)").alias("section_reference"),
        F.lit(None).cast("array<string>").alias("standards_referenced"), (1 / (F.col("doc_id") + 1)).alias("score"), (F.col("doc_id") / 8).cast("long").alias("question"),
    )


@query("citations", f"""WITH h AS (SELECT *, (doc_id // 8) AS question, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY 1.0::DOUBLE / (doc_id + 1) DESC, doc_id::VARCHAR) AS n FROM ({ORACLE_DECOR})),
b AS (SELECT question, n, {s_snippet('text', 260)} AS snip, '[S' || n || '] ' || CASE WHEN doc_id % 4 = 0 THEN 'source' ELSE filename END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' [RFI]' END
 || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' p' || (doc_id % 9) END || CASE WHEN doc_id % 2 = 0 THEN ' §Clause 4' ELSE '' END || chr(10) || {s_snippet('text', 1200)} AS block FROM h)
SELECT question, count(*)::INTEGER AS n_citations, string_agg(snip, '|' ORDER BY n) AS snippets, string_agg(block, chr(10) || chr(10) ORDER BY n) AS sources FROM b GROUP BY question""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.citations(_hits(spark, sf_dir), ["question"])
    return out.select("question", F.size("citations").alias("n_citations"), F.array_join(F.transform("citations", lambda c: c["snippet"]), "|").alias("snippets"), "sources")


@query("history_first", "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, role FROM m WHERE n <= 4 AND role IN ('user', 'assistant')")
def history_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.history(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 4).select("conv_id", "turn", "role")


@query("history_recent", "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, turn, role FROM m WHERE n <= 4")
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.history(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 4, "recent").select("conv_id", "turn", "role")


@query("chat_eligibility", "SELECT doc_id, CASE WHEN l.doc_id IS NULL OR quality = 0 THEN 404 WHEN toxic = 1 THEN 409 ELSE 200 END AS code FROM documents d LEFT JOIN labels l USING (doc_id)")
def chat_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.withColumns({"tenant_id": F.expr("CASE quality WHEN 1 THEN 'a' WHEN 0 THEN 'b' END"), "status": F.expr("if(toxic = 1, 'INDEXING', 'READY')")})
    return rows.select("doc_id", retrieval.eligible(rows, F.lit("a")).alias("code"))


_CHUNKED = "SELECT vec_id::VARCHAR AS chunk_id, 't' || (label % 2) AS tenant_id, 'd' || (label % 3) AS dataset_id, * FROM embeddings"


def _chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a chunk table of two tenants with three datasets each."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.concat(F.lit("t"), F.col("label") % 2).alias("tenant_id"), F.concat(F.lit("d"), F.col("label") % 3).alias("dataset_id"), F.concat(F.lit("text "), "vec_id").alias("text"))
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in vectors.HIT_KINDS.items() if c not in rows.columns})


@query("semantic_search", f"WITH c AS ({_CHUNKED}) SELECT chunk_id, 'text ' || vec_id AS text, round({_SIM}, 6) AS score FROM c WHERE tenant_id = 't1' AND dataset_id = 'd2' ORDER BY {_SIM} DESC, chunk_id LIMIT 20")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's hits in one dataset of a tenant; more than 20 can't be asked for."""
    hits = retrieval.retrieve(_chunk_table(spark, sf_dir), "t1", "d2", " what does the RFI say ", lambda q: QUERY_VECTOR, 50, size=64)
    return retrieval.shaped(hits).select("citation.chunk_id", "text", F.round("score", 6).alias("score"))


_ASKED_IN = f"c AS ({_CHUNKED}), d AS (SELECT DISTINCT tenant_id, dataset_id FROM c), q AS (SELECT vec_id || '/' || tenant_id || '/' || dataset_id AS question_id, tenant_id, dataset_id, embedding AS v, vec_id % 23 AS k FROM embeddings, d WHERE vec_id % 50 = 0)"
_OF_ALL = f"""WITH {_ASKED_IN}, s AS (SELECT question_id, k, chunk_id, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS score FROM q JOIN c USING (tenant_id, dataset_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS n FROM s) SELECT question_id, chunk_id, round(score, 6) AS score, n::INTEGER AS n FROM r WHERE n <= greatest(1, least(20, k))"""


def _question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector as a question to each dataset, with a number of results of its own."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select("vec_id", F.col("embedding").alias("vector"), (F.col("vec_id") % 23).cast("int").alias("k"))
    places = _chunk_table(spark, sf_dir).select("tenant_id", "dataset_id").distinct()
    every = F.explode(F.array(*(F.struct(F.lit(f"t{t}").alias("tenant_id"), F.lit(f"d{d}").alias("dataset_id")) for t in range(2) for d in range(3)))).alias("at")
    return asked.select("*", every).select("vec_id", "vector", "k", "at.*").join(places, ["tenant_id", "dataset_id"]).withColumn("question_id", F.concat_ws("/", "vec_id", "tenant_id", "dataset_id"))


@query("questions_topk", _OF_ALL)
def questions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many questions to many datasets at once."""
    return search.nearest(_question_table(spark, sf_dir), _chunk_table(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("indexed_topk", _OF_ALL)
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an index, exactly."""
    import uuid

    at = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    index = vector_index.build(_chunk_table(spark, sf_dir), at, rows_a_list=100)
    return vector_index.find(index, _question_table(spark, sf_dir), probes=2).withColumn("score", F.round("score", 6))


_LAST_SAID = "SELECT conv_id, count(*) AS turns, arg_max(text, turn) AS text, 't' || conv_id % 2 AS tenant_id, 'd' || conv_id % 4 AS dataset_id FROM conversations GROUP BY conv_id"


@query("question_turns", f"""WITH q AS ({_LAST_SAID}), c AS ({_CHUNKED}), {s_votes("q", "conv_id", 64)}, e AS (SELECT chunk_id, tenant_id, dataset_id, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS place FROM c),
len AS (SELECT conv_id, sqrt(sum(vote * vote)) AS n FROM votes GROUP BY 1 HAVING sum(vote * vote) > 0), el AS (SELECT chunk_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
s AS (SELECT q.conv_id, chunk_id, vec_id, sum(vote * x) / any_value(len.n) / any_value(el.n) AS score FROM q JOIN len USING (conv_id) JOIN votes USING (conv_id) JOIN e USING (tenant_id, dataset_id, place) JOIN el USING (chunk_id) GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, chunk_id) AS n FROM s QUALIFY n <= 3),
b AS (SELECT conv_id, string_agg('[S' || n || '] source' || chr(10) || 'text ' || vec_id, chr(10) || chr(10) ORDER BY n) AS sources FROM h GROUP BY 1)
SELECT conv_id, CASE WHEN sources IS NOT NULL THEN {lit('Question:' + chr(10))} || text || {lit(chr(10) * 2 + 'Sources:' + chr(10))} || sources || {lit(chr(10) * 2 + 'Answer:')} WHEN turns > 1 THEN {lit(retrieval.FOLLOW_UP[0])} || text || {lit(retrieval.FOLLOW_UP[1])} END AS prompt,
 CASE WHEN sources IS NULL AND turns = 1 THEN {lit(retrieval.NO_ANSWER)} END AS answer FROM q LEFT JOIN b USING (conv_id)""")
def question_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last message as a question of its own to its dataset, one in four of which has no chunks."""
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("text", "turn").alias("text"))
    asked = said.select(
        F.col("conv_id").alias("question_id"), F.concat(F.lit("t"), F.col("conv_id") % 2).alias("tenant_id"), F.concat(F.lit("d"), F.col("conv_id") % 4).alias("dataset_id"),
        vectors.embed("text", lambda texts: vectors.hashed_embedding(texts, 64)).alias("vector"), F.lit(3).alias("k"),
    )
    chunks = _chunk_table(spark, sf_dir)
    sources = retrieval.citations(search.hits(search.nearest(asked, chunks), chunks), ["question_id"]).select(F.col("question_id").alias("conv_id"), F.size("citations").alias("n"), "sources")
    some = said.join(sources, "conv_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return some.select("conv_id", retrieval.turn(F.col("text"), F.col("sources"), F.col("n"), F.col("turns") - 1).alias("t")).select("conv_id", "t.*")


@query("chat_turns", f"""WITH c AS ({_CHUNKED}), h AS (SELECT *, row_number() OVER (ORDER BY {_SIM} DESC, chunk_id) AS n FROM c WHERE tenant_id = 't0' AND dataset_id = 'd1' QUALIFY n <= 3),
s AS (SELECT string_agg('[S' || n || '] source' || chr(10) || 'text ' || vec_id, chr(10) || chr(10) ORDER BY n) AS sources FROM h),
q AS (SELECT conv_id, count(*) AS turns, arg_max(text, turn) AS message FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN {lit('Question:' + chr(10))} || message || {lit(chr(10) * 2 + 'Sources:' + chr(10))} || sources || {lit(chr(10) * 2 + 'Answer:')} WHEN turns > 1 THEN {lit(retrieval.FOLLOW_UP[0])} || message || {lit(retrieval.FOLLOW_UP[1])} END AS prompt,
 CASE WHEN conv_id % 3 <> 0 AND turns = 1 THEN {lit(retrieval.NO_ANSWER)} END AS answer FROM q, s""")
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last message as a question: with sources for a third of them, from its history, or without either."""
    hits = retrieval.retrieve(_chunk_table(spark, sf_dir), "t0", "d1", "scope of works", lambda q: QUERY_VECTOR, 3, size=64)
    sources = retrieval.citations(hits).select(F.size("citations").alias("n"), "sources")
    asked = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("text", "turn").alias("message"))
    some = asked.crossJoin(F.broadcast(sources)).withColumn("n", F.when(F.col("conv_id") % 3 == 0, F.col("n")).otherwise(0))  # one row of sources
    return some.select("conv_id", retrieval.turn(F.col("message"), F.col("sources"), F.col("n"), F.col("turns") - 1).alias("t")).select("conv_id", "t.*")


@query("repaired_records", """SELECT CASE WHEN doc_id % 3 = 0 THEN 'known-' || doc_id WHEN doc_id % 3 = 1 THEN 'old-' || doc_id ELSE doc_id || '#p0#c' || (doc_id % 4) END AS chunk_id, doc_id::VARCHAR AS doc_id, 't' AS tenant_id,
 CASE WHEN doc_id % 2 = 0 THEN 'own.pdf' ELSE 'default.pdf' END AS filename, coalesce(text, '') AS text FROM documents WHERE length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) > 0 AND doc_id % 5 <> 0""")
def repaired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.select(
        F.expr("if(doc_id % 3 = 0, 'known-' || doc_id, '')").alias("chunk_id"), F.expr("if(doc_id % 3 = 1, 'old-' || doc_id, null)").alias("chunkId"), F.col("doc_id").cast("string").alias("doc_id"),
        F.expr("if(doc_id % 2 = 0, 'own.pdf', '')").alias("filename"), F.lit(None).cast("int").alias("page"), (F.col("doc_id") % 4).alias("chunk_index"), F.expr("if(doc_id % 5 = 0, ' \n', coalesce(text, ''))").alias("text"),
    )
    made = vectors.repair(old, F.lit("t"), F.lit("d"), F.lit("none"), F.lit(""), F.lit("default.pdf"), F.lit("now"), F.lit("m"))
    return made.select("chunk_id", "doc_id", "tenant_id", "filename", "text")


# --- catalogue ---

_STATUS = "CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'READY' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' ELSE 'COMPLETE' END"


def _catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("tenant_id"), F.col("source").alias("dataset_id"), F.col("doc_id").alias("file_id"), F.expr(_STATUS).alias("status"))


_FIGURES = f"""f AS (SELECT lang AS tenant_id, source AS dataset_id, {_STATUS} AS status FROM documents), ds AS (SELECT DISTINCT tenant_id, dataset_id FROM f UNION ALL SELECT 'none', 'empty'),
g AS (SELECT ds.tenant_id, ds.dataset_id, count(status) AS total, count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status = 'PROCESSING') AS processing, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM ds LEFT JOIN f USING (tenant_id, dataset_id) GROUP BY 1, 2)"""


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _catalog_files(spark, sf_dir)
    datasets = files.select("tenant_id", "dataset_id").distinct().union(spark.sql("SELECT 'none', 'empty'"))
    return catalog.dataset_figures(datasets, files)


@query("dataset_figures", f"WITH {_FIGURES} SELECT * FROM g")
def dataset_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(spark, sf_dir)


@query("totals", f"WITH {_FIGURES} SELECT sum(total)::BIGINT AS total, sum(ready)::BIGINT AS ready, sum(processing)::BIGINT AS processing, sum(failed)::BIGINT AS failed, round(100.0 * sum(ready) / sum(total))::INTEGER AS ready_percent FROM g")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(_figures(spark, sf_dir))


@query("counts_by_dataset", "SELECT lang AS tenant_id, source AS dataset_id, count(*) AS n FROM documents GROUP BY 1, 2")
def counts_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts(_catalog_files(spark, sf_dir))


@query("partial_update", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 8 = 0 THEN 0.5 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT -1, 'X', NULL""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.expr("CAST(if(o_orderkey % 8 = 0, 0.5, null) AS DOUBLE)").alias("o_totalprice"))
    return catalog.update(orders, changes.union(spark.sql("SELECT -1L, 'X', CAST(NULL AS DOUBLE)")), ["o_orderkey"])


@query("put_rows", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'replaced' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'added'")
def put_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return catalog.put(c, c.where("c_custkey % 5 = 0").withColumn("c_name", F.lit("replaced")).union(spark.sql("SELECT -1L, 'added'")), ["c_custkey"])


@query("state_changes", f"""WITH s AS (SELECT doc_id, {_STATUS} AS was FROM documents) SELECT doc_id, was IN ('FAILED') AS restarts, was = 'PROCESSING' AS ends FROM s""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = F.expr(_STATUS)
    return table(spark, sf_dir, "documents").select("doc_id", catalog.allowed("file", was, F.lit("PROCESSING")).alias("restarts"), catalog.allowed("file", was, F.lit("COMPLETE")).alias("ends"))


_MOVES = "(VALUES " + ", ".join(f"({lit(k)}, {'NULL' if a is None else lit(a)}, {lit(b)})" for k, table_ in catalog.STATES.items() for a, to in table_.items() for b in sorted(to)) + ") AS t(kind, a, b)"
_ASKS = {"file": "CASE event_type WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'COMPLETE' WHEN 'signup' THEN 'FAILED' WHEN 'purchase' THEN 'UPLOADED_PENDING' END", "dataset": "CASE event_type WHEN 'view' THEN 'CHUNKED' WHEN 'click' THEN 'INDEXING' WHEN 'signup' THEN 'READY' WHEN 'purchase' THEN 'UPLOADED' ELSE 'LOST' END"}


def _fold(kind: str, key: str) -> str:
    """A machine's verdicts on events, by a recursion along each key's events."""
    return f"""WITH RECURSIVE e AS (SELECT {key} AS k, event_id, {_ASKS[kind]} AS status, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events), moves AS (SELECT a, b FROM {_MOVES} WHERE kind = '{kind}'),
f AS (SELECT DISTINCT k, NULL::BIGINT AS event_id, NULL::VARCHAR AS status, 0::BIGINT AS i, NULL::VARCHAR AS was, false AS accepted, NULL::VARCHAR AS now FROM e
 UNION ALL SELECT e.k, e.event_id, e.status, e.i, f.now, m.b IS NOT NULL, coalesce(m.b, f.now) FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1 LEFT JOIN moves m ON m.b = e.status AND m.a IS NOT DISTINCT FROM f.now)
SELECT k, event_id, status, was, accepted, now FROM f WHERE i > 0"""


def _replayed(spark: SparkSession, sf_dir: str, kind: str, key: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(f"{key} AS k", "ts", "event_id", f"{_ASKS[kind]} AS status")
    return status.replay(events, kind, ["k"], ["ts", "event_id"]).drop("ts")


@query("file_history", _fold("file", "user_id"))
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests to each user's file: which are taken, and what follows."""
    return _replayed(spark, sf_dir, "file", "user_id")


@query("dataset_history", _fold("dataset", "user_id % 3"))
def dataset_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for three datasets, each with a third of all events, which an upload sets back."""
    return _replayed(spark, sf_dir, "dataset", "user_id % 3")


@query("files_to_process", f"SELECT doc_id AS file_id FROM documents WHERE NOT ({_STATUS} IN ('PROCESSING', 'COMPLETE') AND doc_id % 2 = 0)")
def files_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _catalog_files(spark, sf_dir).withColumn("latest_job_id", F.expr("if(file_id % 2 = 0, 'j', null)"))
    events = files.select("file_id").union(spark.sql("SELECT -1L"))
    return catalog.to_process(events, files, ["file_id"])


@query("cascade_delete", """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c))
SELECT 'customers' AS kind, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT * FROM o) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM o)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"))
    gone = spark.range(1).select(F.lit(3).alias("nation"))
    kept = catalog.delete_dataset(gone, {"customers": (customers, ["customer"]), "orders": (orders, ["order"]), "lines": (lines, ["order"])}, [("customers", ""), ("orders", "customers"), ("lines", "orders")])
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in kept.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("orphan_scan", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1-') AND o_orderdate < TIMESTAMP '1997-01-01'")
def orphan_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "name", "o_orderdate": "created_at"})
    return catalog.orphans(orders, "1-", F.lit("1997-01-01").cast("timestamp")).select("o_orderkey")


@query("name_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'blu')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.named_like(table(spark, sf_dir, "part").withColumnRenamed("p_name", "name"), "BLU").select("p_partkey")


@query("latest_jobs", "SELECT o_orderkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = o_orderkey % 4")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant_id"), F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 4).cast("int").alias("latest_job_id"))
    jobs = table(spark, sf_dir, "lineitem").select(F.lit("t").alias("tenant_id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("job_id"), F.col("l_quantity").alias("q"))
    return catalog.latest_jobs(files, jobs).select(F.col("file_id").alias("o_orderkey"), F.col("job.q").alias("l_quantity"))


@query("dataset_jobs", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def dataset_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_returnflag").alias("dataset_id"))
    return catalog.of_dataset(jobs, F.lit("R")).drop("dataset_id")


@query("active_datasets", f"SELECT lang AS tenant_id, source AS dataset_id, bool_or({_STATUS} = 'PROCESSING') AS active FROM documents GROUP BY 1, 2")
def active_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active(_catalog_files(spark, sf_dir))


@query("job_artifacts", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'chunks-' || o_orderkey END AS key FROM orders")
def job_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderkey % 2 = 0, map('chunks', 'chunks-' || o_orderkey, 'report', 'r'), map('report', 'r'))").alias("artifacts"))
    return jobs.select("o_orderkey", catalog.artifact("chunks").alias("key"))


@query("document_keys", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'stored/' || doc_id ELSE 'raw/' || lang || '/' || source || '/' || doc_id || '/' || CASE WHEN doc_id % 3 = 0 THEN 'document.pdf' ELSE {NAME} END END AS raw_key FROM documents")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _catalog_files(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.expr(f"if(doc_id % 3 = 0, null, {NAME})").alias("filename"), F.expr("if(doc_id % 2 = 0, 'stored/' || doc_id, null)").alias("raw_key")), "file_id")
    return files.select(F.col("file_id").alias("doc_id"), catalog.raw_key().alias("raw_key"))


@query("audited", "SELECT event_type, count(*) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS n FROM events GROUP BY event_type")
def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type")
    return catalog.audit(log, spark.sql("SELECT 'click' AS event_type")).groupBy("event_type").agg(F.count_distinct("event_id").alias("n"))


@query("stamped_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 'now' ELSE 'then' END AS updated_at FROM orders")
def stamped_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit("then").alias("updated_at"))
    return catalog.update(orders, orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderkey"], stamp=F.lit("now"))


_ASKED = ["CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN 'd' END AS dataset_id", "CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN '  ' || chr(9) END AS message"]


@query("missing_fields", f"""WITH m AS (SELECT conv_id, turn, {', '.join(_ASKED)} FROM conversations)
SELECT conv_id, turn, concat_ws(',', CASE WHEN coalesce(dataset_id, '') = '' THEN 'dataset_id' END, CASE WHEN {s_strip("coalesce(message, '')")} = '' THEN 'message' END) AS missing FROM m""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", *_ASKED)
    return asked.select("conv_id", "turn", F.array_join(catalog.missing_fields("chat"), ",").alias("missing"))


@query("newest_datasets", "SELECT c_custkey, c_name AS name FROM customer ORDER BY c_custkey DESC LIMIT 50")
def newest_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").alias("created_at"))
    return catalog.sorted_datasets(rows, "newest", "c_custkey").limit(50).select("c_custkey", "name")


_UPLOADS = "event_id AS request_id, 't' || user_id % 3 AS tenant_id, CASE WHEN event_id % 11 > 0 THEN 'd' || user_id % 7 END AS dataset_id, CASE WHEN event_id % 5 > 0 THEN event_type || '.pdf' ELSE '' END AS filename, 'application/pdf' AS content_type"
_THERE = "(dataset_id IN ('d0', 'd1', 'd2', 'd3') OR tenant_id = 't0' AND dataset_id = 'd4')"
_FILE_ID = "sha256('file|' || tenant_id || '|' || request_id)[1:32]"


@query("presigned_uploads", f"""WITH r AS (SELECT {_UPLOADS} FROM events), c AS (SELECT *, CASE WHEN dataset_id IS NULL OR filename = '' THEN 400 WHEN {_THERE} THEN 200 ELSE 404 END AS code FROM r)
SELECT request_id, code, CASE WHEN code = 200 THEN 'raw/' || tenant_id || '/' || dataset_id || '/' || {_FILE_ID} || '/' || filename END AS raw_key,
 concat_ws(',', CASE WHEN dataset_id IS NULL THEN 'dataset_id' END, CASE WHEN filename = '' THEN 'filename' END) AS missing FROM c""")
def presigned_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests for uploads, and what each is answered."""
    return requests.presign(*_uploads(spark, sf_dir), F.lit(1)).answers.select("request_id", "code", "raw_key", F.array_join("missing", ",").alias("missing"))


@query("datasets_set_back", f"""WITH r AS (SELECT {_UPLOADS} FROM events), s AS (SELECT DISTINCT tenant_id, dataset_id FROM r WHERE filename <> '' AND {_THERE}),
d AS (SELECT 't' || t AS tenant_id, 'd' || d AS dataset_id FROM range(3) AS a(t), range(5) AS b(d) WHERE d < 4 OR t = 0)
SELECT d.*, CASE WHEN s.dataset_id IS NULL THEN 'READY' ELSE 'UPLOADED' END AS status FROM d LEFT JOIN s USING (tenant_id, dataset_id)""")
def datasets_set_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets after those uploads."""
    asked, datasets = _uploads(spark, sf_dir)
    changes = requests.presign(asked, datasets, F.lit(1)).datasets.drop("updated_at")
    return catalog.update(datasets, changes, ["tenant_id", "dataset_id"])


def _uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, sf_dir, "events").selectExpr(*_split(_UPLOADS))
    datasets = spark.range(15).selectExpr("'t' || id % 3 AS tenant_id", "'d' || CAST(id / 3 AS INT) AS dataset_id", "'READY' AS status").where("dataset_id <> 'd4' OR tenant_id = 't0'")
    return asked, datasets


def _split(columns: str) -> list[str]:
    """A list of SQL columns without commas in them."""
    return columns.split(", ")


@query("compared_orders", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'left' ELSE 'differs' END AS kind FROM orders WHERE o_orderkey < 400 AND o_orderkey % 10 IN (3, 5)
UNION ALL SELECT -1 - o_orderkey, 'right' FROM orders WHERE o_orderkey < 20""")
def compared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders against a copy with lost, changed and added rows."""
    from millrace.operators.compare import compare

    left = stored(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    right = left.where("o_orderkey >= 400 OR o_orderkey % 10 <> 3").withColumn("o_orderstatus", F.expr("if(o_orderkey < 400 AND o_orderkey % 10 = 5, 'changed', o_orderstatus)"))
    added = left.where("o_orderkey < 20").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return compare(left, stored(right.unionByName(added)), "o_orderkey").differences


#: Of each kind of request the fields that it must have, in their order.
_REQUESTS = {"dataset": ("name",), "file": ("dataset_id", "filename", "content_type"), "query": ("dataset_id", "query")}
_GIVEN = [
    "event_id", "CASE WHEN event_id % 2 = 0 THEN '' WHEN event_id % 3 > 0 THEN 'd' END AS dataset_id", "CASE WHEN event_id % 5 > 1 THEN event_type END AS name", "CASE WHEN event_id % 7 > 2 THEN 'a.pdf' ELSE '' END AS filename",
    "CASE WHEN event_id % 3 > 0 THEN 'application/pdf' END AS content_type", "CASE event_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN event_type END AS query",
]


def _lacks(kind: str) -> str:
    given = {f: f"coalesce({f}, '')" for f in _REQUESTS[kind]}
    return ", ".join(f"CASE WHEN {s_strip(x) if f == 'query' else x} = '' THEN '{f}' END" for f, x in given.items())


@query("missing_of_requests", f"WITH r AS (SELECT {', '.join(_GIVEN)} FROM events) SELECT event_id, " + ", ".join(f"concat_ws(',', {_lacks(k)}) AS {k}" for k in _REQUESTS) + " FROM r")
def missing_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for datasets, files and queries, and what each kind lacks."""
    given = table(spark, sf_dir, "events").selectExpr(*_GIVEN)
    return given.select("event_id", *(F.array_join(catalog.missing_fields(k), ",").alias(k) for k in _REQUESTS))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS milliseconds FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", catalog.iso(F.col("ts")).alias("seconds"), catalog.iso(F.col("ts"), True).alias("milliseconds"))


_HOW = {"newest": "c_acctbal DESC", "oldest": "c_acctbal", "name-asc": "lower(c_mktsegment)", "name-desc": "lower(c_mktsegment) DESC"}


@query("dataset_orders", " UNION ALL ".join(f"SELECT '{how}' AS how, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {by}, c_custkey)::INTEGER AS n FROM customer" for how, by in _HOW.items()))
def dataset_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as datasets in all four orders, within each nation; many share a name."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"), F.col("c_acctbal").alias("created_at"))
    made = [rows.select(F.lit(how).alias("how"), "c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*catalog.dataset_order(how, "c_custkey"))).alias("n")) for how in _HOW]
    return reduce(DataFrame.unionByName, made)


_KEY = "(CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'raw/t%20' || user_id || '/d/' || event_id || '/a+b.pdf' WHEN 1 THEN 'raw/t/d/' || event_id ELSE 'tmp/t/d/' || event_id || '/x.pdf' END)"


@query("object_keys", f"SELECT event_id, 't ' || user_id AS tenant_id, 'd' AS dataset_id, event_id::VARCHAR AS file_id, 'a b.pdf' AS filename FROM events WHERE event_id % 3 = 0")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.objects import keyed

    return keyed(table(spark, sf_dir, "events").select("event_id", F.expr(_KEY).alias("key"))).drop("key")


@query("stream_ingest", """SELECT 't ' || user_id AS tenant_id, 'd' AS dataset_id, event_id::VARCHAR AS file_id, 'a b.pdf' AS filename, 'raw/t%20' || user_id || '/d/' || event_id || '/a+b.pdf' AS raw_key,
 sha256('t ' || user_id || '|d|' || event_id || '|raw/t%20' || user_id || '/d/' || event_id || '/a+b.pdf') AS job_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as object notices, read as a stream that ends when all are taken; half of the files are known already."""
    import uuid

    from millrace.sources.objects import keyed
    from millrace.streaming.ingest import dispatch, ingest

    at = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    known = keyed(events.where("event_id % 2 = 0").select(F.expr(_KEY).alias("key")))
    notices = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.expr(_KEY).alias("key"))
    ingest(notices, f"{at}/out", f"{at}/checkpoint", lambda df: dispatch(df, known), errors=f"{at}/errors").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


def _by_batches(spark: SparkSession, rows: DataFrame, order: str, made: Callable[[DataFrame], DataFrame | Held], n: int = 3, cuts: list[float] | None = None) -> DataFrame:
    """made(stream) of rows that come in n batches along an order (cut at its quantiles, or as told), each in a run of its own that
    goes on from the last one's checkpoint."""
    import uuid

    from millrace.streaming.ingest import ingest

    at = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    rows = stored(rows)
    inner = cuts or rows.select(F.col(order).cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.01)
    for low, high in zip([None, *inner], [*inner, None], strict=True):
        above, below = (F.lit(True) if x is None else F.col(order).cast("double") >= x for x in (low, high))
        part = rows.where(above & (~below if high is not None else F.lit(True)))
        part.write.mode("append").parquet(f"{at}/in")
        ingest(made(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


_FILE_OF = "user_id || '-' || event_id % 5"
_STATUS_OF = "(CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETE' END)"
_IDLE = "(e.status IS NULL AND NOT coalesce(s.status IN ('PROCESSING', 'COMPLETE') AND s.attempt > 0, false))"


@query("stream_jobs", f"""WITH RECURSIVE e AS (SELECT {_FILE_OF} AS f, row_number() OVER (PARTITION BY {_FILE_OF} ORDER BY ts, event_id) AS i, {_STATUS_OF} AS status FROM events),
s AS (SELECT DISTINCT f, 0::BIGINT AS i, NULL::VARCHAR AS status, 0 AS attempt, false AS starts FROM e
 UNION ALL SELECT e.f, e.i, CASE WHEN {_IDLE} THEN 'PROCESSING' ELSE coalesce(e.status, s.status) END, s.attempt + {_IDLE}::INTEGER, {_IDLE} FROM s JOIN e ON e.f = s.f AND e.i = s.i + 1)
SELECT 't 1' AS tenant_id, 'd' AS dataset_id, f AS file_id, 'a b.pdf' AS filename, 'raw/t%201/d/' || f || '/a+b.pdf' AS raw_key, attempt,
 sha256('t 1|d|' || f || '|raw/t%201/d/' || f || '/a+b.pdf' || CASE WHEN attempt > 1 THEN '|' || attempt ELSE '' END) AS job_id FROM s WHERE starts""")
def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as notices of objects and changes of status, in several batches: each file has one job until it fails."""
    from millrace.streaming.dispatch import jobs, notices, statuses

    def made(stream: DataFrame) -> DataFrame:
        kept = stream.selectExpr("ts", f"{_STATUS_OF} AS now", "'t 1' AS tenant_id", "'d' AS dataset_id", f"{_FILE_OF} AS file_id")
        key = F.concat(F.lit("raw/t%201/d/"), "file_id", F.lit("/a+b.pdf"))
        objects = kept.where("now IS NULL").select("ts", key.alias("key"))
        return jobs(notices(objects, F.col("ts")).unionByName(statuses(kept, F.col("ts"), F.col("now"))))

    return _by_batches(spark, table(spark, sf_dir, "events"), "event_id", made)


@query("stream_exact_duplicates", SQL["exact_duplicates_as_of"])
def stream_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.streaming import duplicates as stream

    files = _files(spark, sf_dir).select("tenant_id", "file_id", "created_at", "raw_sha256")
    return _by_batches(spark, files, "created_at", stream.exact_duplicates).withColumn("match_ids", F.array_join(F.col("match_ids").cast("array<string>"), ","))


@query("stream_near_duplicates", SQL["near_duplicates_as_of"])
def stream_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.streaming import duplicates as stream

    files = _printed(spark, sf_dir).select("tenant_id", "file_id", "created_at", "simhash", F.lit("").alias("filename"))
    found = _by_batches(spark, files, "created_at", stream.recent_duplicates).where("matches > 0")
    return found.select("tenant_id", "file_id", "matches", F.array_join(F.transform("near", lambda r: r["file_id"].cast("string")), ",").alias("near"))


@query("stream_superseded", SQL["superseded_as_of"])
def stream_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.streaming import duplicates as stream

    files = _files(spark, sf_dir).select("tenant_id", "file_id", "created_at", "filename", "text", F.lit(None).cast("long").alias("simhash"))
    found = _by_batches(spark, files, "created_at", lambda s: stream.recent_duplicates(s, "text")).where("other_file_id IS NOT NULL")
    return found.select("tenant_id", "file_id", "revision", "other_file_id", "other_revision")


@query("keyed_orders", """SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 100 = 1 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 100 = 2 THEN -1.0::DOUBLE ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_custkey, -o_orderkey, 'new', 0.0::DOUBLE FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey <> 0""")
def keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a keyed table that is put, updated, added to and deleted from, and read at its last version."""
    import uuid

    from millrace.operators.keyed import KeyedTable

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    at = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/keyed-{uuid.uuid4().hex}"
    held = KeyedTable.create(spark, at, rows.schema, ["o_custkey", "o_orderkey"], ["o_custkey"], buckets=16).put(rows)
    held = held.put(rows.where("o_orderkey % 100 = 1").withColumn("status", F.lit("X")))
    held = held.update(rows.where("o_orderkey % 100 = 2").select("o_custkey", "o_orderkey", F.lit(-1.0).alias("price")))
    new = rows.where("o_orderkey % 50 = 0")
    held = held.insert_absent(new.unionByName(new.withColumns({"o_orderkey": -F.col("o_orderkey"), "status": F.lit("new"), "price": F.lit(0.0)})))
    return held.delete(rows.where("o_orderkey % 7 = 0")).read()


# --- extraction, payloads and failures ---

_FED = "'one' || chr(12) || coalesce(text, '') || chr(12) || CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE ' end' END"
_NORMAL = s_strip("regexp_replace(regexp_replace(regexp_replace(l[i], '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


@query("form_feed_pages", f"""WITH p AS (SELECT doc_id, string_split({_FED}, chr(12)) AS l FROM documents), q AS (SELECT doc_id, CASE WHEN trim(l[len(l)]) = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM p)
SELECT doc_id, i::INTEGER AS page_number, {_NORMAL} AS text FROM q, range(1, len(l) + 1) AS r(i)""")
def form_feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.objects import form_feed_pages as split_pages

    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FED).alias("text"))
    return docs.select("doc_id", F.explode_outer(split_pages(F.col("text"))).alias("p")).select("doc_id", "p.page_number", "p.text")


@query("document_payloads", f"SELECT source, count(*) AS page_count, sum(length(text))::BIGINT AS text_length FROM ({SQL['normalized_pages']}) GROUP BY source")
def document_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.normalize_pages(_paged(spark, sf_dir), ["source"])
    return pages.document_text(rows, ["source"]).select("source", "page_count", "text_length")


_ERROR = """CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '{"Cause": "{\\\\"errorMessage\\\\": \\\\"bad page\\\\"}"}' WHEN 1 THEN '{"Cause": "plain cause"}' WHEN 2 THEN '{"Error": "TimedOut"}' WHEN 3 THEN '{}' ELSE 'text only' END"""


@query("error_messages", "SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'bad page' WHEN 1 THEN 'plain cause' WHEN 2 THEN 'TimedOut' WHEN 3 THEN 'Pipeline failed' ELSE 'text only' END AS message FROM events")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.error_message(F.expr(_ERROR)).alias("message"))


@query("nested_hits", f"""SELECT doc_id::VARCHAR AS id, 1.0::DOUBLE / (doc_id + 1) AS score, CASE WHEN doc_id % 4 = 0 THEN '' ELSE filename END AS filename, CASE WHEN doc_id % 2 = 0 THEN 'Clause 4' END AS section,
 array_to_string(({s_standards('text')})[1:3], ';') AS standards FROM ({ORACLE_DECOR})""")
def nested_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the form of search engines, and the standards that their citations show."""
    rows = retrieval.nested(_hits(spark, sf_dir).withColumn("standards_referenced", C.standards("text")))
    return rows.select(F.col("_id").alias("id"), F.col("_score").alias("score"), "_source.filename", F.col("_source.section_reference").alias("section"), F.array_join(retrieval.shown_standards(F.col("_source")), ";").alias("standards"))


@query("shaped_hits", f"SELECT doc_id::VARCHAR AS doc_id, text, 1.0::DOUBLE / (doc_id + 1) AS score, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 9)::INTEGER END AS page FROM ({ORACLE_DECOR})")
def shaped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.shaped(_hits(spark, sf_dir)).select("citation.doc_id", "text", "score", "citation.page")


@query("chunk_lines", f"""WITH {_RECORDS} SELECT chunk_id, chunk_id AS chunkId, dataset_id AS dataset, doc_id AS file, page AS first, page_end AS last, filename AS name, text, content_hash FROM rec""")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk records as the JSON lines that readers of files expect, read again."""
    made = chunking.records(chunks(spark, sf_dir), "doc_id", tenant=F.lit("t"), dataset=F.lit("d"), filename=F.lit("f.pdf"), created_at=F.lit("now"), model=F.lit("hashed"), source_uri=F.lit(""), with_metadata=False, page_end=True)
    lines = made.select(chunking.envelope([c for c in made.columns if c != "page_end"]).alias("line"))
    place = "metadata struct<datasetId:string,fileId:string,pageRange:struct<start:int,`end`:int>,sourceFilename:string>"
    back = lines.select(F.from_json("line", f"chunk_id string, chunkId string, text string, content_hash string, {place}").alias("r")).select("r.*")
    return back.select("chunk_id", "chunkId", F.col("metadata.datasetId").alias("dataset"), F.col("metadata.fileId").alias("file"), F.col("metadata.pageRange.start").alias("first"), F.col("metadata.pageRange.end").alias("last"), F.col("metadata.sourceFilename").alias("name"), "text", "content_hash")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.streaming.ingest import event_counts

    return event_counts(table(spark, sf_dir, "events"))


#: Batches of thirds of the ids; one in 20 comes with the last batch, whatever its time.
_ARRIVES = "(CASE WHEN event_id % 20 = 7 THEN 2 ELSE least(2, event_id * 3 // (SELECT max(event_id) + 1 FROM events)) END)"


@query("event_windows_stream", f"""WITH e AS (SELECT ts, event_type, time_bucket(INTERVAL '1 hour', ts) AS start, {_ARRIVES} AS b FROM events),
mark AS (SELECT k, (SELECT max(ts) FROM e WHERE b < k) - INTERVAL '10 minutes' AS mark FROM range(4) AS t(k))
SELECT start, event_type, count(*) AS n FROM e JOIN mark ON mark.k = e.b WHERE (mark IS NULL OR start + INTERVAL '1 hour' > mark) AND start + INTERVAL '1 hour' <= (SELECT mark FROM mark WHERE k = 3) GROUP BY 1, 2""")
def event_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour as a stream of three batches: late ones are left out, and windows come once the watermark has passed."""
    from millrace.streaming.ingest import event_counts

    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    arrives = F.when(F.col("event_id") % 20 == 7, 2).otherwise(F.least(F.lit(2), F.floor(F.col("event_id") * 3 / (last + 1))))
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", arrives.cast("int").alias("arrives"))
    return _by_batches(spark, rows, "arrives", event_counts, cuts=[0.5, 1.5]).withColumn("start", F.col("start").cast("timestamp_ntz"))
