"""The opN_ queries: each thin query applies one operator to its whole table, and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text: every document's text without later occurrences of three-line windows."""
    from millrace.llm.line_dedup import dedup_lines

    return dedup_lines(common.documents(spark, sf_dir), drop_columns=True).select("doc_id", "n_lines", "n_removed", "text")


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) AS r(i)),
counted AS (
  SELECT doc_id, i, regexp_replace(line, '\r$', '') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
  FROM lines WHERE regexp_matches(line, '[^ \t\r\x0b\f]')),
w AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c, row_number() OVER g AS k
  FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY pos), g AS (PARTITION BY doc_id ORDER BY pos DESC)),
f AS (
  SELECT doc_id, pos, first_value(doc_id) OVER p AS fd, first_value(pos) OVER p AS fp
  FROM w WHERE k >= 3 WINDOW p AS (PARTITION BY a, b, c ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM f, range(0, 3) AS r(d) WHERE doc_id <> fd OR pos >= fp + 3),
kept AS (
  SELECT l.doc_id, count(c.pos) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN counted c ON l.doc_id = c.doc_id AND l.i = c.i LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.pos = g.pos
  GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, text FROM kept
"""

def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    import public_tokenizers

    from millrace.llm.pattern_packing import pack

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, digested, and the digest of what they decode to."""
    import public_tokenizers

    from millrace.llm.byte_bpe import round_trip

    return round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's number of tokens under the pieces of piece_bpe_32k.model and their scores, taken as a unigram vocabulary."""
    import public_tokenizers

    from millrace.llm.token_counts import count_tokens

    return count_tokens(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an Ogg medium, stored, read back and digested."""
    from millrace.llm.ogg import digest_texts

    return digest_texts(common.documents(spark, sf_dir))


def _scored(docs: DataFrame, model, folds: int, held: int) -> DataFrame:
    from millrace.llm.byte_cnn import score_texts

    return score_texts(docs, model).select("doc_id", (common.crc_mod("doc_id", folds) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality; labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1."""
    from millrace.llm.byte_cnn import fit_quality

    docs = common.documents(spark, sf_dir)
    return _scored(docs, fit_quality(docs, common.table(spark, sf_dir, "labels"), "quality", 3, 1), 3, 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity; labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0."""
    from millrace.llm.toxicity import fit_toxicity

    docs = common.documents(spark, sf_dir)
    return _scored(docs, fit_toxicity(docs, common.table(spark, sf_dir, "labels"), "toxic", 5, 0), 5, 0)


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates: five-word elements, similarity of 0.8 or more."""
    from millrace.llm.dart_minhash import near_duplicates

    return near_duplicates(common.documents(spark, sf_dir))


def op2_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of each vector whose id is divisible by 20, against all other vectors."""
    from millrace.llm.block_topk import top_k, whole

    return top_k(whole(common.table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row AS query, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score; the model learns from rows whose crc32(doc_id as text) mod 5 is not 1."""
    from millrace.llm.deleted_interpolation import score

    return score(common.documents(spark, sf_dir), 5, 1)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut for fill-in-the-middle, the digests of its output and of the text that is rebuilt from it."""
    from millrace.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(common.documents(spark, sf_dir))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


OP12_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
d AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
x AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""


def op13_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that stand in an exact match of ten words of a benchmark item, and whose."""
    from millrace.llm.positional_index import contamination

    found = contamination(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ph AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM iw, range(1, greatest(len(w) - 9, 1) + 1) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM ph),
dp AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM dw, lens, range(1, greatest(len(w) - m + 2, 1)) AS t(i)),
hits AS (SELECT dp.r, dp.i, dp.m, ph.item_id FROM dp JOIN ph ON dp.p = ph.p AND dp.m = ph.m),
hit AS (SELECT r, count(DISTINCT i + d) AS n_hit FROM hits, range(0, m) AS t(d) GROUP BY r),
whose AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN whose USING (r)
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words' number, its form and the root that forms lead to."""
    from millrace.llm.spelling import variants

    return variants(common.documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
own AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS d, r, count(*) AS n FROM run GROUP BY ALL),
byte AS (SELECT r, n, list_transform(regexp_extract_all(hex(encode(d || ':' || r)), '..'), lambda y: ('0x' || y)::BIGINT) AS b FROM own),
hash AS (SELECT r, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM byte, crc),
seen AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hash),
w AS (SELECT word, sum(n)::BIGINT AS n FROM seen WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, range(1, length(word) + 1) AS t(i)),
less AS (SELECT DISTINCT cut.word AS a, cut.n AS an, w.word AS b, w.n AS bn FROM cut JOIN w ON cut.rest = w.word),
near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT a, an, b, bn FROM less UNION SELECT b, bn, a, an FROM less),
best AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word, n),
form AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at, form AS next FROM form UNION ALL SELECT way.word, form.word, form.form FROM way JOIN form ON way.next = form.word)
SELECT form.word, form.form, way.at AS root, n, n_near, form_n FROM form JOIN way ON form.word = way.word AND way.next IS NULL
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_pattern_packing": op5_pattern_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op6_byte_cnn": op6_byte_cnn,
    "op9_toxicity": op9_toxicity,
    "op4_dart_minhash": op4_dart_minhash,
    "op2_block_topk": op2_block_topk,
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op10_ogg": op10_ogg,
    "op11_spelling": op11_spelling,
    "op12_fill_middle": op12_fill_middle,
    "op13_positional_index": op13_positional_index,
}
ORACLE_SQL: dict[str, str] = {"op2_block_topk": OP2_SQL, "op8_line_dedup": OP8_SQL, "op11_spelling": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_positional_index": OP13_SQL}
