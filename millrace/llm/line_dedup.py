"""Line deduplication by overlapping three-line windows.

A text's lines are its parts between line feeds, without a trailing carriage return; lines of white space only are kept as they
are and take no part. Every three consecutive lines of the rest are a window. A window that stands anywhere in the corpus
before (smaller doc_id, then smaller position), and doesn't overlap that first place in the same text, is a later occurrence:
the lines that later occurrences cover, merged, are removed. Texts with fewer than three such lines, null and empty texts have
no window and stay as they are (null as the empty text). Rows that repeat a doc_id are one document's row each and are told
apart by their text; rows equal in both keep their lines together. Null doc_ids count as smallest.

Only DataFrame functions are used. Each window is known by two 64-bit hashes; a common window is counted by partial
aggregation before any shuffle and joined back as one row, which AQE splits where one window holds many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import unused

WINDOW = 3

LINES = "transform(split(text, '\\n'), x -> if(endswith(x, '\\r'), left(x, length(x) - 1), x))"
COUNTED = f"filter(transform({LINES}, (x, i) -> struct(i AS i, x AS x)), s -> s.x rlike '\\\\S')"


def windows(docs: DataFrame) -> DataFrame:
    """One row for each window: doc_id, row (a hash of id and text), pos (of its first line among the counted lines), at (its
    lines' places in the text), h1, h2."""
    lines = docs.select("doc_id", "row", F.expr(COUNTED).alias("l")).where(F.size("l") >= WINDOW)
    hashed = F.expr(
        f"transform(sequence(0, size(l) - {WINDOW}), p -> struct(p AS pos, array(l[p].i, l[p + 1].i, l[p + 2].i) AS at, "
        "xxhash64(l[p].x, 1, l[p + 1].x, 2, l[p + 2].x) AS h1, xxhash64('b', l[p + 2].x, l[p + 1].x, 3, l[p].x) AS h2))"
    )
    return lines.select("doc_id", "row", F.explode(hashed).alias("w")).select("doc_id", "row", "w.*")


def dedup_lines(docs: DataFrame, *, drop_columns: bool = False, counts: bool = True) -> DataFrame:
    """docs with text replaced by what is left, and on request n_lines (counted lines before) and n_removed; other columns stay unless
    dropped.

    With counts, columns of the input that are called n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed") if counts else docs
    kept = docs.select("doc_id", "text") if drop_columns else docs
    kept = kept.withColumn("text", F.coalesce("text", F.lit("")))
    row = F.xxhash64("doc_id", "text")
    every = windows(kept.select("doc_id", "text", row.alias("row")))
    first = every.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = every.join(first, ["h1", "h2"]).where(f"NOT (doc_id <=> first.doc_id AND row = first.row) OR pos >= first.pos + {WINDOW}")
    at = unused(kept, "found")
    gone = later.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone")).select(F.struct("doc_id", "row", "gone").alias(at))
    out = kept.join(gone, kept["doc_id"].eqNullSafe(gone[at]["doc_id"]) & (row == gone[at]["row"]), "left")
    # the array of one element binds the lines once, so that the work stays linear in the text
    left = f"transform(array(split(text, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), `{at}`.gone), i -> l[i]), '\\n'))[0]"
    made = {"text": F.expr(f"if(`{at}` IS NULL, text, {left})")}
    if counts:
        made |= {"n_lines": F.expr(f"cast(size({COUNTED}) AS bigint)"), "n_removed": F.expr(f"cast(if(`{at}` IS NULL, 0, size(`{at}`.gone)) AS bigint)")}
    return out.withColumns(made).drop(at)
