"""Pages of documents: repeated headers, footers and boilerplate, their removal, and statistics over a document's pages.

Tables of pages have a document's key, page_number (from 1) and text. Lines are counted by partial aggregation before the
shuffle; a document's pages are brought together only as arrays of their texts, which are bounded by the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import dehyphenate, normalize_whitespace, remove_lines, split_lines


def clean_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with hyphens at line ends joined, then white space in order."""
    return pages.withColumn(text, normalize_whitespace(dehyphenate(F.coalesce(F.col(text), F.lit("")))))


def _frequent(pages: DataFrame, keys: list[str], edge: tuple[int, float] | None, plate: float | None) -> DataFrame:
    """keys, kind, line, n of the lines that stand on enough pages, all kinds in one pass over the texts. edge: how many lines of
    a page's beginning and end count, and the share of pages; plate: the share for lines anywhere."""
    lines, tagged = F.col("lines"), []
    tag = lambda rows, kind: F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("line")))
    if edge:
        count, share = edge
        last = F.slice(lines, F.greatest(F.size(lines) - count + 1, F.lit(1)), count)
        tagged += [tag(F.slice(lines, 1, count), "header"), tag(last, "footer")]
    if plate:
        tagged.append(tag(F.array_distinct(lines), "boilerplate"))
    anywhere = F.col("kind") == "boilerplate"
    rows = pages.select(*keys, split_lines("text").alias("lines")).select(*keys, F.explode(F.concat(*tagged)).alias("e")).select(*keys, "e.kind", "e.line")
    counted = rows.where(F.length("line") > F.when(anywhere, 4).otherwise(3)).groupBy(*keys, "kind", "line").agg(F.count("*").alias("n"))
    of_pages = F.when(anywhere, float(plate or 0)).otherwise(float(edge[1] if edge else 0))  # a double: 0.7 of 90 pages is 62.99..
    totals = pages.groupBy(*keys).agg(F.count("*").alias("pages"))
    return counted.where("n > 1").join(totals, keys).where(F.col("n") >= F.floor(F.col("pages") * of_pages)).select(*keys, "kind", "line", "n")


def repeated_edges(pages: DataFrame, keys: list[str], line_count: int = 2, share: float = 0.6) -> DataFrame:
    """keys, kind ("header" or "footer"), line, n: lines among the first or last line_count of enough pages. Blank pages count
    among a document's pages."""
    return _frequent(pages, keys, (line_count, share), None)


def boilerplate(pages: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """keys, line, n: lines that stand on enough of a document's pages."""
    return _frequent(pages, keys, None, share).drop("kind")


def removal_lists(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, headers, footers, boilerplate (sorted arrays) and confidence (3 places) of every document."""
    lists = {"headers": "header", "footers": "footer", "boilerplate": "boilerplate"}
    found = _frequent(pages, keys, (2, 0.6), 0.7).groupBy(*keys).agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("line")))).alias(c) for c, k in lists.items()))
    out = pages.groupBy(*keys).agg(F.count("*").alias("pages")).join(found, keys, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in lists})
    share = F.least(F.lit(1.0), (F.size("headers") + F.size("footers")) / F.greatest(F.lit(1), F.col("pages")))
    return out.withColumn("confidence", F.round(share, 3)).drop("pages")


def normalize_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Cleaned pages without their document's repeated lines, and the lists of those."""
    cleaned = clean_pages(pages)
    lists = removal_lists(cleaned, keys)
    gone = F.array_union(F.array_union("headers", "footers"), "boilerplate")
    return cleaned.join(lists, keys).withColumn("text", remove_lines("text", gone))


def document_text(pages: DataFrame, keys: list[str], joiner: str = "\n\n") -> DataFrame:
    """keys, text (pages in order), page_count, text_length (of the pages, without joiners)."""
    rows = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(*keys).agg(
        F.array_join(F.transform(rows, lambda p: p["text"]), joiner).alias("text"), F.count("*").alias("page_count"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("text_length")
    )
