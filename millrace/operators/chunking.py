"""Chunks of documents for retrieval: section-aware cuts of long pages, packed with overlap.

A document's pages come as one array; a chunk depends on the one before it, so pages are cut and pieces packed by ordered folds over
arrays, documents in parallel. Only native functions are used. A long page is read by blocks, so work is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.construction import metadata
from millrace.functions.lexicon import SECTION_LINES
from millrace.functions.text import bound, chunk_id, content_hash

SHORTEST, LONGEST, OVERLAP = 800, 1200, 200
#: A line's end before a line that begins a section; white space within the line only.
SECTION = r"(?i)\n[^\S\n]*(?:" + "|".join(p.replace(r"\s+", r"[^\S\n]+") for p in SECTION_LINES) + ")"
#: What is cut off the ends of pages and pieces: white space, beyond ASCII's as well.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def cut_at(head: Column, sections: bool = True) -> Column:
    """Where to cut a text that is too long, from its first `longest` characters: before the first section line, else at the last
    space of the last two fifths, else at the end."""
    n = F.length(head)
    at = bound(n - F.length(F.substring_index(head, " ", -1)) - 1, lambda space: F.when(space > n * 0.6, space).otherwise(n))
    if not sections:
        return at
    rest = F.substring(head, 2, n)  # a break at the very beginning would cut nothing off
    parts = F.when(F.contains(rest, F.lit("\n")), F.split(rest, SECTION, 2)).otherwise(F.array(rest))
    return bound(parts, lambda p: F.when(F.size(p) > 1, F.length(p[0]) + 1).otherwise(at))


def cut(text: Column, longest: int = LONGEST, sections: bool = True) -> Column:
    """The stripped pieces of a text, none longer than `longest` characters and none empty."""
    size = 4 * longest  # of a block: what is looked at next lies in two of them

    def pieces(page: Column) -> Column:
        # each cut takes a line's end or three fifths of `longest`, so there are no more of them
        lines = F.length(page["text"]) - F.length(F.replace(page["text"], F.lit("\n"), F.lit("")))
        most = (lines + F.ceil(page["n"] / (0.6 * longest)) + 1).cast("int")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(s: Column) -> Column:
            block = F.floor(s["at"] / size).cast("int")
            after, here = s["at"] - block * size, F.get(page["blocks"], block)
            near = F.when(after + longest <= size, here).otherwise(F.concat(here, F.coalesce(F.get(page["blocks"], block + 1), F.lit(""))))
            head = F.substring(near, after + 1, F.lit(longest))
            whole = page["n"] - s["at"] <= longest
            ends = lambda h: F.struct(h.alias("head"), F.when(whole, F.length(h)).otherwise(cut_at(h, sections)).cast("int").alias("end"))
            piece = lambda e: F.struct((s["at"] + e["end"]).alias("at"), F.concat(s["out"], F.array(_strip(F.left(e["head"], e["end"])))).alias("out"))
            return bound(head, lambda h: bound(ends(h), piece))

        return F.aggregate(F.sequence(F.lit(1), most), start, lambda s, _: F.when(s["at"] >= page["n"], s).otherwise(step(s)), lambda s: s["out"])

    blocks = lambda t: F.struct(t.alias("text"), F.length(t).alias("n"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("blocks"))
    every = lambda t: F.when(F.length(t) <= longest, F.array(t)).otherwise(bound(blocks(t), pieces))
    return F.filter(bound(_strip(text), every), lambda x: x != "")


def chunks(pages: Column, shortest: int = SHORTEST, longest: int = LONGEST, overlap: int = OVERLAP, sections: bool = True) -> Column:
    """Chunks (array<struct<text, page_start, page_end, length>>) of an array of struct<page_number, text> in order; null for a null
    array. A chunk is closed when the next piece would make it too long and it is long enough; the next one begins with its end, as
    much as fits. Lengths stay within shortest + longest."""
    of_page = lambda p: F.transform(cut(F.coalesce(p["text"], F.lit("")), longest, sections), lambda x: F.struct(p["page_number"].cast("int").alias("page"), x.alias("text"), F.length(x).alias("n")))
    none = F.array().cast("array<struct<text:string,page_start:int,page_end:int,length:int>>")
    start = F.struct(none.alias("done"), F.lit("").alias("held"), *(F.lit(None).cast("int").alias(c) for c in ("low", "high", "last")))

    def closed(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["held"].alias("text"), s["low"].alias("page_start"), s["high"].alias("page_end"), F.length(s["held"]).alias("length"))))

    def state(done: Column, before: Column, x: Column, low: Column, high: Column) -> Column:
        held = _strip(F.concat(before, F.lit(" "), x["text"]))
        return F.struct(done.alias("done"), held.alias("held"), F.least(low, x["page"]).alias("low"), F.greatest(high, x["page"]).alias("high"), x["page"].alias("last"))

    def step(s: Column, x: Column) -> Column:
        n = F.length(s["held"])
        tail = F.right(_strip(F.right(s["held"], F.lit(overlap))), longest - x["n"] - 1)
        full = (n >= max(shortest, 1)) & (n + 1 + x["n"] > longest)
        return F.when(full, state(closed(s), tail, x, s["last"], s["last"])).otherwise(state(s["done"], s["held"], x, s["low"], s["high"]))

    return F.aggregate(F.flatten(F.transform(pages, of_page)), start, step, lambda s: F.when(s["held"] != "", closed(s)).otherwise(s["done"]))


def chunk_documents(pages: DataFrame, keys: list[str], **options) -> DataFrame:
    """keys, chunk_index (from 0), text, page_start, page_end, length of pages with page_number and text."""
    rows = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    made = rows.select(*keys, F.posexplode(chunks(F.col("pages"), **options)).alias("chunk_index", "c"))
    return made.select(*keys, "chunk_index", "c.*")


def records(made: DataFrame, doc: str, *, tenant: Column, dataset: Column, filename: Column, created_at: Column, model: Column, source_uri: Column, with_metadata: bool = True, page_end: bool = False) -> DataFrame:
    """Chunk records, keyed by where the chunk stands, with what its text says of itself; on request with the last page, which is no
    field of a record but of its envelope."""
    base = made.select(
        tenant.alias("tenant_id"), dataset.alias("dataset_id"), F.col(doc).cast("string").alias("doc_id"), source_uri.alias("source_uri"), filename.alias("filename"),
        F.col("page_start").alias("page"), chunk_id(doc, "page_start", "chunk_index").alias("chunk_id"), "chunk_index", "text", created_at.alias("created_at"),
        model.alias("embedding_model"), content_hash(doc, "page_start", "chunk_index", "text").alias("content_hash"), F.array().cast("array<string>").alias("acl"),
        *(["page_end"] if page_end else []),
    )
    return base.select("*", metadata("text").alias("m")).select(*base.columns, "m.*") if with_metadata else base


def envelope(record_columns: list[str], page_end: str = "page_end") -> Column:
    """A record as one JSON line, with its key and place again in the form that readers of the files expect."""
    place = F.struct(F.col("dataset_id").alias("datasetId"), F.col("doc_id").alias("fileId"), F.struct(F.col("page").alias("start"), F.col(page_end).alias("end")).alias("pageRange"), F.col("filename").alias("sourceFilename"))
    return F.to_json(F.struct(*record_columns, F.col("chunk_id").alias("chunkId"), place.alias("metadata")))
