"""Pages of files to readiness reports and chunk records: the whole way as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import extraction_stats
from millrace.operators import chunking, duplicates, pages, quality
from millrace.options import Options
from millrace.session import stored

KEYS = ["tenant_id", "file_id"]


def prepare(raw: DataFrame, files: DataFrame) -> DataFrame:
    """files with pages (cleaned, in order), text (theirs), stats (of the raw pages), headers, footers, boilerplate, confidence and
    simhash. raw: tenant_id, file_id, page_number, text. The pages are cleaned once, and a file's come together once. A file without
    pages, or without tenant or id, has an empty text."""
    cleaned = pages.normalize_pages(raw.withColumn("raw", F.coalesce("text", F.lit(""))), KEYS)
    page = F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"), "raw")
    lists = ("headers", "footers", "boilerplate", "confidence")
    docs = cleaned.groupBy(*KEYS).agg(F.array_sort(F.collect_list(page)).alias("pages"), *(F.first(c).alias(c) for c in lists))
    joined = lambda field, by: F.array_join(F.transform("pages", lambda p: p[field]), by)
    docs = stored(docs.withColumns({"text": joined("text", "\n\n"), "stats": extraction_stats(joined("raw", "\n"), F.size("pages").cast("long"))}))  # for the fingerprints, too
    found = files.join(docs, KEYS, "left").join(duplicates.simhash(docs, KEYS), KEYS, "left")
    none = F.array().cast("array<string>")
    bare = {"pages": F.array().cast(docs.schema["pages"].dataType), "text": F.lit(""), "simhash": F.lit(0).cast("long"), "confidence": F.lit(0.0), "headers": none, "footers": none, "boilerplate": none}
    bare["stats"] = extraction_stats(F.lit(""), F.lit(0).cast("long")).cast(docs.schema["stats"].dataType)
    return found.withColumns({c: F.coalesce(c, x) for c, x in bare.items()})


def reports(raw: DataFrame, files: DataFrame, visibility: str | None = None, options: Options | None = None) -> DataFrame:
    """tenant_id, file_id, findings (with the chunks' warnings), summary, readiness, chunk_count, lengths (of the chunks). Files
    without tenant or id have none."""
    options = options or Options()
    ready = stored(prepare(raw, files))  # the rules on other files read it again
    made = chunking.chunks(F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), p["text"].alias("text"))), **options.chunking)
    lengths = ready.select(*KEYS, F.transform(made, lambda c: c["length"]).alias("lengths"))
    out = quality.assess(ready, visibility or options.visibility).join(lengths, KEYS)
    warnings = quality.chunk_warnings(F.col("lengths"))
    every = F.concat("findings", warnings)
    return out.select(*KEYS, every.alias("findings"), quality.summary(every).alias("summary"), quality.adjusted(F.col("readiness"), warnings).alias("readiness"), F.size("lengths").alias("chunk_count"), "lengths")
