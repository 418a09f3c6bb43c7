"""Reports and documents as the JSON files that readers expect, where they lie, and what a finished job's row says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions.text import bound
from millrace.operators.quality import LARGE_CHUNK, SMALL_CHUNK

VERSION = "1.0"
_IDS = {"tenant_id": "tenantId", "dataset_id": "datasetId", "file_id": "fileId"}


def processed_key(name: str) -> Column:
    """Where a file's processed object of this name is."""
    return F.concat_ws("/", F.lit("processed"), *(F.col(c).cast("string") for c in _IDS), F.lit(name))


def artifacts() -> Column:
    """A job's map of what was made of its file."""
    names = {"extractedTextKey": "extracted.txt", "documentJsonKey": "document.json", "chunksJsonlKey": "chunks.jsonl", "qualityReportKey": "quality_report.json"}
    return F.create_map(*(x for k, n in names.items() for x in (F.lit(k), processed_key(n))))


def _text(kind: Column, place: int, value: Column) -> Column:
    """What is said of a kind of finding: its description (0) or recommendation (1)."""
    said = F.create_map(*(F.lit(x) for k, texts in L.FINDING_TEXTS.items() for x in (k, texts[place])))
    return F.replace(F.try_element_at(said, kind), F.lit("{}"), F.coalesce(value, F.lit("")))


def _value(kind: Column, evidence: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, path in L.FINDING_VALUES.items():
        out = F.when(kind == k, F.get_json_object(evidence, path)).otherwise(out)
    return out


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return bound(F.to_json(F.array(text)), lambda j: F.substring(j, 2, F.length(j) - 2))


def _fields(**parts: Column) -> Column:
    """A JSON object of values that are JSON already."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), c) for n, c in parts.items())), F.lit("}"))


def described(findings: Column) -> Column:
    """Findings of files (type, severity, evidence as JSON) with their texts, each as JSON."""

    def one(f: Column) -> Column:
        value = _value(f["type"], f["evidence"])
        return _fields(type=_quoted(f["type"]), severity=_quoted(f["severity"]), description=_quoted(_text(f["type"], 0, value)), evidence=f["evidence"], recommendation=_quoted(_text(f["type"], 1, value)))

    return F.transform(findings, one)


def described_warnings(lengths: Column) -> Column:
    """The warnings of chunks' lengths with their texts, each as JSON; they have no evidence."""
    odd = F.filter(lengths, lambda n: (n < SMALL_CHUNK) | (n > LARGE_CHUNK))

    def one(n: Column) -> Column:
        kind = F.when(n < SMALL_CHUNK, "CHUNK_TOO_SMALL").otherwise("CHUNK_TOO_LARGE")
        description, recommendation = (_quoted(_text(kind, i, n.cast("string"))) for i in (0, 1))
        return _fields(type=_quoted(kind), severity=F.lit('"WARN"'), description=description, recommendation=recommendation)

    return F.transform(odd, one)


def quality_reports(reports: DataFrame) -> DataFrame:
    """key and payload (JSON) of the quality reports of plans.readiness.reports, with dataset_id."""
    own = F.filter("findings", lambda f: ~F.startswith(f["type"], F.lit("CHUNK_")))
    head = F.to_json(F.struct(F.lit(VERSION).alias("schemaVersion"), *(F.col(c).cast("string").alias(n) for c, n in _IDS.items()), F.col("readiness").alias("readinessScore"), "summary"))
    payload = F.concat(F.left(head, F.length(head) - 1), F.lit(',"findings":'), F.lit("["), F.array_join(F.concat(described(own), described_warnings(F.col("lengths"))), ","), F.lit("]}"))
    return reports.select(*_IDS, processed_key("quality_report.json").alias("key"), payload.alias("payload"))


def documents(prepared: DataFrame, created_at: Column) -> DataFrame:
    """key and payload (JSON) of the documents of plans.readiness.prepare, with dataset_id and filename. Text length is that of the
    pages, without what joins them."""
    pages = F.transform("pages", lambda p: F.struct(p["page_number"].alias("pageNumber"), p["text"].alias("text")))
    length = F.aggregate("pages", F.lit(0), lambda n, p: n + F.length(p["text"]))
    extraction = F.struct(*(F.col(f"stats.{c}").alias(n) for c, n in (("text_length", "textLength"), ("page_count", "pageCount"), ("non_alpha_ratio", "nonAlphaRatio"), ("repeated_line_ratio", "repeatedLineRatio"))))
    normalization = F.struct(F.col("headers").alias("removedHeaderLines"), F.col("footers").alias("removedFooterLines"), F.col("boilerplate").alias("removedBoilerplateLines"), F.col("confidence").alias("headerFooterConfidence"))
    payload = F.struct(
        F.lit(VERSION).alias("schemaVersion"), *(F.col(c).cast("string").alias(n) for c, n in _IDS.items()), F.col("filename").alias("sourceFilename"), F.size("pages").alias("pageCount"), length.alias("textLength"),
        extraction.alias("extraction"), normalization.alias("normalization"), pages.alias("pages"), created_at.alias("createdAt"),
    )
    return prepared.select(*_IDS, processed_key("document.json").alias("key"), F.to_json(payload).alias("payload"))


def finished_jobs(reports: DataFrame, job_id: Column, at: Column) -> DataFrame:
    """What the jobs' rows are updated with, by tenant_id, file_id and job_id."""
    summary = F.create_map(*(x for s in L.DEDUCTIONS for x in (F.lit(s), F.col(f"summary.{s}").cast("int"))))
    return reports.select("tenant_id", "file_id", job_id.alias("job_id"), F.lit("COMPLETE").alias("status"), at.alias("finished_at"), F.col("readiness").alias("readiness_score"), summary.alias("findings_summary"), artifacts().alias("artifacts"))
