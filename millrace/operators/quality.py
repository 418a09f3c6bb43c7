"""Quality rules and readiness: one wide projection of findings a file, in the rules' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import construction as C
from millrace.functions import lexicon as L
from millrace.operators.duplicates import exact_duplicates, near_duplicates, superseded

SHORT_TEXT, GARBLED, NON_ALPHA, REPEATED, SMALL_CHUNK, LARGE_CHUNK = 300, 0.1, 0.5, 0.4, 500, 1500


def finding(kind: str, severity: str, when: Column, evidence: Column) -> Column:
    """A finding where the condition holds, else null. Evidence is JSON text."""
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), evidence.alias("evidence")))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))) if fields else F.lit("{}")


FACTS = ("_drawing", "_garbled", "_revision", "_date", "_kind", "_standards")


def with_facts(files: DataFrame, text: str = "text", name: str = "filename") -> DataFrame:
    """files with the columns of FACTS, so that each pattern is looked for once however often a rule needs it."""
    found = (C.is_drawing(text, name), C.garbled_ratio(text), C.revision(name, text), C.document_date(text), C.document_type(text)["doc_type"], C.standards(text))
    return files.withColumns(dict(zip(FACTS, found, strict=True)))


def text_findings(stats: Column, headers: Column | None = None, footers: Column | None = None) -> list[Column]:
    """The findings of a file alone, from its facts (of the cleaned text) and stats (of the raw one)."""
    drawing, ratio, own, date, kind, named = (F.col(c) for c in FACTS)
    length = stats["text_length"]
    short = length < SHORT_TEXT
    none = F.array().cast("array<string>")
    heads, feet = (F.coalesce(x, none) if x is not None else none for x in (headers, footers))
    return [
        finding("DRAWING_LOW_TEXT", "INFO", short & drawing, _json(textLength=length, isDrawing=F.lit(True))),
        finding("LOW_TEXT_VOLUME", "WARN", short & ~drawing, _json(textLength=length)),
        finding("POOR_OCR_QUALITY", "CRITICAL", ratio > GARBLED, _json(errorRatio=F.round(ratio, 4))),
        finding("HIGH_NON_ALPHA_RATIO", "WARN", stats["non_alpha_ratio"] > NON_ALPHA, _json(nonAlphaRatio=stats["non_alpha_ratio"])),
        finding("REPEATED_LINES", "WARN", stats["repeated_line_ratio"] > REPEATED, _json(repeatedLineRatio=stats["repeated_line_ratio"])),
        finding("HEADER_FOOTER_REMOVAL", "INFO", F.size(heads) + F.size(feet) > 0, _json(headers=heads, footers=feet)),
        finding("MISSING_DATE", "INFO", date.isNull(), _json()),
        finding("MISSING_REVISION", "INFO", own.isNull() & ~drawing & kind.isin(L.REVISED_TYPES), _json(docType=kind)),
        finding("STANDARDS_REFERENCED", "INFO", F.size(named) > 0, _json(standards=F.slice(named, 1, 10))),
    ]


def duplicate_findings(exact: Column, near: Column, other: Column) -> list[Column]:
    """Findings from joined rows of the duplicate operators; null columns where a file has none."""
    return [
        finding("EXACT_DUPLICATE", "CRITICAL", exact.isNotNull(), _json(matchingFileIds=exact["match_ids"], matches=exact["matches"])),
        finding("NEAR_DUPLICATE", "WARN", near.isNotNull(), _json(matches=near["near"], links=near["matches"])),
        finding("SUPERSEDED_VERSION", "WARN", other.isNotNull(), _json(currentRevision=other["revision"], otherFileId=other["other_file_id"], otherRevision=other["other_revision"])),
    ]


def chunk_warnings(lengths: Column) -> Column:
    """A finding for each chunk that is too short or too long, from the array of their lengths."""
    one = F.transform(
        lengths,
        lambda n: F.when(n < SMALL_CHUNK, F.struct(F.lit("CHUNK_TOO_SMALL").alias("type"), F.lit("WARN").alias("severity"), F.lit("{}").alias("evidence"))).when(
            n > LARGE_CHUNK, F.struct(F.lit("CHUNK_TOO_LARGE").alias("type"), F.lit("WARN").alias("severity"), F.lit("{}").alias("evidence"))
        ),
    )
    return F.array_compact(one)


def count_of(findings: Column, severity: str) -> Column:
    """How many findings have a severity; one without counts as INFO."""
    return F.size(F.filter(findings, lambda f: F.coalesce(f["severity"], F.lit("INFO")) == severity))


def summary(findings: Column) -> Column:
    return F.struct(*(count_of(findings, s).alias(s) for s in L.DEDUCTIONS))


def readiness(findings: Column) -> Column:
    """100 less each finding's cost, between 0 and 100."""
    cost = sum((count_of(findings, s) * c for s, c in L.DEDUCTIONS.items()), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - cost))


def adjusted(score: Column, warnings: Column) -> Column:
    """A readiness less 3 for each warning of chunks, after it was clamped, and clamped again."""
    return F.greatest(F.lit(0), F.least(F.lit(100), score - 3 * count_of(warnings, "WARN")))


def assess(files: DataFrame, visibility: str = "snapshot") -> DataFrame:
    """tenant_id, file_id, findings, summary and readiness of files with tenant_id, file_id, filename, created_at, raw_sha256,
    simhash, text (cleaned), stats, headers, footers. All files of the table see each other, whenever they came; with visibility
    "as_of" each sees the ones before it. Near duplicates are looked for among all of the tenant's files, other revisions among its
    newest."""
    keys = ["tenant_id", "file_id"]
    slim = files.select(*keys, "filename", "created_at", "raw_sha256", "simhash", F.substring("text", 1, 2000).alias("head"))
    parts = {"exact": exact_duplicates(slim, visibility=visibility), "near": near_duplicates(slim, limit=None, visibility=visibility), "other": superseded(slim, "head", visibility=visibility)}
    joined = with_facts(files)
    for name, part in parts.items():
        fields = [c for c in part.columns if c not in keys]
        joined = joined.join(part.select(*keys, F.struct(*fields).alias(name)), keys, "left")
    found = duplicate_findings(F.col("exact"), F.col("near"), F.col("other")) + text_findings(F.col("stats"), F.col("headers"), F.col("footers"))
    out = joined.select(*keys, F.array_compact(F.array(*found)).alias("findings"))
    return out.select(*keys, "findings", summary(F.col("findings")).alias("summary"), readiness(F.col("findings")).alias("readiness"))
