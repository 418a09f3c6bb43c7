"""Retrieval: shaping hits, citations and source blocks, prompts, and a conversation's history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.construction import expand_query
from millrace.functions.text import snippet
from millrace.operators.vectors import search

SNIPPET, CONTEXT, TITLE, SHOWN = 260, 1200, 60, 3

# --- fixed values: what is said without sources; the follow-up goes around the message ---
NO_ANSWER = "I do not know based on the available sources."
FOLLOW_UP = (
    "Based on our previous conversation, the user asks: ",
    "\n\nNote: No new relevant sources were found for this specific question. Please respond based on the conversation context if possible, or indicate if you need more specific information.",
)


def shaped(hits: DataFrame) -> DataFrame:
    """text, score and citation of hits; null texts are empty, null and NaN scores 0."""
    citation = F.struct("filename", "page", "chunk_id", "doc_id").alias("citation")
    return hits.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score"), citation)


def nested(hits: DataFrame) -> DataFrame:
    """Hits in the form that search engines give: _id, _score and _source."""
    fields = ("chunk_id", "doc_id", "filename", "page", "text", "doc_type", "discipline", "section_reference", "standards_referenced")
    return hits.select(F.col("chunk_id").alias("_id"), F.col("score").alias("_score"), F.struct(*fields).alias("_source"))


def shown_standards(citation: Column) -> Column:
    """The standards that a citation shows; none for null."""
    return F.slice(F.coalesce(citation["standards_referenced"], F.array().cast("array<string>")), 1, SHOWN)


def _filled(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def citation() -> Column:
    """Struct of a hit's citation."""
    return F.struct(
        "chunk_id", F.coalesce(_filled("filename"), F.lit("source")).alias("filename"), "page", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"),
        snippet("text", SNIPPET).alias("snippet"), _filled("doc_type").alias("doc_type"), _filled("discipline").alias("discipline"),
        _filled("section_reference").alias("section_reference"), "standards_referenced",
    )


def source_block(number: Column) -> Column:
    """A hit's numbered heading with its text below."""
    part = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    head = F.concat(
        F.lit("[S"), number.cast("string"), F.lit("] "), F.coalesce(_filled("filename"), F.lit("source")), part(" [", F.upper(_filled("doc_type")), "]"),
        part(" p", F.col("page").cast("string")), part(" §", _filled("section_reference")),
    )
    return F.concat(head, F.lit("\n"), snippet("text", CONTEXT))


def citations(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each query (of the columns `by`; at most k hits each): citations in order of score, and their source text."""
    by = by or []
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("score"), "chunk_id")
    rows = hits.withColumn("n", F.row_number().over(order)).select(*by, F.struct("n", citation().alias("c"), source_block(F.col("n")).alias("s")).alias("row"))
    sorted_rows = F.array_sort(F.collect_list("row"))
    out = rows.groupBy(*by).agg(sorted_rows.alias("rows"))
    return out.select(*by, F.transform("rows", lambda r: r["c"]).alias("citations"), F.array_join(F.transform("rows", lambda r: r["s"]), "\n\n").alias("sources"))


def prompt(question: Column, sources: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nSources:\n"), sources, F.lit("\n\nAnswer:"))


def turn(message: Column, sources: Column, n_sources: Column, n_before: Column) -> Column:
    """Struct of the prompt for a model and the answer that needs none: with sources they are given, without them the model may
    follow the conversation, and without either the answer is fixed."""
    follow = F.concat(F.lit(FOLLOW_UP[0]), message, F.lit(FOLLOW_UP[1]))
    asked = F.when(n_sources > 0, prompt(message, sources)).when(n_before > 0, follow)
    return F.struct(asked.alias("prompt"), F.when(asked.isNull(), F.lit(NO_ANSWER)).alias("answer"))


def title(message: Column) -> Column:
    return F.left(message, F.lit(TITLE))


def history(messages: DataFrame, by: list[str], order: list[str], limit: int = 20, mode: str = "first") -> DataFrame:
    """Messages of users and assistants among each conversation's `limit` first ones ("first", as the reference reads them: the
    limit comes before the roles), or the last `limit` of those roles ("recent")."""
    roles = F.col("role").isin("user", "assistant")
    if mode not in ("first", "recent"):
        raise ValueError("mode is first or recent")
    rows = messages.where(roles) if mode == "recent" else messages
    at = Window.partitionBy(*by).orderBy(*(F.desc(c) if mode == "recent" else F.asc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= limit).where(roles).drop("_n")


def retrieve(chunks: DataFrame, tenant: str, dataset: str, question: str, embedder: Callable[[str], list[float]], k: int = 8, expand: bool = True, size: int = 1024) -> DataFrame:
    """Hits for a question: its abbreviation is spelt out (for chats), embedded, and searched for. Vectors are of `size` numbers."""
    question = question.strip()
    if not question or not dataset:
        raise ValueError("a question and a dataset are needed")
    if expand:
        question = chunks.sparkSession.range(1).select(expand_query(F.lit(question))).first()[0]
    vector = embedder(question)
    if len(vector) != size:
        raise ValueError(f"embedding size is not {size} but {len(vector)}")
    return search(chunks, tenant, dataset, vector, k)


def eligible(datasets: DataFrame, tenant: Column) -> Column:
    """200, 404 (no such dataset of the tenant) or 409 (not ready), of rows with tenant_id (null: no row) and status."""
    return F.when(F.col("tenant_id").isNull() | (F.col("tenant_id") != tenant), 404).when(F.coalesce("status", F.lit("")) != "READY", 409).otherwise(200)
