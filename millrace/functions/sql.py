"""The column functions for users of SQL: temporary functions with the same names, and the chunker as a table function.

A function's SQL is made of its Column, so there is one definition of each; only those whose Columns hold no lambda have a SQL text
(kinds, trades, dates, revisions and lists of lines are for DataFrames). The table function takes a table with doc_id, page_number
and text: SELECT * FROM chunked(TABLE(pages)); it folds a document's pages in a Python worker, to the rows that
operators.chunking.chunk_documents makes natively.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from millrace.functions import construction as C
from millrace.functions import text as X
from millrace.operators.chunking import LONGEST, OVERLAP, SECTION, SHORTEST, WHITE

_ID = {"doc_id": "STRING", "page": "INT", "chunk_index": "INT"}
#: name: (arguments with their types, the Column function).
FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    **{n: ({"t": "STRING"}, f) for n, f in (
        ("strip_text", X.strip), ("normalize_whitespace", X.normalize_whitespace), ("dehyphenate", X.dehyphenate), ("collapse", X.collapse), ("word_tokens", X.tokens), ("token_hash", X.token_hash),
        ("non_alpha_ratio", X.non_alpha_ratio), ("base_name", C.base_name), ("standard_title", C.standard_title), ("abbreviation", C.abbreviation), ("expand_query", C.expand_query), ("is_section_line", C.is_section_line),
        ("error_message", C.error_message),
    )},
    "clean_text": ({"t": "STRING"}, lambda t: X.normalize_whitespace(X.dehyphenate(t))),
    "snippet": ({"t": "STRING"}, lambda t: X.snippet(t, 260)),
    "hamming": ({"a": "BIGINT", "b": "BIGINT"}, X.hamming),
    "unsigned_text": ({"a": "BIGINT"}, X.unsigned),
    "chunk_id": (_ID, X.chunk_id),
    "content_hash": (_ID | {"t": "STRING"}, X.content_hash),
}
CHUNKED = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.StringType()), ("chunk_index", T.IntegerType()), ("text", T.StringType()), ("page_start", T.IntegerType()), ("page_end", T.IntegerType()), ("length", T.IntegerType()))])
_BREAK = re.compile(SECTION, re.ASCII)


def pieces(text: str, longest: int = LONGEST) -> Iterator[str]:
    """A page's pieces, as operators.chunking.cut makes them."""
    start = 0
    while start < len(text):
        head = text[start : start + longest]
        end = len(head)
        if start + longest < len(text):
            space = head.rfind(" ")
            end = m.start() if (m := _BREAK.search(head, 1)) else space if space > longest * 0.6 else longest
        if piece := head[:end].strip(WHITE):
            yield piece
        start += end


class Chunked:
    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or not {"doc_id", "page_number", "text"} <= set(pages.dataType.names):
            raise ValueError("chunked takes a table with doc_id, page_number and text")
        kind = pages.dataType["doc_id"].dataType
        return AnalyzeResult(T.StructType([T.StructField("doc_id", kind), *CHUNKED.fields[1:]]), partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("page_number"), OrderingColumn("text")])

    def __init__(self) -> None:
        self.doc, self.n, self.held, self.span = None, 0, "", []

    def _row(self) -> tuple:
        numbers = [p for p in self.span if p is not None]
        self.n += 1
        return self.doc, self.n - 1, self.held, min(numbers, default=None), max(numbers, default=None), len(self.held)

    def eval(self, row: T.Row) -> Iterator[tuple]:
        self.doc, page = row["doc_id"], row["page_number"]
        for piece in pieces((row["text"] or "").strip(WHITE)):
            if len(self.held) >= SHORTEST and len(self.held) + 1 + len(piece) > LONGEST:
                yield self._row()
                room = LONGEST - len(piece) - 1
                tail = self.held[-OVERLAP:].strip(WHITE)[-room:] if room > 0 else ""
                self.held, self.span = f"{tail} {piece}".strip(WHITE), [self.span[-1], page]
            else:
                self.held, self.span = f"{self.held} {piece}".strip(WHITE), [*self.span, page]

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self._row()


def text_of(spark: SparkSession, function: Callable[..., Column], arguments: dict[str, str]) -> tuple[str, str]:
    """The SQL of a Column function of arguments, and its type."""
    none = spark.range(1).select(*(F.lit(None).cast(k).alias(n) for n, k in arguments.items()))
    made = none.select(function(*(F.col(n) for n in arguments)).alias("v"))
    return made._jdf.queryExecution().analyzed().expressions().head().child().sql(), made.schema["v"].dataType.simpleString()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the functions known to a session's SQL, and gives their names."""
    for name, (arguments, function) in FUNCTIONS.items():
        sql, kind = text_of(spark, function, arguments)
        taken = ", ".join(f"{n} {k}" for n, k in arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({taken}) RETURNS {kind} RETURN {sql}")
    spark.udtf.register(f"{prefix}chunked", F.udtf(Chunked))
    return [f"{prefix}{n}" for n in (*FUNCTIONS, "chunked")]
