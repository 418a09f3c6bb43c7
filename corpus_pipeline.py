"""The corpus pipeline: quality, toxicity, line dedup, near-dedup and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of `documents`; the last one returns the
packed pieces. Between stages the rows are written as Parquet in the shared folder and read again, so that a lost executor
repeats work of one stage at most. Two stages learn from `labels`; nothing else but `documents` is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality is 0.5 or more."""
    from millrace.llm.byte_cnn import fit_quality

    return common.keep_texts(docs, fit_quality(docs, common.table(spark, sf_dir, "labels")), lambda score: score >= 0.5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity is under 0.5."""
    from millrace.llm.toxicity import fit_toxicity

    return common.keep_texts(docs, fit_toxicity(docs, common.table(spark, sf_dir, "labels")), lambda score: score < 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of three-line windows; a document keeps its row, even if nothing of its text is left."""
    from millrace.llm.line_dedup import dedup_lines

    left = dedup_lines(docs, counts=False)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one of least doc_id; emptied texts are one class."""
    from millrace.llm.dart_minhash import keep_one

    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    import public_tokenizers

    from millrace.llm.pattern_packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [("quality", quality), ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]
#: The classifiers and the tokenizer have no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
