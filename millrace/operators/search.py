"""A table of questions against a table of chunks: exact cosine top-k by matrix products of blocks.

Questions and chunks meet by tenant and dataset (or any columns). A dataset's chunks are dealt to blocks of some BLOCK rows by a hash of
their key, its questions to blocks of some ASKED rows, and each pair of blocks is one matrix product; a dataset of any size is worked on
by as many tasks. A pair of blocks puts out the k best of each question, and a rank window, which Spark limits before it shuffles,
keeps the k best of those. Scores that the product only rounds differently are made again pair by pair, in one order of summing, so that
equal vectors tie exactly; ties go to the smaller key.

Vectors that are null, hold null, NaN or infinite components, or are of length 0 have no score and are no hits; a question with such a
vector has none. Nor are chunks hits without a key, or questions asked without tenant or dataset. Vectors of different sizes do not meet. k is held to 1..20, and 8 where it is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.vectors import HIT, dot

BLOCK, ASKED, MOST, USUAL = 4096, 512, 20, 8


def clamped(k: Column) -> Column:
    """How many results to give: 1 to 20, and 8 for null."""
    return F.when(k.isNull(), USUAL).otherwise(F.least(F.greatest(k, F.lit(1)), F.lit(MOST))).cast("int")


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has a direction."""
    length = dot(F.col(vector), F.col(vector))
    return rows.where((length > 0) & (length < float("inf")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(float)
    return flat.reshape(len(column), -1)


def _best(questions: pa.Table, chunks: pa.Table) -> pa.Table:
    """The k best of a block of chunks for each of a block of questions; a hash can leave one of them empty."""
    if not len(questions) or not len(chunks):
        questions, chunks = questions.slice(0, 0), chunks.slice(0, 0)
        return pa.table({"question_id": questions["question_id"], "key": chunks["key"], "score": pa.array([], pa.float64()), "k": questions["k"]})
    q, c = _matrix(questions["vector"]), _matrix(chunks["embedding"])
    of_q, of_c = (np.sqrt((x * x).sum(1)) for x in (q, c))
    about = (q / of_q[:, None]) @ (c / of_c[:, None]).T
    asked, hits, scores = [], [], []
    keys = chunks["key"].to_pylist()
    for i, k in enumerate(questions["k"].to_pylist()):
        row = about[i]
        near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9) if k < len(row) else np.arange(len(row))
        exact = (c[near] * q[i]).sum(1) / (of_q[i] * of_c[near])
        for score, _, j in sorted(zip((-exact).tolist(), (keys[j] for j in near), near.tolist(), strict=True))[:k]:
            asked.append(i)
            hits.append(j)
            scores.append(-score)
    return pa.table({"question_id": questions["question_id"].take(pa.array(asked, pa.int64())), "key": chunks["key"].take(pa.array(hits, pa.int64())), "score": pa.array(scores, pa.float64()), "k": questions["k"].take(pa.array(asked, pa.int64()))})


def nearest(questions: DataFrame, chunks: DataFrame, by: tuple[str, ...] = ("tenant_id", "dataset_id"), *, vector: str = "vector", embedding: str = "embedding", key: str = "chunk_id", block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """question_id, key, score, n (from 1): the k best chunks of each question. questions: question_id (each once for the same `by`),
    by, vector, k; chunks: by, key (each once), embedding."""
    on = [*by, "size"]
    rows = usable(chunks.select(*by, F.col(key).alias("key"), F.col(embedding).alias("embedding")).where("key IS NOT NULL"), "embedding").withColumn("size", F.size("embedding"))
    asks = usable(questions.select(*by, "question_id", F.col(vector).alias("vector"), clamped(F.col("k")).alias("k")), "vector").withColumn("size", F.size("vector"))
    shape = asks.groupBy(*on).agg(F.ceil(F.count("*") / asked).cast("int").alias("asks"))
    parts = rows.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    shape = shape.join(parts, on)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = asks.join(shape, on).select(*on, mine("question_id", "asks").alias("ask"), every("parts").alias("part"), "question_id", "vector", "k")
    right = rows.join(shape, on).select(*on, every("asks").alias("ask"), mine("key", "parts").alias("part"), "key", "embedding")
    kind = f"question_id {questions.schema['question_id'].dataType.simpleString()}, key {chunks.schema[key].dataType.simpleString()}, score double, k int"
    group = [*on, "ask", "part"]

    return merged(left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_best, kind)).withColumnRenamed("key", key)


def merged(found: DataFrame, key: str = "key") -> DataFrame:
    """question_id, key, score, n of hits with k: the k best of each question."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), key)
    ranked = found.withColumn("n", F.row_number().over(order)).where(f"n <= {MOST}").where("n <= k")
    return ranked.select("question_id", key, "score", "n")


def hits(found: DataFrame, chunks: DataFrame, columns: list[str] = HIT, by: list[str] | None = None) -> DataFrame:
    """The found chunks' columns, with question_id, score and n."""
    return found.join(chunks.select(*columns), "chunk_id").select("question_id", *columns, "score", "n")
