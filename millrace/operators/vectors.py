"""Chunk vectors: embedding, the keyed table's changes, and exact cosine top-k within a tenant's dataset."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import chunk_id, col, content_hash

HIT_KINDS = {**dict.fromkeys(("chunk_id", "doc_id", "filename"), "string"), "page": "int", "chunk_index": "int", **dict.fromkeys(("text", "source_uri", "content_hash", "doc_type", "discipline", "section_reference"), "string"), "standards_referenced": "array<string>"}
HIT = list(HIT_KINDS)
AT_ONCE = 256


def hashed_embedding(texts: pd.Series, size: int = 1024) -> list[np.ndarray]:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of length 1."""
    from zlib import crc32

    out = []
    for text in texts.fillna(""):
        v = np.zeros(size, np.float32)
        for word in text.lower().split():
            h = crc32(word.encode("utf-8", "replace"))
            v[h % size] += 1.0 if h >> 31 else -1.0
        out.append(v / max(float(np.linalg.norm(v)), 1e-12))
    return out


def embed(text: Column | str, model: Callable[[pd.Series], list[np.ndarray]] = hashed_embedding) -> Column:
    """array<float> by any model that maps a series of texts to vectors; it gets at most AT_ONCE texts of an Arrow batch at once, so that
    a worker holds so many vectors and no more."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for i in range(0, len(texts), AT_ONCE):
                yield pd.Series([np.asarray(v, np.float32) for v in model(texts.iloc[i : i + AT_ONCE])])

    return run(col(text))


def checked(vector: Column | str, size: int) -> Column:
    """The vector; an error names a wrong size. Every row is checked."""
    v = col(vector)
    return F.when(F.size(v) == size, v).otherwise(F.raise_error(F.concat(F.lit(f"embedding size is not {size} but "), F.size(v).cast("string"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null if a vector is null or of length 0."""
    x, y = col(a), col(b)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def top_k(chunks: DataFrame, query: list[float], k: int, where: Column | None = None, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k chunks nearest to one query vector, with score; equal scores by key. The filter comes first, so that partitions of
    other tenants are not read."""
    rows = chunks if where is None else chunks.where(where)
    scored = rows.withColumn("score", cosine(vector, F.array(*(F.lit(float(x)) for x in query)))).where("score IS NOT NULL AND NOT isnan(score)")
    return scored.orderBy(F.desc("score"), key).limit(k)


def search(chunks: DataFrame, tenant: str, dataset: str, query: list[float], k: int = 8) -> DataFrame:
    """Hits of a tenant's dataset: the columns of HIT and score."""
    found = top_k(chunks, query, clamp_k(k), (F.col("tenant_id") == tenant) & (F.col("dataset_id") == dataset))
    return found.select(*HIT, "score")


def clamp_k(k: object, default: int = 8) -> int:
    """How many results to give: a finite number is held to 1..20, anything else is the default."""
    if isinstance(k, bool) or not isinstance(k, int | float) or k != k or k in (float("inf"), float("-inf")):
        return default
    return int(max(1, min(20, k)))


def last_of(new: DataFrame, key: str | list[str], by: tuple[str, ...]) -> DataFrame:
    """The greatest row of each key, by columns; found by partial aggregation, so copies of a key are not brought together."""
    row = F.struct(*new.columns)
    return new.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max_by(row, F.struct(*by)).alias("_row")).select("_row.*")


def upsert(table: DataFrame, new: DataFrame, key: str = "chunk_id", refreshed: tuple[str, ...] = ("text", "embedding", "content_hash", "created_at"), latest: tuple[str, ...] = ("created_at", "text")) -> DataFrame:
    """The table after new rows: known keys take only the refreshed columns, other columns stay; unknown keys are added whole. Of
    new rows that repeat a key the greatest by `latest` counts. A new row without a key is an error; rows of the table without one
    stay as they are."""
    new = last_of(new.withColumn(key, F.coalesce(key, F.raise_error(F.lit(f"a new row without {key}")))), key, latest)
    a, b = table.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    known, fresh = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.when(known & fresh, F.col(f"b.{c}" if c in refreshed else f"a.{c}")).when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(*(pick(c).alias(c) for c in table.columns))


def insert_absent(table: DataFrame, new: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The table and the new rows that have a vector and an unknown key."""
    return table.unionByName(new.where(F.col(vector).isNotNull()).join(table.select(key), key, "left_anti").select(table.columns))


def delete_documents(table: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("tenant_id", "dataset_id", "doc_id")) -> DataFrame:
    return table.join(gone.select(*keys), list(keys), "left_anti")


def repair(records: DataFrame, tenant: Column, dataset: Column, doc: Column, source_uri: Column, filename: Column, created_at: Column, model: Column) -> DataFrame:
    """Records of older files in today's form: chunkId becomes chunk_id, tenant and dataset are set, empty fields get defaults,
    missing ids and hashes are made. Rows of blank text go, after their place was counted."""
    has = set(records.columns)
    old = lambda n: F.col(n) if n in has else F.lit(None)
    full = lambda n, d: F.coalesce(F.when(old(n).cast("string") != "", old(n)), d)
    out = records.withColumns({"tenant_id": tenant, "dataset_id": dataset, "doc_id": full("doc_id", doc), "source_uri": full("source_uri", source_uri), "filename": full("filename", filename), "created_at": full("created_at", created_at), "embedding_model": full("embedding_model", model)})
    known = F.when(old("chunk_id").cast("string") != "", old("chunk_id"))
    out = out.withColumn("chunk_id", F.coalesce(known, F.when(old("chunkId").cast("string") != "", old("chunkId")), chunk_id("doc_id", "page", "chunk_index")))
    out = out.withColumn("content_hash", full("content_hash", content_hash("doc_id", "page", "chunk_index", "text")))
    if "acl" in has:
        out = out.withColumn("acl", F.coalesce("acl", F.array().cast("array<string>")))
    return out.drop("chunkId", "metadata").where(F.length(F.regexp_replace("text", r"\s", "")) > 0)
