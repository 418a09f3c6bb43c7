"""Objects in stores: raw files and their keys, text, JSON and JSON lines, and what is made of raw bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import normalize_whitespace
from millrace.schemas import RAW_FILES

LEAST_TEXT = 50


def raw_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The same without contents, which then are not read."""
    return raw_files(spark, path).select("path", "modificationTime", "length")


def parse_key(key: Column) -> Column:
    """Struct tenant_id, dataset_id, file_id, filename of raw/<tenant>/<dataset>/<file>/<name>, percent-decoded first; null for
    other keys. A name ends at its first slash."""
    parts = F.split(F.try_url_decode(key), "/")
    fields = F.struct(*(parts[i].alias(n) for i, n in enumerate(("tenant_id", "dataset_id", "file_id", "filename"), 1)))
    return F.when((F.size(parts) >= 5) & (parts[0] == "raw"), fields)


def keyed(objects: DataFrame, key: str = "key") -> DataFrame:
    """Objects whose key has the form, with its fields; others are left out."""
    return objects.withColumn("_k", parse_key(F.col(key))).where("_k IS NOT NULL").select(*objects.columns, "_k.*")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; empty lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, by: tuple[str, ...] = ("tenant_id", "dataset_id")) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def form_feed_pages(text: Column) -> Column:
    """array<struct<page_number, text>> of a whole text: parts between form feeds, a blank last one left out, white space in
    order."""
    parts = F.split(text, "\f")
    full = F.when(F.trim(F.regexp_replace(F.element_at(parts, -1), r"\s", "")) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(full, lambda x, i: F.struct((i + 1).alias("page_number"), normalize_whitespace(x).alias("text")))


def _page_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda p: p["text"]), "\n")


def decoded(content: pd.Series) -> list[str | None]:
    """An extractor for plain text: UTF-8 or an error."""
    return [bytes(x).decode("utf-8") for x in content]


def extract(files: DataFrame, primary: Callable[[pd.Series], list[str | None]], fallback: Callable[[pd.Series], list[str | None]] = decoded, least: int = LEAST_TEXT) -> DataFrame:
    """files (with content) and raw_sha256, pages, method ("primary", "fallback" or null) and both errors. Extractors turn a
    series of bytes (a batch of files) into as many texts, with form feeds between pages. The fallback runs for files whose primary text is missing or under
    `least` characters; files that stay under it have null pages. One file's failure is its own row's."""
    kind = "text string, error string"

    def safe(extractor: Callable) -> Callable:
        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for content in batches:
                try:  # all at once; file by file only where one of them fails
                    there = content[content.notna()]
                    found = dict(zip(there.index, extractor(there.reset_index(drop=True)) if len(there) else [], strict=True))
                    yield pd.DataFrame({"text": [found.get(i) for i in content.index], "error": None})
                    continue
                except Exception:  # noqa: BLE001, S110  the next lines say which file it was
                    pass
                rows = []
                for one in content:
                    if one is None:
                        rows.append((None, None))
                        continue
                    try:
                        rows.append((extractor(pd.Series([one]))[0], None))
                    except Exception as e:  # noqa: BLE001  any failure of a plugged-in extractor is data
                        rows.append((None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["text", "error"])

        return run

    enough = lambda c: F.coalesce(F.length(_page_text(c)) >= least, F.lit(False))
    out = files.withColumn("raw_sha256", F.sha2("content", 256)).withColumn("_a", safe(primary)("content"))
    out = out.withColumn("_pa", form_feed_pages(F.col("_a.text")))
    out = out.withColumn("_b", safe(fallback)(F.when(~enough(F.col("_pa")), F.col("content")))).withColumn("_pb", form_feed_pages(F.col("_b.text")))
    method = F.when(enough(F.col("_pa")), "primary").when(enough(F.col("_pb")), "fallback")
    pages = F.when(method == "primary", F.col("_pa")).when(method == "fallback", F.col("_pb"))
    return out.select(*files.columns, "raw_sha256", pages.alias("pages"), method.alias("method"), F.col("_a.error").alias("primary_error"), F.col("_b.error").alias("fallback_error"))


def raw_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files below a path, as they come."""
    return spark.readStream.format("binaryFile").schema(RAW_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
