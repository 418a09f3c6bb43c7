"""What several operators share: input cleaning, written intermediate tables, Arrow batches, splits of rows by CRC-32."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.session import shared_dir, spread

KINDS = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType, "binary": T.BinaryType, "boolean": T.BooleanType}


def columns(ddl: str) -> T.StructType:
    """A schema from "name kind, ..." without a session, so that modules can state theirs."""
    return T.StructType([T.StructField(n, KINDS[k]()) for n, k in (x.split() for x in ddl.split(","))])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, with a null text as the empty one; any other column of the input is left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df has not, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")), F.lit(n)).cast("int")


def written_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and lost executors cost no rework. options: the writer's."""
    path = f"{written_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> bool:
    """Deletes this application's intermediate tables. To be called when every result made of them has been used or stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(written_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that hold at least this share of a table's rows are hot; so at most its inverse of them are broadcast.
HOT = 10_000


def hot_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", least: int = 500) -> DataFrame:
    """rows joined with table (one row for each key) where a key may hold most of the rows. Both sides should be written tables.
    The rows of a hot key are dealt over several parts, and its row of table is copied to each; all other keys have one part.
    Hot keys and parts are at most 2 * HOT whatever the input, so the list of them is broadcast."""
    share = max(least, rows.count() // HOT)
    hot = rows.groupBy(key).agg(F.ceil(F.count("*") / share).cast("int").alias("_parts")).where("_parts > 1")
    hot = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), "_parts"), F.lit(0)).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_part", salt).drop("_parts")
    copied = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def arrow_rows(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def map_texts(docs: DataFrame, schema: T.StructType, work: Callable[[list, list], dict[str, list]], *, bytes_a_batch: int = 4 << 20) -> DataFrame:
    """docs (doc_id, text) through work(ids, texts) -> columns, a few MB of text at a time whatever the batch Spark sends."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for start, stop in slices(column, bytes_a_batch):
                yield arrow_rows(work(ids[start:stop].to_pylist(), column[start:stop].to_pylist()), arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes; a longer text is alone in its range."""
    start, total = 0, 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if i > start and total + (n or 0) > size:
            yield start, i
            start, total = i, 0
        total += n or 0
    if start < len(column):
        yield start, len(column)


def keep_texts(docs: DataFrame, model, keep: Callable) -> DataFrame:
    """The rows of docs, all columns as they are, whose score by model.scores(texts) satisfies keep(array of scores)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 20):
                part = batch.slice(a, b - a)
                scores = shared.value.scores([t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(keep(scores)))

    return docs.mapInArrow(run, docs.schema)
