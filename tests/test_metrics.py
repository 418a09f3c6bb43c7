"""Figures of batches and tables; a listener that fails."""

import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.operators.vectors import embed
from millrace.streaming import metrics
from millrace.streaming.ingest import ingest


def streamed(spark, tmp_path, log, work=lambda df: df):
    spark.createDataFrame([(i, None if i == 3 else f"text {i}") for i in range(10)], "id long, text string").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    spark.streams.addListener(log)
    try:
        query = ingest(metrics.counted(stream, F.col("text").isNull()), str(tmp_path / "out"), str(tmp_path / "cp"), work, tries=1)
        try:
            query.awaitTermination()
        finally:
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            time.sleep(1)
    finally:
        spark.streams.removeListener(log)
    return spark.read.parquet(str(tmp_path / "out")).count()


def test_batches_leave_their_figures(spark, tmp_path):
    log = metrics.BatchLog(metrics.json_lines(spark, str(tmp_path / "log")))
    assert streamed(spark, tmp_path, log) == 10 and log.lost == []
    rows = metrics.read(spark, str(tmp_path / "log")).orderBy("batch").collect()
    assert [r["batch"] for r in rows] == [0, 1] and sum(r["rows"] for r in rows) == 10 == sum(r["rows_in"] for r in rows)
    assert sum(r["failures"] for r in rows) == 1 and all(r["latency_ms"] > 0 for r in rows) and len({r["run"] for r in rows}) == 1


def test_a_failing_listener_stops_nothing(spark, tmp_path):
    def write(row):
        raise OSError("no store")

    log = metrics.BatchLog(write)
    assert streamed(spark, tmp_path, log) == 10 and log.lost == ["OSError: no store"] * 2


def test_a_stream_that_fails_is_a_row(spark, tmp_path):
    rows = []

    def never(df):
        raise ValueError("bad batch")

    with pytest.raises(Exception, match="bad batch"):
        streamed(spark, tmp_path, metrics.BatchLog(rows.append), never)
    assert [r["failures"] for r in rows if r["error"]] == [1] and "bad batch" in rows[-1]["error"]


def test_rows_of_an_embedding_plan(spark):
    seen = Observation("embedding")
    df = spark.createDataFrame([("a b",), (None,), ("c",)], "text string").withColumn("vector", embed("text"))
    metrics.counted(df, F.col("text").isNull(), seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "failures": 1}
    none = Observation("plain")
    metrics.counted(df, into=none).write.format("noop").mode("overwrite").save()
    assert none.get == {"rows": 3, "failures": 0}
