"""Ingestion as a stream: new objects become files and jobs once each, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.objects import keyed
from millrace.streaming.held import Held


def dispatch(objects: DataFrame, known: DataFrame | None, key: str = "key") -> DataFrame:
    """tenant_id, dataset_id, file_id, filename, raw_key, job_id of one table of objects: malformed keys go, a file comes once, and
    files of `known` (those with a job in work or done) are left out. Job ids are made of the file and its key, so that a table
    that is run again makes the same ones. Over the batches of a stream use dispatch.jobs, which knows a file again."""
    rows = keyed(objects, key).select("tenant_id", "dataset_id", "file_id", "filename", F.col(key).alias("raw_key")).dropDuplicates(["tenant_id", "dataset_id", "file_id"])
    if known is not None:
        rows = rows.join(known.select("tenant_id", "dataset_id", "file_id"), ["tenant_id", "dataset_id", "file_id"], "left_anti")
    return rows.withColumn("job_id", F.sha2(F.concat_ws("|", "tenant_id", "dataset_id", "file_id", "raw_key"), 256))


def ingest(stream: DataFrame | Held, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df, *, once: bool = True, errors: str | None = None, tries: int = 3) -> StreamingQuery:
    """Run work on each batch and write its rows below out/batch=<n>. A batch that is repeated after a failure overwrites its own
    folder, so each row of the stream counts once; that a file counts once however often it is noticed is dispatch.jobs' matter. once:
    take what there is and stop. A batch that fails `tries` times stops the stream, or, with errors, goes there as it came, with the
    error's whole text, and the stream goes on. Of a stream with keyed state work gets the rows that its step gives."""

    def batch(df: DataFrame, number: int) -> None:
        if isinstance(stream, Held):
            df = stream.step(df, number, f"{checkpoint}/held")
        for left in reversed(range(tries)):
            try:
                return work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")
            except Exception as e:  # noqa: BLE001  whatever fails a batch is kept with it
                if not left and errors is None:
                    raise
                message = f"{type(e).__name__}: {e}"
        df.withColumn("error", F.lit(message)).write.mode("overwrite").parquet(f"{errors}/batch={number}")

    writer = (stream.stream if isinstance(stream, Held) else stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and time window, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
