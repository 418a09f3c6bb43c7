"""Jobs for files, once each, over a stream of any batches: a file's status is keyed state of the stream.

Events are notices of objects and changes of a file's status, in one stream. A notice starts a job unless the file is in work or done
with a job already, so a notice that comes again, in its batch, in a later one or after a restart, starts none; after FAILED (or any
status but PROCESSING and COMPLETE) it does. Within a batch a file's events are taken by time, ties with statuses first; batches as
they come. State is one small row a file, kept for good (held.py). The events of a file in a batch are brought together, so a batch
(maxFilesPerTrigger, maxBytesPerTrigger) bounds what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.objects import keyed
from millrace.streaming.held import Held, by_keys

KEYS = ("tenant_id", "dataset_id", "file_id")
BUSY = ("PROCESSING", "COMPLETE")


def notices(objects: DataFrame, at: Column, key: str = "key") -> DataFrame:
    """Events of objects whose key has the form; others are left out."""
    named = keyed(objects.select(F.col(key).alias("raw_key"), at.alias("at")), "raw_key")
    return named.select(*KEYS, "at", F.lit(None).cast("string").alias("status"), "filename", "raw_key")


def statuses(changes: DataFrame, at: Column, status: Column) -> DataFrame:
    """Events of rows with the file's keys: its status becomes this one. Rows without a status are left out."""
    none = F.lit(None).cast("string")
    return changes.select(*(F.col(k).cast("string").alias(k) for k in KEYS), at.alias("at"), status.alias("status"), none.alias("filename"), none.alias("raw_key")).where("status IS NOT NULL")


def jobs(events: DataFrame, registered: bool = False) -> Held:
    """tenant_id, dataset_id, file_id, filename, raw_key, attempt (from 1), job_id of a stream of events. registered: only files
    that had a status before get jobs. Job ids are made of the file, its key and the attempt, so that work done again makes the same
    ones."""
    none = F.array().cast("array<struct<filename:string,raw_key:string,attempt:int>>")

    def take(s: Column, x: Column) -> Column:
        busy = F.coalesce(s["status"].isin(*BUSY), F.lit(False)) & (s["attempts"] > 0)
        starts = x["object"] & ~busy & (F.lit(not registered) | s["status"].isNotNull())
        attempts = s["attempts"] + starts.cast("int")
        status = F.when(~x["object"], x["status"]).when(starts, F.lit("PROCESSING")).otherwise(s["status"])
        made = F.when(starts, F.concat(s["made"], F.array(F.struct(x["filename"], x["raw_key"], attempts.alias("attempt"))))).otherwise(s["made"])
        return F.struct(status.alias("status"), attempts.alias("attempts"), made.alias("made"))

    def fold(batch: DataFrame, states: DataFrame) -> DataFrame:
        event = F.struct("at", F.isnull("status").alias("object"), "status", "raw_key", "filename")
        files = batch.groupBy(*KEYS).agg(F.sort_array(F.collect_list(event)).alias("events"))  # nulls first
        known = by_keys(files, states, [*KEYS], "left")
        start = F.struct("status", F.coalesce("attempts", F.lit(0)).alias("attempts"), none.alias("made"))
        return known.select(*KEYS, F.aggregate("events", start, take).alias("s")).select(*KEYS, "s.*")

    def rows(_: DataFrame, folded: DataFrame) -> DataFrame:
        again = F.when(F.col("attempt") > 1, F.col("attempt").cast("string"))
        made = folded.select(*KEYS, F.explode("made").alias("j")).select(*KEYS, "j.*")
        return made.withColumn("job_id", F.sha2(F.concat_ws("|", *KEYS, "raw_key", again), 256))

    return Held(events, [*KEYS], {"status": "string", "attempts": "int"}, fold, rows)
