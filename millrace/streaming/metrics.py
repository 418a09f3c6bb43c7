"""Figures of batches: what a stream's batches took, gave and failed in, appended to a table as they end.

`counted` observes rows on their way, without another pass; BatchLog is a listener that appends a row for each batch and each stream
that ends in an error. A listener that cannot write says so in `lost` and never stops the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

NAME = "millrace"
SCHEMA = "query string, run string, batch long, at string, rows_in long, rows long, failures long, latency_ms long, error string"


def counted(rows: DataFrame, failed: Column | None = None, into: Observation | str = NAME) -> DataFrame:
    """rows, observed: how many, and of how many `failed` holds. into: an Observation for a table, a name for a stream."""
    return rows.observe(into, F.count(F.lit(1)).alias("rows"), F.count_if(F.lit(False) if failed is None else failed).alias("failures"))


def json_lines(spark: SparkSession, path: str) -> Callable[[dict], None]:
    """Appends rows as JSON lines below a path that the driver and all readers share."""
    return lambda row: spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(path)


class BatchLog(StreamingQueryListener):
    """A row for each batch that had input and for each failure, given to `write`."""

    def __init__(self, write: Callable[[dict], None]):
        self.write, self.lost = write, []

    def _put(self, **row: object) -> None:
        try:
            self.write({c.split()[0]: None for c in SCHEMA.split(", ")} | row)
        except Exception as e:  # noqa: BLE001  figures never stop what they measure
            self.lost.append(f"{type(e).__name__}: {e}")

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            seen = json.loads(p.json).get("observedMetrics", {}).get(NAME, {})
            self._put(query=str(p.id), run=str(p.runId), batch=p.batchId, at=p.timestamp, rows_in=p.numInputRows, rows=seen.get("rows"), failures=seen.get("failures"), latency_ms=p.durationMs.get("triggerExecution"))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        if event.exception:
            self._put(query=str(event.id), run=str(event.runId), failures=1, error=event.exception)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
