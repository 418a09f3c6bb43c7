"""Keyed state of a stream as tables: a batch is brought to its keys' states by joins and native folds, with no Python a key.

Of each batch the states of its keys are written, as version <batch> below <checkpoint>/held; the newest version of a key is its state.
Every WHOLE batches all keys are written together, and what is older goes. Batch n reads versions before n alone, so that a batch that is
repeated after a failure finds the states that it found before. Only states of the batch's keys are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.keyed import Files

WHOLE = 10


def by_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """a and b's other columns, joined by keys that may be null."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return a.join(other, on, how).drop(*(f"_{k}" for k in keys))


@dataclass(frozen=True)
class Held:
    """A stream and what its batches do. fold(batch, states): a row for each key of the batch, its new state (the columns of `state`,
    with their types) and what `rows` needs; rows(batch, folded): what the batch gives. states has a row for each key of the batch that
    has been seen before."""

    stream: DataFrame
    keys: list[str]
    state: dict[str, str]
    fold: Callable[[DataFrame, DataFrame], DataFrame]
    rows: Callable[[DataFrame, DataFrame], DataFrame]

    def step(self, batch: DataFrame, number: int, at: str) -> DataFrame:
        """Folds a batch, keeps its states below `at`, and gives its rows."""
        spark, files = batch.sparkSession, Files(batch.sparkSession, at)
        versions = [(int(v.split("-")[0]), v) for v in files.names(at) if int(v.split("-")[0]) < number]
        whole = max((n for n, v in versions if v.endswith("-whole")), default=-1)
        read = [(n, v) for n, v in versions if n > whole or v == f"{whole:010d}-whole"]
        names = [*self.keys, *self.state]

        def latest(of: list[tuple[int, str]], among: DataFrame | None) -> DataFrame:
            every = [spark.read.schema(schema).parquet(f"{at}/{v}").withColumn("_at", F.lit(n)) for n, v in of]
            known = reduce(DataFrame.unionByName, every) if every else spark.createDataFrame([], schema).withColumn("_at", F.lit(0))
            if among is not None:
                known = by_keys(known, among.select(*self.keys), self.keys, "left_semi")
            newest = known.groupBy(*self.keys).agg(F.max_by(F.struct(*self.state), "_at").alias("_state"))
            return newest.select(*self.keys, "_state.*")

        kinds = {c: batch.schema[c].dataType.simpleString() for c in self.keys} | self.state
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
        version = f"{number:010d}"
        self.fold(batch, latest(read, batch)).write.mode("overwrite").parquet(f"{at}/{version}")
        if number % WHOLE == WHOLE - 1:
            latest([*read, (number, version)], None).write.mode("overwrite").parquet(f"{at}/{version}-whole")
            for n, v in versions:
                if (n, v) not in read:
                    files.delete(f"{at}/{v}")
        return self.rows(batch, spark.read.parquet(f"{at}/{version}"))
