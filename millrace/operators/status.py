"""Status machines over event logs: which events a machine takes, which it refuses, and where each key stands.

An event asks its key (a dataset, file or job) to go to a status; the table of catalog.STATES says from where that is allowed. A refused
event changes nothing. So an event is a function of few states, and such functions can be put together: the log is cut into blocks along
key and time, and a key's events in a block into runs; each run and each block becomes one small function, these give the state at which
each begins, and the events of a run are then judged from there. A key with a third of all events is worked on by as many tasks as it
has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.catalog import STATES
from millrace.session import stored


def moment(text: Column) -> Column:
    """A time of ISO form in UTC, in whole seconds or with a fraction; null for anything else."""
    return F.try_to_timestamp(text)


def uploads(files: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The events of files that are about to be uploaded (tenant_id, dataset_id, file_id): their dataset is UPLOADED again, and they
    are UPLOADED_PENDING."""
    dataset = files.select("tenant_id", "dataset_id", at.alias("at"), F.lit("UPLOADED").alias("status"))
    return dataset, files.select("tenant_id", "dataset_id", "file_id", at.alias("at"), F.lit("UPLOADED_PENDING").alias("status"))


class Machine:
    """A table of transitions as numbers: state 0 is none, event 0 is any status that the machine has not."""

    def __init__(self, kind: str):
        table = STATES[kind]
        self.names = sorted({s for to in table.values() for s in to} | {s for s in table if s})
        places = [None, *self.names]
        self.allowed = [[now is not None and now in table.get(was, ()) for was in places] for now in places]
        self.next = [[now if yes else was for was, yes in enumerate(row)] for now, row in enumerate(self.allowed)]

    def number(self, status: Column) -> Column:
        return F.coalesce(F.array_position(F.array(*(F.lit(n) for n in self.names)), status), F.lit(0)).cast("int")

    def name(self, number: Column) -> Column:
        return F.get(F.array(F.lit(None).cast("string"), *(F.lit(n) for n in self.names)), number)

    def _of(self, table: list[list], state: Column, event: Column) -> Column:
        return F.get(F.get(F.array(*(F.array(*(F.lit(x) for x in row)) for row in table)), event), state)

    def after(self, state: Column, event: Column) -> Column:
        return self._of(self.next, state, event)

    def takes(self, state: Column, event: Column) -> Column:
        return self._of(self.allowed, state, event)

    def same(self) -> Column:
        """The function that changes nothing: each state's number."""
        return F.array(*(F.lit(i) for i in range(len(self.names) + 1)))


def _joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """a with b's other columns; nulls are equal."""
    other = b.select(*(F.col(c).alias(f"_{c}") for c in on), *(c for c in b.columns if c not in on))
    condition = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return a.join(other, condition).drop(*(f"_{c}" for c in on))


def _together(parts: DataFrame, by: list[str], piece: str, machine: Machine) -> DataFrame:
    """by, parts (struct<piece, to>, in order) and to, the function of all of them one after the other."""
    held = parts.select(*by, F.struct(F.col(piece).alias("piece"), "to").alias("part")).groupBy(*by).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return held.withColumn("to", F.aggregate("parts", machine.same(), lambda f, p: F.transform(f, lambda s: F.get(p["to"], s))))


def _begins(held: DataFrame, by: list[str], piece: str) -> DataFrame:
    """by, piece, begin: the state at which each part begins, where held has the state at which the first one does."""
    zero = F.struct(F.col("begin").alias("at"), F.array().cast("array<struct<piece:int,begin:int>>").alias("out"))
    walk = F.aggregate("parts", zero, lambda s, p: F.struct(F.get(p["to"], s["at"]).alias("at"), F.concat(s["out"], F.array(F.struct(p["piece"].alias("piece"), s["at"].alias("begin")))).alias("out")), lambda s: s["out"])
    return held.select(*by, F.explode(walk).alias("b")).select(*by, F.col("b.piece").alias(piece), "b.begin")


#: Events of a key that are judged as one array.
RUN = 256


def replay(events: DataFrame, kind: str, keys: list[str], order: list[str], start: DataFrame | None = None) -> DataFrame:
    """The events (keys, order, status; other columns stay behind) with was, accepted and now: the status that their key had, whether
    the event was allowed, and the status after it. order: columns that put a key's events in order, ties as they fall; nulls come
    first. start: keys and status before the first event; a key that it has not is new."""
    machine = Machine(kind)
    slim = events.select(*keys, *order, "status", machine.number(F.col("status")).alias("event"))
    placed = stored(slim.repartitionByRange(*keys, *order).withColumn("block", F.spark_partition_id()))
    n = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order))
    runs = placed.withColumn("run", F.floor((n - 1) / RUN).cast("int")).groupBy(*keys, "block", "run").agg(F.array_sort(F.collect_list(F.struct(*order, "event", "status"))).alias("events"))
    runs = stored(runs.withColumn("to", F.aggregate("events", machine.same(), lambda f, e: F.transform(f, lambda s: machine.after(s, e["event"])))))
    blocks = _together(runs, [*keys, "block"], "run", machine)
    whole = _together(blocks, keys, "block", machine)
    if start is not None:
        known = start.select(*(F.col(k).alias(f"_{k}") for k in keys), machine.number(F.col("status")).alias("first"))
        whole = whole.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    whole = whole.withColumn("begin", F.coalesce("first", F.lit(0)) if start is not None else F.lit(0))
    blocks = _joined(blocks, _begins(whole, keys, "block"), [*keys, "block"])
    judged = _joined(runs, _begins(blocks, [*keys, "block"], "run"), [*keys, "block", "run"])
    none = F.array().cast("array<struct<was:int,accepted:boolean,now:int>>")

    def judge(s: Column, e: Column) -> Column:
        now = machine.after(s["at"], e["event"])
        one = F.struct(s["at"].alias("was"), machine.takes(s["at"], e["event"]).alias("accepted"), now.alias("now"))
        return F.struct(now.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    verdicts = F.aggregate("events", F.struct(F.col("begin").alias("at"), none.alias("out")), judge, lambda s: s["out"])
    rows = judged.withColumn("verdicts", verdicts).select(*keys, F.explode(F.arrays_zip("events", "verdicts")).alias("r"))
    return rows.select(*keys, *(F.col(f"r.events.{c}").alias(c) for c in order), F.col("r.events.status").alias("status"), machine.name(F.col("r.verdicts.was")).alias("was"), F.col("r.verdicts.accepted").alias("accepted"), machine.name(F.col("r.verdicts.now")).alias("now"))


def standing(replayed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and the status after their last event; found by partial aggregation."""
    return replayed.groupBy(*keys).agg(F.max_by("now", F.struct(*order)).alias("status"))
