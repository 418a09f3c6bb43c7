"""Keyed tables that change in place: rows lie in buckets of a hash of their key, and a change rewrites the buckets that it touches.

A version of the table is a manifest, a small file that names each bucket's folder; data files are never changed. A change reads the
buckets of its keys, writes them anew into a folder of its own, and commits by creating the next manifest, which fails if another
change came first: then nothing has changed, and the caller may begin again. A reader holds one manifest's files, so it sees the table
before a change or after it, never both. What a failed change leaves is not named by any manifest; `clean` deletes it.

Rows of one partition (the columns `by`, a tenant say) lie in `spread` buckets, so that a partition is read without the others, and one
that holds a third of all rows is still spread over several. Within a bucket's files rows are sorted by key, and columns of `blooms`
have Bloom filters, so that a lookup reads few row groups. Each key stands once. Rows without a key (a null in any key column) are
refused with an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import catalog
from millrace.operators.vectors import last_of
from millrace.session import stored

BUCKETS, SPREAD, ROW_GROUP = 64, 4, 8 << 20
#: The column that files are partitioned by; no table may have one of this name.
BUCKET = "millrace_bucket"


class StaleTable(RuntimeError):
    """Another change was committed since this one read the table."""


class Files:
    """What a manifest needs of a file system that executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway, self.root = spark.sparkContext._gateway, self.at(path)
        self.fs = self.root.getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        at = self.at(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Makes a file whole or not at all; false if there is one."""
        part = self.at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, self.at(path), none)
        except Exception as e:  # the Java error's class is in the text
            self.fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.version = self._newest()
        about = json.loads(self.files.read(self._manifest(self.version)))
        self.schema = T.StructType.fromJson(about["schema"])
        self.keys, self.by, self.buckets, self.spread, self.blooms = (about[c] for c in ("keys", "by", "buckets", "spread", "blooms"))
        self.folders: dict[str, str] = about["folders"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], by: list[str] | None = None, *, buckets: int = BUCKETS, spread: int = SPREAD, blooms: tuple[str, ...] = ()) -> KeyedTable:
        """An empty table; an error if there is one. by: the first columns of the key that make a partition, all if not given."""
        if BUCKET in schema.names or not set(keys) <= set(schema.names) or not set(by or keys) <= set(keys):
            raise ValueError(f"keys {keys} and {by} have to be columns of the table, and {BUCKET} may not")
        about = {"schema": schema.jsonValue(), "keys": keys, "by": by or keys, "buckets": buckets, "spread": min(spread, buckets) if by and by != keys else 1, "blooms": list(blooms), "folders": {}}
        files = Files(spark, path)
        files.fs.mkdirs(files.at(f"{path}/manifests"))
        if not files.create(f"{path}/manifests/{0:010d}.json", json.dumps(about)):
            raise FileExistsError(path)
        return cls(spark, path)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def _newest(self) -> int:
        return max(int(n[:-5]) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json"))

    def refresh(self) -> KeyedTable:
        """The table at its newest version."""
        return KeyedTable(self.spark, self.path)

    def bucket(self, of: Callable[[str], Column] = F.col) -> Column:
        """A row's bucket, of its key's columns or of what stands for them."""
        whole = [F.coalesce(of(c).cast(self.schema[c].dataType), F.raise_error(F.lit(f"a row without {c}")).cast(self.schema[c].dataType)) for c in self.keys]
        first = F.xxhash64(*(w for w, c in zip(whole, self.keys, strict=True) if c in self.by))
        return F.pmod(F.pmod(first, F.lit(self.buckets)) + F.pmod(F.xxhash64(*whole, F.lit("part")), F.lit(self.spread)), F.lit(self.buckets)).cast("int")

    def _read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [f for b, f in sorted(self.folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in paths)) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of this version."""
        return self._read()

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> KeyedTable:
        """The table after merge(rows, changes) of the buckets that the changes' keys lie in; other buckets' files stay. The rows that
        come of it must keep to the changes' keys and the rows'."""
        dealt = stored(changes.withColumn(BUCKET, self.bucket()))
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return self
        made = merge(self._read(touched), dealt.drop(BUCKET)).select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn(BUCKET, self.bucket())
        folder = f"data/{uuid.uuid4().hex}"
        writer = made.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.option("parquet.block.size", ROW_GROUP)
        for c in self.blooms:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        full = {n.split("=")[1] for n in self.files.names(f"{self.path}/{folder}") if n.startswith(f"{BUCKET}=")}
        folders = {b: f for b, f in self.folders.items() if int(b) not in touched} | {b: f"{folder}/{BUCKET}={b}" for b in full}
        about = {"schema": self.schema.jsonValue(), "keys": self.keys, "by": self.by, "buckets": self.buckets, "spread": self.spread, "blooms": self.blooms, "folders": folders}
        if not self.files.create(self._manifest(self.version + 1), json.dumps(about)):
            self.files.delete(f"{self.path}/{folder}")
            raise StaleTable(f"version {self.version + 1} of {self.path} is another change's")
        return KeyedTable(self.spark, self.path)

    def put(self, rows: DataFrame, latest: list[str] | None = None) -> KeyedTable:
        """Rows replace those of their keys; of rows that share a key the greatest by `latest` (else by all columns)."""
        names = self.schema.names
        return self.change(last_of(rows.select(*names), self.keys, tuple(latest or names)), lambda old, new: catalog.put(old, new, self.keys))

    def update(self, changes: DataFrame, stamp: Column | None = None) -> KeyedTable:
        """Columns that are not null are set; unknown keys are added."""
        return self.change(changes, lambda old, new: catalog.update(old, new, self.keys, stamp))

    def insert_absent(self, rows: DataFrame) -> KeyedTable:
        """Rows of unknown keys are added, others left out."""
        names = self.schema.names
        return self.change(last_of(rows.select(*names), self.keys, tuple(names)), lambda old, new: old.unionByName(new.join(old.select(*self.keys), self.keys, "left_anti").select(*names)))

    def delete(self, keys: DataFrame) -> KeyedTable:
        """Rows of these keys go."""
        return self.change(keys.select(*self.keys), lambda old, gone: old.join(gone, self.keys, "left_anti"))

    def get(self, **key: object) -> DataFrame:
        """The row of a key, from its bucket alone."""
        if set(key) != set(self.keys):
            raise ValueError(f"a key is {self.keys}")
        return self._where(key, self._bucket_of(key))

    def of_partition(self, **by: object) -> DataFrame:
        """The rows of a partition, from its buckets alone."""
        if set(by) != set(self.by):
            raise ValueError(f"a partition is {self.by}")
        first = self.spark.range(1).select(F.pmod(F.xxhash64(*(F.lit(by[c]).cast(self.schema[c].dataType) for c in self.by)), F.lit(self.buckets))).first()[0]
        return self._where(by, [(first + i) % self.buckets for i in range(self.spread)])

    def _bucket_of(self, key: dict[str, object]) -> list[int]:
        return [self.spark.range(1).select(self.bucket(lambda c: F.lit(key[c]))).first()[0]]

    def _where(self, key: dict[str, object], buckets: list[int]) -> DataFrame:
        out = self._read(buckets)
        for c, v in key.items():
            out = out.where(F.col(c) == F.lit(v).cast(self.schema[c].dataType))
        return out

    def clean(self, keep: int = 1) -> None:
        """Deletes all but the newest `keep` versions and the files that only those name, and what failed changes left. No other change
        and no reader of an older version may be at work."""
        newest = self._newest()
        first = max(0, newest - keep + 1)
        named = {f for v in range(first, newest + 1) for f in json.loads(self.files.read(self._manifest(v)))["folders"].values()}
        for name in self.files.names(f"{self.path}/manifests"):
            if not name.endswith(".json") or int(name[:-5]) < first:
                self.files.delete(f"{self.path}/manifests/{name}")
        for change in self.files.names(f"{self.path}/data"):
            for bucket in self.files.names(f"{self.path}/data/{change}"):
                if f"data/{change}/{bucket}" not in named:
                    self.files.delete(f"{self.path}/data/{change}/{bucket}")
            if not self.files.names(f"{self.path}/data/{change}"):
                self.files.delete(f"{self.path}/data/{change}")


def bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows as a table of the session's warehouse, bucketed and sorted by key: two such tables of as many buckets join on it without
    an exchange."""
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)
