"""The catalogue: keyed tables of datasets, files, jobs and events; their updates, states, deletions and figures.

Parquet has no updates in place; each operation returns the table's next version, to be written to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip

#: Which status may follow which.
STATES: dict[str, dict[str | None, set[str]]] = {
    "dataset": {None: {"UPLOADED"}, "UPLOADED": {"UPLOADED", "CHUNKED", "FAILED"}, "CHUNKED": {"UPLOADED", "INDEXING", "FAILED"}, "INDEXING": {"UPLOADED", "READY", "FAILED"}, "READY": {"UPLOADED", "CHUNKED"}, "FAILED": {"UPLOADED", "CHUNKED"}},
    "file": {None: {"UPLOADED_PENDING"}, "UPLOADED_PENDING": {"PROCESSING"}, "PROCESSING": {"COMPLETE", "FAILED"}, "FAILED": {"PROCESSING"}, "COMPLETE": set()},
    "job": {None: {"QUEUED"}, "QUEUED": {"RUNNING", "FAILED"}, "RUNNING": {"COMPLETE", "FAILED"}, "COMPLETE": set(), "FAILED": set()},
}


#: Fields that a request must have, and those of them where white space alone is nothing.
REQUIRED = {"dataset": ("name",), "file": ("dataset_id", "filename", "content_type"), "query": ("dataset_id", "query"), "chat": ("dataset_id", "message")}
TRIMMED = ("query", "message")


def missing_fields(kind: str) -> Column:
    """The names of a request's required fields that are null or empty, as an array in their order; an empty one if none is."""
    empty = lambda f: F.coalesce((strip(f) if f in TRIMMED else F.col(f)) == "", F.lit(True))
    return F.array_compact(F.array(*(F.when(empty(f), F.lit(f)) for f in REQUIRED[kind])))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Each key's last row."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def put(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of their keys as a whole."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, keys: list[str], stamp: Column | None = None) -> DataFrame:
    """Set the columns of `changes` that are not null, row by row; unknown keys are added. stamp goes to updated_at."""
    fields = [c for c in changes.columns if c not in keys]
    if not fields:
        return table
    new = changes.select(*keys, F.struct(*fields).alias("_new"))
    out = table.join(new, keys, "full_outer")
    cols = [F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns]
    if stamp is not None and "updated_at" in table.columns and "updated_at" not in fields:
        cols = [F.when(F.col("_new").isNotNull(), stamp).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at" else x for c, x in zip(table.columns, cols, strict=True)]
    return out.select(*cols)


def allowed(kind: str, was: Column, now: Column) -> Column:
    """May a dataset, file or job go from one status (null: it is new) to the other?"""
    out = F.lit(False)
    for a, to in STATES[kind].items():
        out = out | ((was.isNull() if a is None else F.coalesce(was == a, F.lit(False))) & now.isin(*to) if to else F.lit(False))
    return F.coalesce(out, F.lit(False))


def to_process(events: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Events of known files that are not in work or done with a job already; failed files may run again."""
    busy = F.coalesce(F.col("status").isin("PROCESSING", "COMPLETE"), F.lit(False)) & F.col("latest_job_id").isNotNull()
    return events.join(files.where(~busy).select(*keys), keys, "left_semi")


def audit(table: DataFrame, events: DataFrame) -> DataFrame:
    """The event log with new events; each gets an id of its own, so that two of one second both stay."""
    new = events if "event_id" in events.columns else events.withColumn("event_id", F.expr("uuid()"))
    return table.unionByName(new.withColumn("event_id", F.coalesce("event_id", F.expr("uuid()"))), allowMissingColumns=True)


def delete_dataset(gone: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], order: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """Delete rows and what hangs on them. tables: name -> (table, its own key); order: (child, parent) with parents first,
    "" for `gone`. A child's rows go with their parent's key."""
    out, dead = {}, {"": gone}
    for child, parent in order:
        table, _ = tables[child]
        by = [c for c in (tables[parent][1] if parent else gone.columns) if c in table.columns]
        dead[child] = table.join(dead[parent].select(*by).distinct(), by, "left_semi")
        out[child] = table.join(dead[parent].select(*by).distinct(), by, "left_anti")
    return out


def of_dataset(rows: DataFrame, dataset: Column) -> DataFrame:
    """Jobs, or a conversation's rows, that belong to a dataset; others count as not found."""
    return rows.where(F.coalesce(F.col("dataset_id") == dataset, F.lit(False)))


def active(files: DataFrame, by: tuple[str, ...] = ("tenant_id", "dataset_id")) -> DataFrame:
    """Has a dataset files that are still waited for?"""
    return files.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("status").isin("UPLOADED_PENDING", "PROCESSING")), F.lit(False)).alias("active"))


def artifact(kind: str) -> Column:
    """Where a job's artifact of one kind is; null if it has none."""
    return F.try_element_at("artifacts", F.lit(kind))


def raw_key() -> Column:
    """A file's stored key, or the one that it would have."""
    own = F.when(F.col("raw_key") != "", F.col("raw_key"))
    name = F.coalesce(F.when(F.col("filename") != "", F.col("filename")), F.lit("document.pdf"))
    return F.coalesce(own, F.concat_ws("/", F.lit("raw"), "tenant_id", "dataset_id", F.col("file_id").cast("string"), name))


def iso(moment: Column, milliseconds: bool = False) -> Column:
    """A moment as UTC in ISO form, in whole seconds or milliseconds; the session's time zone has to be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if milliseconds else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def orphans(datasets: DataFrame, prefix: str, before: Column) -> DataFrame:
    """Datasets whose name begins with a prefix and that were made before a time."""
    return datasets.where(F.col("name").startswith(prefix) & (F.col("created_at") < before))


def dataset_figures(datasets: DataFrame, files: DataFrame) -> DataFrame:
    """Every dataset with its numbers of files: total, ready, processing, failed; 0 without files. No file of this pipeline ever
    is READY (only COMPLETE), so ready is 0 unless other writers set it."""
    keys = ["tenant_id", "dataset_id"]
    n = files.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("READY", "PROCESSING", "FAILED")))
    return datasets.join(n, keys, "left").na.fill(0, ["total", "ready", "processing", "failed"])


def totals(figures: DataFrame) -> DataFrame:
    """Sums over datasets, and the share that is ready in whole per cent (0 without files)."""
    sums = figures.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "ready", "processing", "failed")))
    return sums.withColumn("ready_percent", F.coalesce(F.round(F.try_divide(F.col("ready") * 100, F.col("total"))), F.lit(0)).cast("int"))


def by_severity(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings of each key by severity, in the fixed order: by, rank, severity, types (sorted), n."""
    rank = F.array_position(F.array(*(F.lit(s) for s in ("CRITICAL", "WARN", "INFO"))), F.col("severity"))
    return findings.where(rank > 0).groupBy(*by, rank.alias("rank"), "severity").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n"))


def counts(chunks: DataFrame, by: tuple[str, ...] = ("tenant_id", "dataset_id")) -> DataFrame:
    """Rows by tenant and dataset, for comparing two stores."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n"))


def dataset_order(how: str = "newest", tie: str | None = "dataset_id") -> list[Column]:
    """The columns of one of the four orders of datasets: by time, or by name whatever its case; equal ones by `tie`, or as they fall."""
    name = F.collate(F.coalesce("name", F.lit("")), "UNICODE_CI")
    orders = {"newest": F.desc("created_at"), "oldest": F.asc("created_at"), "name-asc": name.asc(), "name-desc": name.desc()}
    return [orders[how], *([F.asc(tie)] if tie else [])]


def sorted_datasets(datasets: DataFrame, how: str = "newest", tie: str = "dataset_id") -> DataFrame:
    """datasets in one of the orders; equal ones by `tie`, if they have that column."""
    return datasets.orderBy(*dataset_order(how, tie if tie in datasets.columns else None))


def named_like(datasets: DataFrame, part: str) -> DataFrame:
    return datasets.where(F.lower("name").contains(part.lower()))


def latest_jobs(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files with their latest job as a struct, null if there is none."""
    keys = ["tenant_id", "file_id"]
    job = jobs.select(*keys, F.col("job_id").alias("latest_job_id"), F.struct(*(c for c in jobs.columns if c not in keys)).alias("job"))
    return files.join(job, [*keys, "latest_job_id"], "left")
