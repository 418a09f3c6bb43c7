"""Requests for datasets and uploads as tables: what each is answered, the rows that come of it, and the events for the audit log.

Ids are made of the tenant and the request's own id, so a request that is handled again gives the same rows; put them with catalog.put
or a keyed table. A request is answered 400 if it lacks a field, 404 if its dataset is not the tenant's, else 200 (201 for a new
dataset); only then it has rows. request_id has to be different for each request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.catalog import missing_fields


@dataclass(frozen=True)
class Handled:
    answers: DataFrame  # request_id, code, missing (names of fields), and the new row's id
    rows: DataFrame  # of datasets, or of files
    events: DataFrame  # tenant_id, created_at, type, metadata
    datasets: DataFrame | None = None  # for uploads: tenant_id, dataset_id, status and updated_at of datasets that are set back


def _made_id(kind: str) -> Column:
    return F.left(F.sha2(F.concat_ws("|", F.lit(kind), "tenant_id", F.col("request_id").cast("string")), 256), F.lit(32))


def create_datasets(requests: DataFrame, at: Column) -> Handled:
    """requests: request_id, tenant_id, name. New datasets are UPLOADED, their names without white space around."""
    asked = requests.select("request_id", "tenant_id", "name", missing_fields("dataset").alias("missing"), at.alias("at")).withColumn("dataset_id", _made_id("dataset"))
    done = asked.where(F.size("missing") == 0).withColumn("name", strip("name"))
    code = F.when(F.size("missing") > 0, 400).otherwise(201)
    rows = done.select("tenant_id", "dataset_id", "name", F.lit("UPLOADED").alias("status"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    events = done.select("tenant_id", F.col("at").alias("created_at"), F.lit("DATASET_CREATED").alias("type"), F.create_map(F.lit("datasetId"), "dataset_id", F.lit("name"), "name").alias("metadata"))
    return Handled(asked.select("request_id", code.alias("code"), "missing", F.when(code == 201, F.col("dataset_id")).alias("dataset_id")), rows, events)


def presign(requests: DataFrame, datasets: DataFrame, at: Column) -> Handled:
    """requests: request_id, tenant_id, dataset_id, filename, content_type. Files are UPLOADED_PENDING, and their datasets UPLOADED
    again, once each however many files come."""
    asked = requests.select("request_id", "tenant_id", "dataset_id", "filename", "content_type", missing_fields("file").alias("missing"), at.alias("at")).withColumn("file_id", _made_id("file"))
    keys = ["tenant_id", "dataset_id"]
    known = asked.join(datasets.select(*keys).distinct().withColumn("there", F.lit(True)), keys, "left")
    code = F.when(F.size("missing") > 0, 400).when(F.col("there").isNull(), 404).otherwise(200)
    known = known.withColumn("code", code).withColumn("raw_key", F.concat_ws("/", F.lit("raw"), "tenant_id", "dataset_id", "file_id", "filename"))
    done = known.where("code = 200")
    rows = done.select(*keys, "file_id", "filename", "content_type", "raw_key", F.lit("UPLOADED_PENDING").alias("status"), F.col("at").alias("created_at"))
    events = done.select("tenant_id", F.col("at").alias("created_at"), F.lit("UPLOAD").alias("type"), F.create_map(F.lit("datasetId"), "dataset_id", F.lit("fileId"), "file_id", F.lit("filename"), "filename").alias("metadata"))
    back = done.groupBy(*keys).agg(F.max("at").alias("updated_at")).select(*keys, F.lit("UPLOADED").alias("status"), "updated_at")
    yes = F.col("code") == 200
    return Handled(known.select("request_id", "code", "missing", F.when(yes, F.col("file_id")).alias("file_id"), F.when(yes, F.col("raw_key")).alias("raw_key")), rows, events, back)
