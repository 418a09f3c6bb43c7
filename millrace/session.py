"""A session with the settings that results depend on (sizes are the cluster's to set), and the dealing of small tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in {**fixed, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spread(rows: DataFrame) -> DataFrame:
    """A table's rows dealt evenly to all cores where its files make fewer tasks than that (a small table of one row group, say);
    as they are otherwise, so that a large table is never shuffled for it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a local temporary one only where that is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again, where a plan needs the same dear rows several times."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
