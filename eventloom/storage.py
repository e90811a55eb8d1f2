"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster names it in
    spark.checkpoint.dir; only where that is unset and all runs on this machine, as in
    tests, is one made here."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    files: at most so many, for what is known to be small."""
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(spark)}/eventloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._eventloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    _delete(df.sparkSession, df._eventloom_path)


def forget_all(spark: SparkSession) -> None:
    """Delete every table that written() made in this application: results that read from
    them have to be saved before."""
    _delete(spark, f"{shared_dir(spark)}/eventloom/{spark.sparkContext.applicationId}")
