"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset on one machine a temporary folder is made; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), f"sonargrid-{spark.sparkContext.applicationId}")
        os.makedirs(found, exist_ok=True)
        found = f"file://{found}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sonargrid_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut that nothing reads any more."""
    path = getattr(df, "_sonargrid_path", None)
    if path:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
