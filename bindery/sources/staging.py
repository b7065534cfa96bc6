"""Tables that several plans share, written once into the folder that all machines see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where a local master has none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="bindery-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet: plans on it are short, push filters and columns down, and survive lost machines."""
    spark = df.sparkSession
    path = f"{folder(spark)}/bindery-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
