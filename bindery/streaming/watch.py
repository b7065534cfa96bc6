"""Validation of packages as they arrive: a folder is watched, and each batch is validated whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..rules.checks import validate
from ..sources.packages import _unzip, read


def watch(spark: SparkSession, folder: str, findings: str, checkpoint: str, rules: list[str] | None = None, once: bool = False) -> StreamingQuery:
    """Zip packages that come into folder -> findings as Parquet. A package is a file, so no state crosses batches."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = raw.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content").mapInPandas(_unzip, "pkg_id string, path string, content binary")

    def each(batch: DataFrame, batch_id: int) -> None:
        validate(read(batch), rules).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(findings)

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
