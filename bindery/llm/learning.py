"""What the trained operators share: labels, folds, and per-row features kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def labels_of(labels: DataFrame, target: str, modulus: int, out: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label of the rows to learn from; the larger label counts if an id has several."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label is not null").where(common.fold(F.col("doc_id"), modulus) != out)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def held_out(modulus: int, out: int):
    """Whether doc_id is in the fold that is not learnt from; false for a null id."""
    return F.coalesce(common.fold(F.col("doc_id"), modulus) == out, F.lit(False))
