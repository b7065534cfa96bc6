"""Records, offsets and packing of byte streams."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD_BYTES = 4096
#: Text of more records than this is cut into larger ones.
MOST_RECORDS = 65_000


def chunk_size(length: Column) -> Column:
    """4096, doubled until the text fits in the greatest number of records."""
    need = F.ceil(length / F.lit(RECORD_BYTES * MOST_RECORDS))
    return (F.lit(RECORD_BYTES) * F.pow(F.lit(2), F.when(need > 1, F.ceil(F.log2(need))).otherwise(0))).cast("int")


def record_ranges(docs: DataFrame, length: str, size: int | None = None) -> DataFrame:
    """A row for each record of a text of length bytes: rec_no, begin, bytes. An empty text has none."""
    width = F.lit(size) if size else chunk_size(F.col(length))
    sized = docs.withColumn("__size", width).where(F.col(length) > 0)
    cut = sized.withColumn("rec_no", F.explode(F.sequence(F.lit(0), F.expr(f"cast(({length} - 1) div __size as int)"))))
    begin = (F.col("rec_no") * F.col("__size")).cast("long")
    return cut.withColumn("begin", begin).withColumn("bytes", F.least(F.col("__size").cast("long"), F.col(length) - begin)).drop("__size")


def running_offsets(rows: DataFrame, size: str, order: list[str], by: list[str]) -> DataFrame:
    """Adds offset, the sizes before a row in its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def record_table(records: DataFrame, file: str = "file_id") -> DataFrame:
    """Offsets of a record container: 78 bytes of header, 8 for each record and 2 of padding come first."""
    counts = records.groupBy(file).agg(F.count(F.lit(1)).alias("n_records"))
    placed = running_offsets(records, "size", ["rec_no"], [file]).join(counts, file)
    return placed.withColumn("offset", F.col("offset") + 78 + 8 * F.col("n_records") + 2)


def _pack(pdf: pd.DataFrame, size: str, order: str, limit: int) -> pd.DataFrame:
    pdf = pdf.sort_values(order, kind="stable")
    bins, offsets, held, k = [], [], 0, 0
    for n in pdf[size]:
        if held and held + n > limit:
            k, held = k + 1, 0
        bins.append(k)
        offsets.append(held)
        held += n
    return pdf.assign(bin=bins, bin_offset=offsets)


def greedy_pack(rows: DataFrame, size: str, order: str, by: str, limit: int = 64_000) -> DataFrame:
    """Adds bin, bin_offset: rows in order, a new bin where the next one would pass the limit.

    The rollover depends on all rows before it, so a package's rows are one ordered group."""
    schema = f"{rows._jdf.schema().toDDL()}, bin long, bin_offset long"
    return rows.groupBy(by).applyInPandas(partial(_pack, size=size, order=order, limit=limit), schema)


def string_pool(strings: DataFrame, by: str = "pkg_id", limit: int = 64_512) -> DataFrame:
    """Distinct strings in first-seen order, packed: pool_offset is bin * 65536 + place."""
    first = strings.groupBy(by, "value").agg(F.min("ord").alias("ord")).withColumn("size", (F.octet_length("value") + 1).cast("long"))
    return greedy_pack(first, "size", "ord", by, limit).withColumn("pool_offset", F.col("bin") * 65536 + F.col("bin_offset"))


def overlaps(nodes: DataFrame, records: DataFrame, by: str, width: int) -> DataFrame:
    """nodes (start, length) x records (rec_start, rec_end): each overlap and its class.

    Both sides are laid out by the records' fixed width, so the join has an equal key and no
    pair that doesn't touch is made. A node runs over its records alone."""
    spread = nodes.where("length > 0").withColumn("rec_no", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + length - 1) div {width}"))))
    both = spread.join(records, [by, "rec_no"])
    end = F.col("start") + F.col("length")
    kind = (
        F.when((F.col("start") < F.col("rec_start")) & (end > F.col("rec_end")), "spans")
        .when((F.col("start") < F.col("rec_start")) & (end <= F.col("rec_end")), "ends")
        .when((F.col("start") >= F.col("rec_start")) & (end > F.col("rec_end")), "starts")
        .otherwise("completes")
    )
    return both.where((F.col("start") < F.col("rec_end")) & (end > F.col("rec_start"))).withColumn("class", kind)
