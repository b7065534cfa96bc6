"""Assembly of a dictionary's text: entries one after another, and where each begins and ends.

Places come from sums of lengths, not from searches in the text, so every entry has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import index_text
from .layout import record_ranges, running_offsets

RULE = "<hr/>"


def entry_text(entries: DataFrame, order: list[str], pkg: str = "pkg_id") -> DataFrame:
    """Adds text (plain markup), size in bytes, offset in the package's text, and text_len: the bytes
    before the first rule at or after the entry's start, so a rule inside a definition ends its span."""
    plain = entries.withColumn("text", index_text(F.col("html"))).withColumn("size", F.octet_length("text").cast("long"))
    placed = running_offsets(plain, "size", order, [pkg])
    return placed.withColumn("text_len", F.octet_length(F.substring_index("text", RULE, 1)).cast("long"))


def package_text(placed: DataFrame, pkg: str = "pkg_id") -> DataFrame:
    """pkg, content: the whole text of each package, which is one file."""
    parts = placed.groupBy(pkg).agg(F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("parts"))
    return parts.select(pkg, F.array_join(F.transform("parts", lambda p: p.text), "").cast("binary").alias("content"))


def text_records(texts: DataFrame, pkg: str = "pkg_id") -> DataFrame:
    """pkg, content -> pkg, rec_no, begin, bytes (the record's own)."""
    sized = texts.withColumn("n", F.octet_length("content").cast("long"))
    cut = record_ranges(sized, "n")
    return cut.select(pkg, "rec_no", "begin", F.expr("substring(content, cast(begin as int) + 1, cast(bytes as int))").alias("bytes"))


def split_words(recs: DataFrame, pkg: str = "pkg_id") -> DataFrame:
    """Adds overlap: the bytes at a record's begin that belong to a character of the record before."""
    first = F.hex(F.substring("bytes", 1, 3))
    follows = lambda k: F.substring(first, 2 * k + 1, 1).isin("8", "9", "A", "B")
    n = F.when(~follows(0), 0).when(~follows(1), 1).when(~follows(2), 2).otherwise(3)
    return recs.withColumn("overlap", F.when(F.lag("rec_no").over(Window.partitionBy(pkg).orderBy("rec_no")).isNull(), 0).otherwise(n))
