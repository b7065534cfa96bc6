"""Metadata: differences and their application, duplicates, feature sets, font signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code point ranges and their bits in a font signature.
UNICODE_RANGES = [
    (0x0020, 0x007F, 0), (0x0080, 0x00FF, 1), (0x0100, 0x024F, 2), (0x0250, 0x02AF, 3), (0x02B0, 0x02FF, 5), (0x0300, 0x036F, 6),
    (0x0370, 0x03FF, 7), (0x0400, 0x04FF, 9), (0x0530, 0x058F, 10), (0x0590, 0x05FF, 11), (0x0600, 0x06FF, 13), (0x0E00, 0x0E7F, 24),
    (0x10A0, 0x10FF, 26), (0x1100, 0x11FF, 28), (0x1E00, 0x1EFF, 29), (0x1F00, 0x1FFF, 30), (0x2000, 0x206F, 31), (0x2070, 0x209F, 32),
    (0x20A0, 0x20CF, 33), (0x2100, 0x214F, 35), (0x2150, 0x218F, 36), (0x2190, 0x21FF, 37), (0x2200, 0x22FF, 38), (0x3000, 0x303F, 48),
    (0x3040, 0x309F, 49), (0x30A0, 0x30FF, 50), (0x3100, 0x312F, 51), (0x3130, 0x318F, 52), (0x4E00, 0x9FFF, 59), (0xAC00, 0xD7AF, 56),
    (0xFB00, 0xFB06, 62), (0xFB50, 0xFDFF, 63), (0xFE70, 0xFEFF, 67),
]


def plan_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: file, type, value -> file, type, old, new, op. A null new value leaves, an empty one
    deletes, another one replaces; an equal value is no change."""
    o, n = old.withColumnRenamed("value", "old"), new.withColumnRenamed("value", "__new")
    both = o.join(n, ["file", "type"], "full")
    real = F.col("__new").isNotNull() & ~(F.col("old").isNull() & (F.col("__new") == "")) & ~F.coalesce(F.col("old") == F.col("__new"), F.lit(False))
    op = F.when(F.col("old").isNull(), "added").when(F.col("__new") == "", "removed").otherwise("replaced")
    return both.where(real).select("file", "type", "old", F.nullif(F.col("__new"), F.lit("")).alias("new"), op.alias("op"))


def apply_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of changed types go, new values come; the rest stays as it is."""
    kept = old.join(changes.select("file", "type").distinct(), ["file", "type"], "left_anti")
    return kept.unionByName(changes.where(F.col("new").isNotNull()).select("file", "type", F.col("new").alias("value")))


def case_duplicates(names: DataFrame, name: str) -> DataFrame:
    """Names that differ in case alone."""
    one = names.select(name).distinct().groupBy(F.lower(name).alias("fold"))
    return one.agg(F.count(F.lit(1)).alias("spellings"), F.min(name).alias("first_spelling"), F.max(name).alias("last_spelling")).where("spellings > 1")


def two_sided(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    mark = lambda df, side: df.withColumn("side", F.lit(side))
    return mark(used.exceptAll(declared), "used_only").unionByName(mark(declared.exceptAll(used), "declared_only"))


def font_signature(docs: DataFrame, by: str, text: str) -> DataFrame:
    """Range bits of the distinct characters in four words (the last bit is always set), how many have a
    range, and the characters beyond ASCII, moved up by 0x400, in order. The range of a code point is a
    fixed map, not a join; what meets in a group is one row for each distinct character."""
    code = F.ascii("char").cast("long")
    chars = docs.select(by, F.explode(F.split(text, "")).alias("char")).where("char <> ''").distinct().withColumn("cp", code)
    bit: Column | None = None
    for a, b, k in UNICODE_RANGES:
        hit = F.col("cp").between(a, b)
        bit = F.when(hit, k) if bit is None else bit.when(hit, k)
    known = chars.withColumn("bit", bit)
    part = lambda low: F.bit_or(F.when((F.col("bit") >= low) & (F.col("bit") < low + 32), F.expr(f"shiftleft(1L, bit - {low})")).otherwise(F.lit(0).cast("long")))
    moved = F.when(F.col("cp") > 0x7F, F.lpad(F.hex((F.col("cp") + 0x400).bitwiseAND(F.lit(0xFFFF))), 4, "0"))
    words = [part(0).alias("low_bits"), part(32).alias("high_bits"), part(64).alias("third_bits"), F.lit(1 << 31).cast("long").alias("fourth_bits")]
    return known.groupBy(by).agg(*words, F.count("bit").alias("covered"), F.array_join(F.array_sort(F.collect_list(moved)), "").alias("shifted"))


def holding(names: DataFrame, name: str, parts: DataFrame, part: str) -> DataFrame:
    """Names that hold one of the parts as a substring: by equal substrings of the parts' lengths."""
    sizes = sorted(r[0] for r in parts.select(F.length(part)).distinct().collect())  # distinct lengths alone
    if not sizes:
        return names.limit(0)
    cut = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda k, n=n: F.substring(F.col(name), k, F.lit(n))) for n in sizes]
    spread = names.select(name, F.explode(F.array_distinct(F.flatten(F.array(*cut)))).alias(part))
    return spread.join(parts.select(part).distinct(), part, "left_semi").select(name).distinct()
