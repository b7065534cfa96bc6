"""Repairs of content documents and package metadata: each a rewrite of the rows that need it.

Order: links to body ids, language, stray images, XML declaration. A repaired text is stable: a
second repair changes nothing, and a clean text stays byte for byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECLARATION = '<?xml version="1.0" encoding="utf-8"?>\n'


def body_ids(docs: DataFrame) -> DataFrame:
    """pkg_id, name, id: the ids that stand on body elements."""
    found = F.regexp_extract("text", r"""(?is)<body\b[^>]*\sid\s*=\s*["']([^"']*)["']""", 1)
    return docs.select("pkg_id", F.element_at(F.split("path", "/"), -1).alias("name"), found.alias("id")).where("id <> ''")


def body_links(docs: DataFrame) -> DataFrame:
    """docs: pkg_id, path, text. Links to a document's body id become links to the document.

    A document meets only the targets that its own links name: links are joined to the body ids."""
    links = docs.select("pkg_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"""([^"'/\s=]+#[^"'\s]+)["']"""), F.lit(1)))).alias("target"))
    named = links.join(body_ids(docs).select("pkg_id", F.concat("name", F.lit("#"), "id").alias("target")).distinct(), ["pkg_id", "target"], "left_semi")
    joined = docs.join(named.groupBy("pkg_id", "path").agg(F.collect_set("target").alias("targets")), ["pkg_id", "path"], "left")
    put = F.aggregate(F.coalesce("targets", F.array().cast("array<string>")), F.col("text"), lambda text, t: F.when(F.contains(text, t), F.replace(F.replace(text, F.concat(t, F.lit('"')), F.concat(F.substring_index(t, "#", 1), F.lit('"'))), F.concat(t, F.lit("'")), F.concat(F.substring_index(t, "#", 1), F.lit("'")))).otherwise(text))
    return joined.select(*[c for c in docs.columns if c != "text"], put.alias("text"))


def simple_language(tag: Column) -> Column:
    return F.lower(F.substring_index(F.replace(F.trim(tag), F.lit("_"), F.lit("-")), "-", 1))


def without_stray_images(text: Column) -> Column:
    """Images without a source go."""
    return F.regexp_replace(text, r"""(?is)<img\b(?![^>]*\ssrc\s*=\s*["'][^"'])[^>]*?/?>""", "")


def with_declaration(text: Column) -> Column:
    return F.when(F.ltrim(text).startswith("<?xml"), text).otherwise(F.concat(F.lit(DECLARATION), text))


def repaired(docs: DataFrame) -> DataFrame:
    """The steps of content documents; repaired_language has that of package documents. docs: pkg_id, path, text -> the same with text repaired, and fixes: the kinds of what was done."""
    linked = body_links(docs).withColumnRenamed("text", "t1").join(docs.select("pkg_id", "path", "text"), ["pkg_id", "path"])
    t2 = linked.withColumn("t2", without_stray_images(F.col("t1"))).withColumn("t3", with_declaration(F.col("t2")))
    fixes = F.array_compact(F.array(F.when(F.col("t1") != F.col("text"), F.lit("body_id_link")), F.when(F.col("t2") != F.col("t1"), F.lit("stray_image")), F.when(F.col("t3") != F.col("t2"), F.lit("declaration"))))
    return t2.select("pkg_id", "path", F.col("t3").alias("text"), fixes.alias("fixes"))


def repaired_language(opfs: DataFrame) -> DataFrame:
    """pkg_id, path, text of package documents -> the same with each language as a simple tag, and fixes."""
    pattern = r"(?is)(<dc:language\b[^>]*>)([^<]*)(</dc:language>)"
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))

    def simple(text: Column, found: Column) -> Column:
        tag = F.regexp_extract(found, pattern, 2)
        return F.replace(text, found, F.concat(F.regexp_extract(found, pattern, 1), simple_language(tag), F.regexp_extract(found, pattern, 3)))

    put = opfs.withColumn("was", F.col("text")).withColumn("text", F.aggregate(F.array_distinct(whole), F.col("text"), simple))
    return put.select("pkg_id", "path", "text", F.when(F.col("text") != F.col("was"), F.array(F.lit("language"))).otherwise(F.array().cast("array<string>")).alias("fixes"))


def report(fixed: DataFrame) -> DataFrame:
    """One JSON text for each package: its files and their fixes."""
    rows = fixed.where(F.size("fixes") > 0).select("pkg_id", F.struct("path", "fixes").alias("f"))
    return rows.groupBy("pkg_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("f")).alias("fixes"))).alias("report"))
