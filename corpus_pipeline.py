"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of documents. A stage's result is written and read again as
the next one's docs.

- quality_rules drops the documents that the rules reject.
- simhash_near_dedup keeps the smallest id of each component of texts whose five-word shingles
  have a Jaccard similarity of 0.8 or more. Fingerprints within two bits, by pigeonring keys, and within
  twelve, by shared runs of bits, give most links, all confirmed; groups of shared shingles give the rest.
- substring_dedup takes repeated passages out of texts; n_chars is counted again for a text
  that lost words. A text that lost all of them stays as an empty one.
- decontaminate drops documents that hold a test item.
- best_fit_packing returns the pieces and their places.

Null ids or texts, repeated rows and empty tables are handled as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import common
from bindery.llm.decontaminate import keep_clean
from bindery.llm.packing import pack
from bindery.llm.quality_rules import keep_good
from bindery.llm.simhash import keep_one
from bindery.llm.substring_dedup import substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = substring_dedup(docs)
    chars = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

#: Suffix arrays, fingerprints, alignment and tokens are beyond SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
        kept.append(docs)
    common.dropped(*kept[:-1])
    return docs
