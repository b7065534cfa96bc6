"""The rule catalog: level and profiles of each rule.

Levels: 2 info, 3 warning, 4 error. Profile bits: 1 default, 2 comic, 4 dictionary, 8 textbook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = {"I": 2, "W": 3, "E": 4}
PROFILES = {"all": 15, "dict": 4, "comic+text": 10, "default+dict": 5}
# The rules by level and profiles.
RULES = {
    ("I", "all"): "R4.1.1",
    ("E", "all"): "R4.2.1 R4.2.2 R4.2.4 R5.2.3 R5.3.1 R6.3 R6.4 R6.5 R6.6 R6.7 R6.9 R6.11 R6.12 R10.4.1 R17.1 R7.2 R7.3 R7.4 R7.5 R7.8 R7.9 R7.10 R7.11 R7.12 R7.13 R8.1 R8.2 R8.3 R8.4 R8.5 R8.8 R8.10 R9.3 R9.4 R9.5 R9.6 R9.7 R9.9 R9.11 R9.12 R5.5 R5.7 R5.10 R5.11 R13.1 R13.5 R10.4.3 R10.4.4 R6.13 R6.15 R6.16 R6.17 R16.1 R16.3 R16.7 R16.8",
    ("W", "all"): "R4.2.3 R5.1 R5.2.1 R5.2.2 R6.1 R6.2 R6.8 R6.10 R10.3.1 R10.4.2a R10.4.2b R10.5.1 R7.1 R7.6 R7.7 R8.6 R8.7 R8.9 R9.1 R9.2 R9.8 R9.10 R5.4 R5.6 R5.8 R5.9 R13.2 R13.3 R13.4 R10.4.5 R6.e1 R6.e2 R16.2 R16.4 R16.5 R16.6",
    ("E", "dict"): "R15.1 R15.2 R15.3 R15.4 R15.6 R15.e1 R15.e2 R15.e4 R15.e5 R15.e6 R15.e7",
    ("W", "dict"): "R15.5 R15.7 R15.e3",
    ("E", "comic+text"): "R11.1 R11.2 R11.3 R11.4 R11.5 R11.6 R11.7",
    ("W", "comic+text"): "R11.8 R11.9",
    ("E", "default+dict"): "R6.14",
}


def rules() -> list[tuple[str, int, int]]:
    """(id, level, profile mask) of every rule."""
    return [(r, LEVELS[level], PROFILES[who]) for (level, who), names in RULES.items() for r in names.split()]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "rule_id string, level int, mask int")


def judged(findings: DataFrame, pkg: DataFrame) -> DataFrame:
    """Adds levels, and leaves out findings whose rule is not for the package's profile. The catalog
    is a constant of a hundred rows, so it is broadcast."""
    c = F.broadcast(catalog(findings.sparkSession))
    known = findings.join(c, "rule_id").join(pkg.select("pkg_id", "profile"), "pkg_id")
    return known.where(F.col("mask").bitwiseAND(F.col("profile")) != 0).drop("mask", "profile")
