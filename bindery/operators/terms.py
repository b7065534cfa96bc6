"""Dictionary terms: headwords, inflections and aliases with precedence, their order, and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_latin, plain_spaces, strip_stress

HEADWORD, INFLECTION, STRESS, CASE, SPACE = range(5)


def build_terms(entries: DataFrame, pkg: str = "pkg_id", strict_accents: bool = False) -> DataFrame:
    """entries: pkg, entry_ord, headword, inflections -> pkg, label, tier, entry_ord, fold_key.

    One row for a label. Of equal headwords the last entry counts; inflections with brackets are
    left out, the first of equal ones counts and none overrides a headword; aliases without
    stress marks, in lower case (unless strict_accents), and with plain spaces come last. Labels are
    pre-aggregated, so a label that a third of all entries share is one row to each task."""
    place = lambda tier, ord_, k: F.struct(F.lit(tier).alias("tier"), ord_.alias("rank"), k.alias("k"), F.col("entry_ord"))
    heads = entries.select(pkg, F.col("headword").alias("label"), place(HEADWORD, -F.col("entry_ord"), F.lit(0)).alias("p"))
    forms = entries.select(pkg, "entry_ord", F.posexplode("inflections").alias("k", "label")).where(~F.col("label").rlike(r"[()\[\]{}]"))
    forms = forms.select(pkg, "label", place(INFLECTION, F.col("entry_ord"), F.col("k")).alias("p"))
    base = heads.unionByName(forms)
    alias = lambda df, tier, x: df.select(pkg, x.alias("label"), F.struct(F.lit(tier).alias("tier"), F.col("p.rank").alias("rank"), F.col("p.k").alias("k"), F.col("p.entry_ord").alias("entry_ord")).alias("p"), F.col("label").alias("was")).where("label <> was").drop("was")
    more = alias(base, STRESS, strip_stress(F.col("label")))
    if not strict_accents:
        more = more.unionByName(alias(base, CASE, F.lower("label")))
    labels = base.unionByName(more)
    labels = labels.unionByName(alias(labels, SPACE, plain_spaces(F.col("label"))))
    one = labels.where(F.col("label") != "").groupBy(pkg, "label").agg(F.min("p").alias("p"))
    return one.select(pkg, "label", F.col("p.tier").alias("tier"), F.col("p.entry_ord").alias("entry_ord"), fold_latin(F.col("label")).alias("fold_key"))


def ordered_terms(terms: DataFrame, pkg: str = "pkg_id", folded: bool = True) -> DataFrame:
    """Adds index_ord, the place in the index. Range partitioning sorts, and sizes of the ranges
    give the ranges' first places, so a package may hold any number of terms."""
    key = [F.col("fold_key").cast("binary")] if folded else []
    order = [F.col(pkg), *key, F.encode("label", "UTF-16BE")]
    ranged = terms.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy(pkg, "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__low"))
    ahead = Window.partitionBy(pkg).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("__base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    return ranged.join(firsts, [pkg, "__part"]).withColumn("index_ord", F.col("__base") + F.col("__at") - F.col("__low")).drop("__part", "__at", "__base", "__low")


def lookup(terms: DataFrame, queries: DataFrame, mode: str = "fold", pkg: str = "pkg_id") -> DataFrame:
    """queries: pkg, query -> query, label, entry_ord (null for a miss).

    fold: the exact label, else the first label in index order with the query's fold key;
    literal: the exact label; plain: the query, its lower case, it without stress marks, and both."""
    if mode == "plain":
        q = F.col("query")
        tries = F.array(*[F.struct(F.lit(k).alias("rank"), x.alias("label")) for k, x in enumerate((q, F.lower(q), strip_stress(q), F.lower(strip_stress(q))))])
        asked = queries.select(pkg, "query", F.inline(tries))
        found = asked.join(terms, [pkg, "label"])
        rank = F.struct("rank", "label", "entry_ord")
    elif mode == "literal":
        found = queries.withColumn("label", F.col("query")).join(terms, [pkg, "label"])
        rank = F.struct(F.lit(0).alias("rank"), "label", "entry_ord")
    else:
        found = queries.withColumn("fold_key", fold_latin(F.col("query"))).join(terms, [pkg, "fold_key"])
        rank = F.struct((F.col("label") != F.col("query")).alias("rank"), F.encode("label", "UTF-16BE").alias("bytes"), "label", "entry_ord")
    best = found.groupBy(pkg, "query").agg(F.min(rank).alias("best")).select(pkg, "query", "best.label", "best.entry_ord")
    return queries.distinct().join(best, [pkg, "query"], "left")


def script_majority(entries: DataFrame, pkg: str = "pkg_id") -> DataFrame:
    """Whether most letters of a package's headwords are Latin, or Cyrillic."""
    from ..functions.text import script_counts

    s = entries.select(pkg, script_counts(F.col("headword")).alias("s")).select(pkg, "s.*")
    t = s.groupBy(pkg).agg(*[F.sum(c).alias(c) for c in ("letters", "latin", "cyrillic", "greek")])
    return t.select("*", (2 * F.col("latin") > F.col("letters")).alias("is_latin"), (2 * F.col("cyrillic") > F.col("letters")).alias("is_cyrillic"))


def symbol_table(labels: DataFrame, pkg: str = "pkg_id") -> DataFrame:
    """Distinct characters of label, with a dense weight for each fold base and a number in code point order."""
    chars = labels.select(pkg, F.explode(F.split("label", "")).alias("char")).where("char <> ''").distinct()
    coded = chars.withColumn("code_point", F.ascii("char")).withColumn("base", fold_latin(F.col("char")))
    by_base = Window.partitionBy(pkg).orderBy(F.col("base").cast("binary"))
    return coded.withColumn("weight", F.dense_rank().over(by_base)).withColumn("symbol_no", F.row_number().over(Window.partitionBy(pkg).orderBy("code_point")))


def inverted_index(entries: DataFrame, pkg: str = "pkg_id") -> tuple[DataFrame, DataFrame]:
    """The sorted index with running byte offsets, and the synonyms that are no headwords.

    Order: by A-Z-folded bytes, then source order; first of equal headwords wins. Offsets are sums
    of sizes before a row, over the rows of a package."""
    from ..functions.text import ascii_key

    one = entries.groupBy(pkg, "headword").agg(F.min_by(F.struct("entry_ord", "html", "inflections"), "entry_ord").alias("e")).select(pkg, "headword", "e.*")
    keyed = one.withColumn("key", ascii_key(F.col("headword")))
    order = Window.partitionBy(pkg).orderBy("key", "entry_ord")
    index = keyed.withColumn("idx", F.row_number().over(order) - 1).withColumn("size", F.octet_length("html").cast("long"))
    index = index.withColumn("offset", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    forms = index.select(pkg, "idx", F.explode("inflections").alias("form")).withColumn("key", ascii_key(F.col("form")))
    synonyms = forms.join(index.select(pkg, "key").distinct(), [pkg, "key"], "left_anti").select(pkg, "form", "idx", "key").distinct()
    return index, synonyms


def search_forms(entries: DataFrame, pkg: str = "pkg_id") -> DataFrame:
    """Each entry's distinct search forms, its headword first, in source order."""
    return entries.select(pkg, "entry_ord", F.array_distinct(F.concat(F.array("headword"), F.coalesce("inflections", F.array().cast("array<string>")))).alias("forms"))
