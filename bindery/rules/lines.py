"""Rules on the text of content documents, as filters on lines, matches and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

# Tags that devices don't support, and entities that need no declaration.
UNSUPPORTED_TAGS = ["script", "form", "input", "button", "select", "textarea", "fieldset", "legend", "frame", "frameset", "iframe", "noframes", "applet", "embed", "object", "canvas"]
ALLOWED_ENTITIES = ["amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "ndash", "mdash", "hellip", "lsquo", "rsquo", "ldquo", "rdquo", "bull"]
ERROR, WARNING, INFO = 4, 3, 2


def numbered_lines(docs: DataFrame, key, text: str) -> DataFrame:
    """A row for each line of each text: key, line (from 1), content."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = docs.select(*keys, F.posexplode(lines(F.col(text))).alias("line", "content"))
    return rows.withColumn("line", F.col("line") + 1)


def unsupported_tags(docs: DataFrame, key, text: str) -> DataFrame:
    """key, line, tag: a row for each line and unsupported tag that opens on it."""
    keys = [key] if isinstance(key, str) else list(key)
    opens = F.array_compact(F.array(*[F.when(F.col("content").rlike(rf"(?i)<{t}([\s>/]|$)"), F.lit(t)) for t in UNSUPPORTED_TAGS]))
    return numbered_lines(docs, key, text).select(*keys, "line", F.explode(opens).alias("tag"))


def undeclared_entities(docs: DataFrame, key, text: str) -> DataFrame:
    """key, name: the first named entity of each text that is not on the list."""
    keys = [key] if isinstance(key, str) else list(key)
    names = F.regexp_extract_all(text, F.lit("&([A-Za-z][A-Za-z0-9]*);"))
    first = F.get(F.filter(names, lambda n: ~n.isin(ALLOWED_ENTITIES)), F.lit(0))
    return docs.select(*keys, first.alias("name")).where("name is not null")


def nested_paragraphs(docs: DataFrame, key, text: str) -> DataFrame:
    """key, nested, deepest: whether a paragraph opens inside one, by a depth that closing tags don't take below 0."""
    keys = [key] if isinstance(key, str) else list(key)
    tags = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)<(/?p)[\s>]")), F.lower)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("nested"), F.lit(0).alias("deepest"))

    def step(s, t):
        depth = F.when(t == "p", s.depth + 1).otherwise(F.greatest(s.depth - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), (s.nested | ((t == "p") & (s.depth >= 1))).alias("nested"), F.greatest(s.deepest, depth).alias("deepest"))

    return docs.select(*keys, F.aggregate(tags, zero, step).alias("s")).select(*keys, "s.nested", "s.deepest")


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    level = lambda n: F.count_if(F.col("level") == n)
    return findings.groupBy(*by).agg(level(ERROR).alias("errors"), level(WARNING).alias("warnings"), level(INFO).alias("infos"))
