"""The rules, each a DataFrame of findings over the logical tables: pkg_id, rule_id, file, line, detail.

Shapes: filters, anti-joins, groups with a count, ordered scans, closures. A rule says nothing
of packages where its subject is missing, unless that is the finding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text as T
from ..functions.imagery import image_size
from ..operators.navigation import reaches
from ..sources.packages import Tables, xml_error
from . import lines as L
from .catalog import judged

CHECKS: dict[str, Callable[[Tables], DataFrame]] = {}
#: What builds the findings of a rule, which may be those of several rules.
_BUILT_BY: dict[str, Callable[[Tables], DataFrame]] = {}
COLUMNS = "pkg_id string, rule_id string, file string, line int, detail string"

# Names and types that the rules compare with.
NCX_TYPE = "application/x-dtbncx+xml"
CORE_TYPES = ["application/xhtml+xml", "image/svg+xml", "application/x-dtbook+xml"]
IMAGE_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/gif", "image/svg+xml"]
DEPRECATED_TYPES = {"image/jpg": "image/jpeg", "text/xml": "application/xml", "application/x-dtbook+xml": "application/xhtml+xml", "text/x-oeb1-document": "application/xhtml+xml"}
IGNORED_EXTENSIONS = ["epub", "mobi", "azw", "azw3", "kf8", "kfx", "kpf", "ds_store"]
IGNORED_NAMES = [".DS_Store", "Thumbs.db", "mimetype"]
IGNORED_FOLDERS = ["META-INF", ".git", "__MACOSX"]
RESERVED_PREFIXES = {
    "dcterms": "http://purl.org/dc/terms/",
    "epub": "http://www.idpf.org/2007/ops",
    "marc": "http://id.loc.gov/vocabulary/",
    "media": "http://www.idpf.org/epub/vocab/overlays/#",
    "onix": "http://www.editeur.org/ONIX/book/codelists/current.html#",
    "opf": "http://www.idpf.org/2007/opf",
    "rendition": "http://www.idpf.org/vocab/rendition/#",
    "schema": "http://schema.org/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
KNOWN_PROPERTIES = ["cover-image", "mathml", "nav", "remote-resources", "scripted", "svg", "switch", "coverimage"]
PROPERTY_TYPES = {
    "nav": ["application/xhtml+xml"],
    "svg": ["application/xhtml+xml"],
    "mathml": ["application/xhtml+xml", "image/svg+xml"],
    "scripted": ["application/xhtml+xml", "image/svg+xml"],
    "remote-resources": ["application/xhtml+xml", "image/svg+xml"],
    "cover-image": ["image/jpeg", "image/jpg", "image/png", "image/gif", "image/svg+xml", "image/webp"],
}
DOCTYPE_FILES = ["dtd/xhtml1-strict.dtd", "dtd/xhtml1-transitional.dtd", "dtd/xhtml1-frameset.dtd", "dtd/xhtml11.dtd"]
MEDIA_FEATURES = ["hover", "any-hover", "pointer", "any-pointer", "color-gamut", "prefers-color-scheme"]
SPREADS, ORIENTATIONS, LAYOUTS = ["auto", "landscape", "portrait", "both", "none"], ["auto", "landscape", "portrait"], ["reflowable", "pre-paginated"]


def check(*ids: str):
    def add(f):
        for i in ids:
            CHECKS[i] = (lambda f, i: lambda t: f(t).where(F.col("rule_id") == i))(f, i) if len(ids) > 1 else f
            _BUILT_BY[i] = f
        return f

    return add


def found(df: DataFrame, rule: str | Column, file=None, line=None, detail=None) -> DataFrame:
    """Findings of the rows of df."""
    put = lambda x, kind: (F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x).cast(kind)
    return df.select("pkg_id", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), put(file, "string").alias("file"), put(line, "int").alias("line"), put(detail, "string").alias("detail"))


def any_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def no_fragment(x) -> Column:
    return F.regexp_replace(x, "#.*$", "")


def resolved(base: str, url: str) -> Column:
    """A link's path from the package's root, with .. that leave it kept."""
    return T.normalize_path(F.concat(F.regexp_replace(base, "[^/]*$", ""), T.percent_decode(F.regexp_replace(url, "[?#].*$", ""))), keep_escapes=True)


# --- covers and images -------------------------------------------------------------------


def covers(t: Tables) -> DataFrame:
    """Declared covers, which are images: by property, else by the meta's id, else by the name that an
    older package gives for the embedded cover."""
    image = F.col("media_type").startswith("image/")
    by_property = t.item.where(F.arrays_overlap("properties", F.array(F.lit("cover-image"), F.lit("coverimage"))) & image).select("pkg_id", F.lit(0).alias("rank"), "path", "ordinal")
    meta = t.nodes("meta").where(F.lower(F.col("attrs")["name"]) == "cover").select("pkg_id", F.col("attrs")["content"].alias("id"))
    by_meta = meta.join(t.item_last.where(image), ["pkg_id", "id"]).select("pkg_id", F.lit(1).alias("rank"), "path", "ordinal")
    embedded = t.nodes("embeddedcover").select("pkg_id", F.trim("text").alias("href"))
    by_name = embedded.join(t.item.where(image), ["pkg_id", "href"]).select("pkg_id", F.lit(2).alias("rank"), "path", "ordinal")
    best = by_property.unionByName(by_meta).unionByName(by_name).groupBy("pkg_id").agg(F.min(F.struct("rank", "ordinal", "path")).alias("b"))
    return best.select("pkg_id", "b.path")


@check("R4.1.1")
def r4_1_1(t):
    return found(t.opf, "R4.1.1")


@check("R4.2.1")
def r4_2_1(t):
    return found(t.pkg.join(covers(t), "pkg_id", "left_anti"), "R4.2.1")


@check("R4.2.2")
def r4_2_2(t):
    missing = lambda x: x.join(t.files.select("pkg_id", "path"), ["pkg_id", "path"], "left_anti")
    return any_of(found(missing(covers(t)), "R4.2.2", "path"), found(missing(t.item.where(F.col("media_type").startswith("image/"))), "R4.2.2", "path"))


@check("R4.2.3")
def r4_2_3(t):
    s = t.image.join(covers(t), ["pkg_id", "path"], "left_semi").withColumn("s", image_size("content"))
    return found(s.where("least(s.width, s.height) < 500"), "R4.2.3", "path")


@check("R4.2.4")
def r4_2_4(t):
    c = covers(t).select("pkg_id", F.element_at(F.split("path", "/"), -1).alias("cover"))
    d = t.spine_doc.join(c, "pkg_id")
    named = F.lower("idref").contains("cover") | F.lower(F.element_at(F.split("path", "/"), -1)).contains("cover")
    return found(d.where(named & F.lower("text").contains("<img") & F.contains("text", "cover")), "R4.2.4", "path")


@check("R10.4.1")
def r10_4_1(t):
    return found(t.item.where(F.col("media_type").startswith("image/") & ~F.lower("media_type").isin(IMAGE_TYPES)), "R10.4.1", "href", None, "media_type")


@check("R10.4.2a")
def r10_4_2a(t):
    return found(t.image.where(F.col("bytes") > 127 * 1024), "R10.4.2a", "path", None, "bytes")


@check("R10.4.2b")
def r10_4_2b(t):
    s = t.image.where("media_type <> 'image/svg+xml'").withColumn("s", image_size("content"))
    return found(s.where("cast(s.width as long) * s.height > 5000000"), "R10.4.2b", "path")


@check("R10.4.3", "R10.4.4", "R10.4.5")
def image_integrity(t):
    i = t.image.where("media_type <> 'image/svg+xml'").withColumn("kind", T.magic_kind(F.col("content")))
    whole = F.when(F.col("kind") == "jpeg", F.hex(F.substring("content", -2, 2)) == "FFD9").when(F.col("kind") == "png", F.hex(F.substring("content", 13, 4)) == "49484452").when(F.col("kind") == "gif", F.hex(F.substring("content", -1, 1)) == "3B").otherwise(True)
    known = F.coalesce(F.col("kind").isin("jpeg", "png", "gif", "svg", "webp"), F.lit(False))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    fits = F.when(F.col("kind") == "jpeg", extension.isin("jpg", "jpeg")).otherwise(extension == F.col("kind"))
    return any_of(found(i.where(known & ~whole), "R10.4.3", "path", None, "kind"), found(i.where(~known), "R10.4.4", "path"), found(i.where(known & ~fits), "R10.4.5", "path", None, "kind"))


# --- navigation --------------------------------------------------------------------------


@check("R5.1")
def r5_1(t):
    length = t.spine_doc.groupBy("pkg_id").agg(F.sum(T.strip_tags_len(F.col("text"))).alias("n")).where("floor(n / 1800) > 20")
    return found(length.join(t.item.where(F.col("media_type") == NCX_TYPE), "pkg_id", "left_anti"), "R5.1", None, None, "n")


@check("R5.2.1")
def r5_2_1(t):
    return found(t.pkg.join(t.item.where(F.col("media_type") == NCX_TYPE), "pkg_id", "left_anti"), "R5.2.1")


@check("R5.2.2")
def r5_2_2(t):
    named = L.numbered_lines(t.opf, ["pkg_id", "path"], "text").where(F.contains("content", F.lit("<spine")) & F.contains("content", F.lit("toc=")))
    return found(t.opf.join(t.item.where(F.col("media_type") == NCX_TYPE), "pkg_id", "left_semi").join(named, "pkg_id", "left_anti"), "R5.2.2", "path")


@check("R5.2.3")
def r5_2_3(t):
    target = t.ncx_node.where("element = 'content'").select("pkg_id", "file", "line", no_fragment(F.col("attrs")["src"]).alias("href")).where("href <> ''")
    return found(target.join(t.item.select("pkg_id", "href"), ["pkg_id", "href"], "left_anti"), "R5.2.3", "file", "line", "href")


@check("R5.3.1")
def r5_3_1(t):
    g = t.guide.select("pkg_id", no_fragment(F.col("href")).alias("href")).where("href <> ''")
    return found(g.join(t.item.select("pkg_id", "href"), ["pkg_id", "href"], "left_anti"), "R5.3.1", "href")


@check("R5.4")
def r5_4(t):
    broken = t.spine_doc.where(F.col("text").rlike("""epub:type\\s*=\\s*["'][^"']*\\bpagebreak\\b""")).select("pkg_id").distinct()
    listed = t.nav_doc.where(F.col("text").rlike("""epub:type\\s*=\\s*["'][^"']*\\bpage-list\\b"""))
    return found(broken.join(listed, "pkg_id", "left_anti"), "R5.4")


@check("R5.5")
def r5_5(t):
    remote = t.link.join(t.nav_doc.select("pkg_id", "path"), ["pkg_id", "path"], "left_semi").where(F.col("url").rlike("(?i)^https?://"))
    ncx = t.ncx_node.where(F.col("attrs")["src"].rlike("(?i)^https?://"))
    return any_of(found(remote, "R5.5", "path", None, "url"), found(ncx, "R5.5", "file", "line", F.col("attrs")["src"]))


@check("R5.6")
def r5_6(t):
    nav = t.link.join(t.nav_doc.select("pkg_id", "path"), ["pkg_id", "path"], "left_semi").where("element = 'a'").withColumn("target", resolved("path", "url"))
    s = t.spine.select("pkg_id", F.col("path").alias("target"), F.col("ordinal").alias("place"))
    w = Window.partitionBy("pkg_id").orderBy("ord")
    bad = nav.join(s, ["pkg_id", "target"]).withColumn("before", F.lag("place").over(w)).where("before > place")
    return found(bad.groupBy("pkg_id").agg(F.min_by(F.struct("path", "url"), "ord").alias("x")).select("pkg_id", "x.*"), "R5.6", "path", None, "url")


@check("R5.7", "R5.8")
def ncx_uid(t):
    uid = t.ncx_node.where((F.col("element") == "meta") & (F.col("attrs")["name"] == "dtb:uid")).select("pkg_id", "file", "line", F.col("attrs")["content"].alias("uid"))
    own = t.nodes("identifier").select("pkg_id", F.col("attrs")["id"].alias("unique_id"), F.trim("text").alias("own")).join(t.pkg.select("pkg_id", "unique_id"), ["pkg_id", "unique_id"])
    return any_of(found(uid.join(own, "pkg_id").where(F.trim("uid") != F.col("own")), "R5.7", "file", "line", "uid"), found(uid.where(F.col("uid") != F.trim("uid")), "R5.8", "file", "line"))


@check("R5.9")
def r5_9(t):
    return found(t.ncx_node.where("element = 'text' and trim(text) = ''"), "R5.9", "file", "line")


@check("R5.10")
def r5_10(t):
    g = t.guide.select("pkg_id", no_fragment(F.col("href")).alias("href"))
    return found(g.join(t.item.select("pkg_id", "href", "media_type"), ["pkg_id", "href"]).where(~F.col("media_type").isin("application/xhtml+xml", "text/html", "text/x-oeb1-document", NCX_TYPE)), "R5.10", "href", None, "media_type")


@check("R5.11")
def r5_11(t):
    toc = t.nodes("spine").select("pkg_id", F.col("attrs")["toc"].alias("id")).where("id is not null")
    return found(toc.join(t.item_last, ["pkg_id", "id"], "left").where(F.col("media_type").isNull() | (F.col("media_type") != NCX_TYPE)), "R5.11", None, None, "id")


# --- content documents -------------------------------------------------------------------


@F.pandas_udf(BooleanType())
def _not_parsed(text: pd.Series) -> pd.Series:
    return text.map(xml_error)


@check("R6.1")
def r6_1(t):
    html5 = F.lower("text").rlike(r"<!doctype\s+html\s*>")
    return found(t.spine_doc.where(~html5).where(_not_parsed("text")), "R6.1", "path")


def on_lines(t, rule, condition: Column) -> DataFrame:
    return found(L.numbered_lines(t.spine_doc, ["pkg_id", "path"], "text").where(condition), rule, "path", "line")


@check("R6.2")
def r6_2(t):
    return on_lines(t, "R6.2", F.col("content").rlike(r"(?i)(margin|padding|line-height)[a-z-]*\s*:[^;\"'}]*-\d"))


@check("R6.3")
def r6_3(t):
    return on_lines(t, "R6.3", F.col("content").rlike(r"(?i)<script([\s>/]|$)"))


@check("R6.4")
def r6_4(t):
    return found(L.nested_paragraphs(t.spine_doc, ["pkg_id", "path"], "text").where("nested"), "R6.4", "path")


@check("R6.5")
def r6_5(t):
    f = t.files.select("pkg_id", F.col("path").alias("real"), F.lower("path").alias("low"))
    i = t.item.select("pkg_id", "path", F.lower("path").alias("low")).distinct()
    other = i.join(f, ["pkg_id", "low"]).where("path <> real")
    return found(other.join(t.files.select("pkg_id", "path"), ["pkg_id", "path"], "left_anti"), "R6.5", "path", None, "real")


def declaration(name: str) -> Column:
    return F.regexp_extract("text", rf"""(?s)^\s*﻿?\s*<\?xml[^?]*?\b{name}=["']([^"']*)["']""", 1)


@check("R6.6")
def r6_6(t):
    v = declaration("version")
    return found(t.doc.where((v != "") & (v != "1.0")), "R6.6", "path", None, v)


@check("R6.7")
def r6_7(t):
    external = F.col("text").rlike(r"(?is)<!entity[^>]*\s(system|public)")
    return any_of(found(t.doc.where(external), "R6.7", "path"), found(t.opf.where(external), "R6.7", "path"))


@check("R6.8")
def r6_8(t):
    body = F.trim(F.regexp_extract("text", r"(?is)<!doctype((?:[^>\[]|\[[^\]]*\])*)>", 1))
    known = (F.lower(body) == "html") | reduce(lambda a, b: a | b, [F.contains(F.lower(body), F.lit(x)) for x in DOCTYPE_FILES])
    return found(t.doc.where(F.col("text").rlike("(?i)<!doctype") & ~known), "R6.8", "path", None, body)


@check("R6.9")
def r6_9(t):
    uri = F.regexp_extract("text", """xmlns:epub=["']([^"']*)["']""", 1)
    return found(t.doc.where(F.col("text").rlike("""xmlns:epub=["']""") & (uri != RESERVED_PREFIXES["epub"])), "R6.9", "path", None, uri)


@check("R6.10")
def r6_10(t):
    return found(L.undeclared_entities(t.doc, ["pkg_id", "path"], "text"), "R6.10", "path", None, "name")


@check("R6.11")
def r6_11(t):
    first = F.hex(F.substring("content", 1, 2)).isin("FEFF", "FFFE")
    raw = t.content.where(F.col("media_type").isin("application/xhtml+xml", "text/html"))
    e = F.lower(declaration("encoding"))
    return any_of(found(raw.where(first), "R6.11", "path"), found(t.doc.join(raw.where(first), ["pkg_id", "path"], "left_anti").where((e != "") & (e != "utf-8")), "R6.11", "path", None, e))


@check("R6.12")
def r6_12(t):
    raw = t.content.where(F.lower("media_type") == "text/css")
    charset = F.lower(F.regexp_extract("text", """^﻿?@charset\\s+["']([^"']*)["']""", 1))
    return any_of(found(raw.where(F.hex(F.substring("content", 1, 2)).isin("FEFF", "FFFE")), "R6.12", "path"), found(t.css.where((charset != "") & (charset != "utf-8")), "R6.12", "path", None, charset))


@check("R10.3.1")
def r10_3_1(t):
    return on_lines(t, "R10.3.1", F.regexp_extract("content", r"(?i)<h[1-6]\b([^>]*)", 1).rlike("(?i)text-align"))


@check("R10.5.1")
def r10_5_1(t):
    tables = t.spine_doc.select("pkg_id", "path", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<table\b.*?(?:</table>|$)"), F.lit(0))).alias("table"))
    rows = F.size(F.regexp_extract_all("table", F.lit(r"(?i)<tr[\s>]"), F.lit(0)))
    return found(tables.where(rows > 50), "R10.5.1", "path", None, rows)


@check("R17.1")
def r17_1(t):
    return found(L.unsupported_tags(t.spine_doc, ["pkg_id", "path"], "text"), "R17.1", "path", "line", "tag")


# --- styles ------------------------------------------------------------------------------


def css_facts(t: Tables, pattern: str, group: int = 1) -> DataFrame:
    """pkg_id, path, value of each match outside comments."""
    plain = F.regexp_replace("text", r"(?s)/\*.*?\*/", "")
    return t.css.select("pkg_id", "path", F.explode(F.regexp_extract_all(plain, F.lit(pattern), F.lit(group))).alias("value"))


def css_missing(t, facts: DataFrame, rule: str) -> DataFrame:
    local = facts.where(~F.col("value").rlike("(?i)^([a-z][a-z0-9+.-]*:|//|#)") & (F.col("value") != "")).withColumn("low", F.lower(resolved("path", "value")))
    return found(local.join(t.item.select("pkg_id", F.lower("path").alias("low")), ["pkg_id", "low"], "left_anti"), rule, "path", None, "value")


@check("R6.13")
def r6_13(t):
    plain = F.regexp_replace("text", r"""(?s)/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", "")
    count = lambda c: F.length(plain) - F.length(F.replace(plain, F.lit(c), F.lit("")))
    return found(t.css.where(count("{") != count("}")), "R6.13", "path")


@check("R6.14")
def r6_14(t):
    return found(css_facts(t, r"(?i)[\s;{]position\s*:\s*(fixed|absolute|sticky)"), "R6.14", "path", None, "value")


@check("R6.15")
def r6_15(t):
    return css_missing(t, css_facts(t, r"""(?i)@import\s+(?:url\(\s*)?["']?([^"')\s;]+)"""), "R6.15")


@check("R6.16")
def r6_16(t):
    return css_missing(t, css_facts(t, r"""(?i)url\(\s*["']?([^"')]*?)["']?\s*\)"""), "R6.16")


@check("R6.17")
def r6_17(t):
    faces = css_facts(t, r"(?is)@font-face\s*\{([^}]*)\}")
    source = faces.where(F.col("value").rlike(r"(?i)\bsrc\s*:")).select("pkg_id", "path", F.explode(F.regexp_extract_all("value", F.lit(r"""(?i)url\(\s*["']?([^"')]*?)["']?\s*\)"""))).alias("value"))
    remote = source.where(F.col("value").rlike("(?i)^(https?:|//)"))
    return any_of(found(faces.where(~F.col("value").rlike(r"(?i)\bsrc\s*:")), "R6.17", "path"), found(remote, "R6.17", "path", None, "value"), css_missing(t, source, "R6.17"))


@check("R6.e1")
def r6_e1(t):
    return found(css_facts(t, r"(?i)(@namespace)\b"), "R6.e1", "path")


@check("R6.e2")
def r6_e2(t):
    prelude = css_facts(t, r"(?i)@media\b([^{;]*)")
    names = F.array_compact(F.array(*[F.when(F.col("value").rlike(rf"(?i)\(\s*{n}\b"), F.lit(n)) for n in MEDIA_FEATURES]))
    return found(prelude.select("pkg_id", "path", F.explode(names).alias("name")), "R6.e2", "path", None, "name")


# --- manifest and spine ------------------------------------------------------------------


@check("R7.1")
def r7_1(t):
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    real = t.files.where(~extension.isin(IGNORED_EXTENSIONS) & ~name.isin(IGNORED_NAMES) & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS)))).select("pkg_id", "path")
    return found(real.join(t.item.select("pkg_id", "path"), ["pkg_id", "path"], "left_anti").join(t.opf.select("pkg_id", "path"), ["pkg_id", "path"], "left_anti"), "R7.1", "path")


@check("R7.2", "R7.3")
def magic_types(t):
    head = F.lower(F.substring("content", 1, 2048).cast("string"))
    kind = F.coalesce(T.magic_kind(F.col("content")), F.when(head.rlike(r"<html[\s>]"), "xhtml"))
    allowed = {"image/jpeg": ["jpeg"], "image/jpg": ["jpeg"], "image/png": ["png"], "image/gif": ["gif"], "image/svg+xml": ["svg", "xhtml"], "application/xhtml+xml": ["xhtml", "svg"], "text/html": ["xhtml", "svg"]}
    fits = reduce(lambda c, kv: c.when(F.col("media_type") == kv[0], F.col("kind").isin(kv[1])), list(allowed.items())[1:], F.when(F.col("media_type") == "image/jpeg", F.col("kind").isin("jpeg")))
    fits = fits.when(F.col("media_type") == "text/css", ~F.col("kind").isin("jpeg", "png", "gif", "svg", "xhtml"))
    c = t.content.withColumn("kind", kind).withColumn("fits", fits).where("kind is not null")
    pictures = F.col("kind").isin("jpeg", "png", "gif")
    return any_of(found(c.where("not fits"), "R7.2", "path", None, "kind"), found(c.where(F.col("fits").isNull() & pictures), "R7.3", "path", None, "kind"))


@check("R7.4")
def r7_4(t):
    return found(t.itemref.groupBy("pkg_id").agg(F.bool_and(F.coalesce(F.lower("linear") == "no", F.lit(False))).alias("all_no")).where("all_no"), "R7.4")


@check("R7.5")
def r7_5(t):
    return found(t.itemref.groupBy("pkg_id", "idref").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "R7.5", None, None, "idref")


@check("R7.6")
def r7_6(t):
    return found(t.item.where((F.col("media_type") == "text/html") & F.lower("href").rlike(r"\.(xhtml|html|htm)$")), "R7.6", "href")


@check("R7.7")
def r7_7(t):
    return found(t.item.where(F.col("media_type").isin(list(DEPRECATED_TYPES))), "R7.7", "href", None, "media_type")


@check("R7.8", "R7.9")
def fallback_ids(t):
    ids = t.item.select("pkg_id", "id")
    lost = lambda c: t.item.where(F.col(c).isNotNull()).select("pkg_id", "href", F.col(c).alias("id")).join(ids, ["pkg_id", "id"], "left_anti")
    return any_of(found(lost("fallback"), "R7.8", "href", None, "id"), found(lost("fallback_style"), "R7.9", "href", None, "id"))


@check("R7.10")
def r7_10(t):
    return found(t.spine.where(~F.col("media_type").isin(CORE_TYPES) & F.col("fallback").isNull()), "R7.10", "href", None, "media_type")


@check("R7.11")
def r7_11(t):
    items = t.item_last.select("pkg_id", "id", F.col("fallback").alias("next"))
    walks = reaches(items, t.item_last.where(F.col("media_type").isin(CORE_TYPES)).select("pkg_id", "id"))
    other = t.spine.where(~F.col("media_type").isin(CORE_TYPES) & F.col("fallback").isNotNull()).select("pkg_id", F.col("idref").alias("id"), "href")
    return found(other.join(walks.where("not reaches"), ["pkg_id", "id"]), "R7.11", "href", None, "id")


@check("R7.12")
def r7_12(t):
    return found(t.item.groupBy("pkg_id", no_fragment(F.col("href")).alias("href")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "R7.12", "href", None, "n")


@check("R7.13")
def r7_13(t):
    own = t.opf.select("pkg_id", F.col("path").alias("opf"))
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    return found(t.item.join(own, "pkg_id").where((F.col("path") == F.col("opf")) | (name("path") == name("opf"))), "R7.13", "href")


# --- prefixes and properties -------------------------------------------------------------


def declared_prefixes(t: Tables) -> DataFrame:
    """pkg_id, k, name, uri of the prefix attribute's pairs."""
    parts = F.filter(F.split(F.trim("prefix"), r"\s+"), lambda x: x != "")
    rows = t.pkg.where("prefix is not null").select("pkg_id", parts.alias("p"))
    at = F.sequence(F.lit(0), F.floor((F.size("p") - 1) / 2).cast("int"))
    return rows.where("size(p) > 0").select("pkg_id", F.size("p").alias("n"), F.posexplode(F.transform(at, lambda k: F.struct(F.get("p", 2 * k).alias("name"), F.get("p", 2 * k + 1).alias("uri")))).alias("k", "x")).select("pkg_id", "n", "k", "x.*")


@check("R8.1", "R8.2", "R8.3", "R8.4")
def prefixes(t):
    d = declared_prefixes(t)
    name = F.regexp_replace("name", ":$", "")
    good = F.col("name").endswith(":") & name.rlike(T.NCNAME) & F.col("uri").isNotNull()
    uri = F.col("uri").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$")
    whole = d.where(good & uri).withColumn("prefix", name)
    again = whole.withColumn("r", F.row_number().over(Window.partitionBy("pkg_id", "prefix").orderBy("k")))
    canonical = F.create_map(*[F.lit(x) for kv in RESERVED_PREFIXES.items() for x in kv])
    return any_of(
        found(d.where(~good), "R8.1", None, None, "name"),
        found(again.where("r > 1"), "R8.2", None, None, "prefix"),
        found(again.where("r = 1").where(canonical[F.col("prefix")] != F.col("uri")), "R8.3", None, None, "prefix"),
        found(d.where(good & ~uri), "R8.4", None, None, "uri"),
    )


@check("R8.5", "R8.8", "R8.9", "R8.10")
def properties(t):
    p = t.item.select("pkg_id", "href", "media_type", F.explode("properties").alias("p")).where("p <> ''")
    shaped = F.col("p").rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*(:[A-Za-z_][A-Za-z0-9_.-]*)?$")
    prefix = F.regexp_extract("p", "^([^:]*):", 1)
    own = declared_prefixes(t).select("pkg_id", F.regexp_replace("name", ":$", "").alias("prefix")).distinct()
    prefixed = p.where(shaped & F.col("p").contains(":")).withColumn("prefix", prefix).where(~F.col("prefix").isin(list(RESERVED_PREFIXES)))
    kinds = reduce(lambda c, kv: c | ((F.col("p") == kv[0]) & ~F.col("media_type").isin(kv[1])), PROPERTY_TYPES.items(), F.lit(False))
    return any_of(
        found(p.where(kinds), "R8.5", "href", None, "p"),
        found(p.where(~shaped), "R8.8", "href", None, "p"),
        found(p.where(shaped & ~F.col("p").contains(":") & ~F.col("p").isin(KNOWN_PROPERTIES)), "R8.9", "href", None, "p"),
        found(prefixed.join(own, ["pkg_id", "prefix"], "left_anti"), "R8.10", "href", None, "p"),
    )


@check("R8.6", "R8.7")
def features(t):
    three = t.pkg.where(F.col("version").startswith("3")).select("pkg_id")
    low = F.lower("text")
    used = F.array_compact(F.array(
        F.when(low.rlike(r"<(m:)?math[\s>]"), F.lit("mathml")), F.when(low.rlike(r"<script[\s>]|\son[a-z]+\s*="), F.lit("scripted")),
        F.when(low.rlike(r"<(svg:)?svg[\s>]"), F.lit("svg")), F.when(low.rlike(r"""<(img|audio|video|source|iframe|script|link)\b[^>]*\s(src|href)\s*=\s*["']https?://"""), F.lit("remote-resources")),
    ))
    docs = t.doc.where("media_type = 'application/xhtml+xml'").join(three, "pkg_id", "left_semi")
    real = docs.select("pkg_id", "path", F.explode(used).alias("p")).distinct()
    said = t.item.select("pkg_id", "path", F.explode("properties").alias("p")).where(F.col("p").isin("mathml", "scripted", "svg", "remote-resources")).distinct().join(docs.select("pkg_id", "path"), ["pkg_id", "path"], "left_semi")
    keys = ["pkg_id", "path", "p"]
    return any_of(found(real.join(said, keys, "left_anti"), "R8.6", "path", None, "p"), found(said.join(real, keys, "left_anti"), "R8.7", "path", None, "p"))


# --- links -------------------------------------------------------------------------------


@check(*[f"R9.{k}" for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)])
def links(t):
    """The classes are tested in turn; malformed, data and file links end the tests, and a link whose path,
    from its document's folder on, leaves the package is tested for its query alone."""
    x = t.link.where((F.col("attr") == "src") | F.col("element").isin("a", "link", "image", "use", "area")).withColumn("class", T.url_class(F.col("url")))
    x = x.withColumn("parts", T.split_url(F.col("url"))).withColumn("fragment", F.col("parts.fragment"))
    relative = F.col("class").isin("internal", "internal_query", "escapes")
    x = x.withColumn("target", F.when(F.col("class") == "same_document", F.col("path")).when(relative & (F.col("parts.path") != ""), resolved("path", "url")))
    outside = F.col("target").rlike(r"^\.\.(/|$)")
    local = x.where(F.col("target").isNotNull() & ~outside)
    items = t.item.groupBy("pkg_id", F.col("path").alias("target")).agg(F.first("media_type").alias("type"))
    aimed = local.join(items, ["pkg_id", "target"])
    xhtml = F.col("type").isin("application/xhtml+xml", "text/html")
    hyper = aimed.where("element = 'a' and attr = 'href'")
    asked = aimed.where("fragment is not null and fragment <> ''")
    svg = F.lower(F.substring_index("url", "#", 1)).rlike(r"\.svgz?$")
    return any_of(
        found(x.where((F.col("element") == "img") & (F.col("attr") == "src") & F.col("url").contains("#") & ~svg), "R9.1", "path", None, "url"),
        found(hyper.where(xhtml).join(t.spine.select("pkg_id", F.col("path").alias("target")), ["pkg_id", "target"], "left_anti"), "R9.2", "path", None, "url"),
        found(asked.where(xhtml).join(t.anchor.select("pkg_id", F.col("path").alias("target"), F.col("id").alias("fragment")), ["pkg_id", "target", "fragment"], "left_anti"), "R9.3", "path", None, "url"),
        found(asked.where(~xhtml & (F.col("type") != "image/svg+xml")), "R9.4", "path", None, "url"),
        found(x.where((F.col("element") == "use") & ~F.col("url").contains("#")), "R9.5", "path", None, "url"),
        found(x.where(F.col("class") == "malformed"), "R9.6", "path", None, "url"),
        found(x.where(relative & outside), "R9.7", "path", None, "url"),
        found(x.where(F.col("class") == "data"), "R9.8", "path"),
        found(x.where(F.col("class") == "file"), "R9.9", "path", None, "url"),
        found(x.where(relative & F.col("parts.query").isNotNull()), "R9.10", "path", None, "url"),
    )


@check("R9.11")
def r9_11(t):
    return found(t.item.where(F.col("href").contains("#")), "R9.11", "href")


@check("R9.12")
def r9_12(t):
    return found(t.item.where(F.col("href").startswith("#")), "R9.12", "href")


# --- fixed layout ------------------------------------------------------------------------


def viewport(t) -> DataFrame:
    meta = F.regexp_extract("text", r"""(?is)<meta\b(?=[^>]*\bname\s*=\s*["']viewport["'])[^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1)
    has = F.col("text").rlike(r"""(?is)<meta\b[^>]*\bname\s*=\s*["']viewport["']""")
    return t.spine_doc.withColumn("has", has).withColumn("viewport", meta)


@check("R11.1")
def r11_1(t):
    many = viewport(t).groupBy("pkg_id").agg(F.bool_or("has").alias("any")).where("any")
    return found(t.pkg.where("not is_fixed").join(many, "pkg_id", "left_semi"), "R11.1")


@check("R11.2", "R11.7")
def r11_2(t):
    pre = t.nodes("meta").where((F.col("attrs")["property"] == "rendition:layout") & (F.trim("text") == "pre-paginated")).select("pkg_id")
    three = t.pkg.where(F.col("version").startswith("3")).select("pkg_id")
    without = viewport(t).where("not has").join(pre, "pkg_id", "left_semi").join(three, "pkg_id", "left_semi")
    return any_of(found(without, "R11.2", "path"), found(without, "R11.7", "path"))


@check("R11.3")
def r11_3(t):
    v = F.lower("viewport")
    return found(viewport(t).where(F.col("has") & ~(v.rlike(r"width\s*=") & v.rlike(r"height\s*="))), "R11.3", "path")


@check("R11.4", "R11.5", "R11.6")
def renditions(t):
    m = t.nodes("meta").select("pkg_id", F.col("attrs")["property"].alias("p"), F.trim("text").alias("v"))
    bad = lambda p, ok, rule: found(m.where((F.col("p") == f"rendition:{p}") & ~F.col("v").isin(ok)), rule, None, None, "v")
    return any_of(bad("spread", SPREADS, "R11.4"), bad("orientation", ORIENTATIONS, "R11.5"), bad("layout", LAYOUTS, "R11.6"))


@check("R11.8")
def r11_8(t):
    return found(t.spine_doc.where(~F.col("text").rlike(r"(?i)<(img|image|svg)[\s>/]|<\w+:(image|svg)[\s>/]")), "R11.8", "path")


@check("R11.9")
def r11_9(t):
    return found(t.pkg.where("is_fixed and original_resolution is null"), "R11.9")


# --- file names --------------------------------------------------------------------------


@check("R13.1", "R13.2", "R13.3", "R13.4", "R13.5")
def filenames(t):
    i = t.item.where("href is not null")
    name = F.element_at(F.split("href", "/"), -1)
    low = i.select("pkg_id", "href", F.lower("href").alias("low")).groupBy("pkg_id", "low").agg(F.min("href").alias("a"), F.max("href").alias("b")).where("a <> b")
    return any_of(
        found(i.where(name.rlike(r"""[<>:"\\|?*\x00-\x1F]""")), "R13.1", "href"),
        found(i.where(name.contains(" ")), "R13.2", "href"),
        found(i.where(name.endswith(".")), "R13.3", "href"),
        found(i.where(F.col("href").rlike(r"[^\x00-\x7E]")), "R13.4", "href"),
        found(low, "R13.5", "a", None, "b"),
    )


# --- dictionaries ------------------------------------------------------------------------


@check("R15.1", "R15.2")
def dictionary_languages(t):
    bad = lambda c, rule: found(t.pkg.where(F.coalesce(F.col(c), F.lit("")) == "").unionByName(t.pkg.where(~F.col(c).rlike(T.BCP47_DICTIONARY) & (F.col(c) != ""))), rule, None, None, c)
    return any_of(bad("dict_in", "R15.1"), bad("dict_out", "R15.2"))


@check("R15.3")
def r15_3(t):
    names = t.spine_doc.select("pkg_id", F.explode(F.regexp_extract_all("text", F.lit(r"""(?i)<idx:entry\b[^>]*?\bname\s*=\s*["']([^"']*)["']"""))).alias("name")).distinct()
    some = t.pkg.join(names.select("pkg_id").distinct(), "pkg_id", "left_semi").select("pkg_id", F.coalesce("default_index", F.lit("default")).alias("name"))
    return found(some.join(names, ["pkg_id", "name"], "left_anti"), "R15.3", None, None, "name")


@check("R15.4")
def r15_4(t):
    some = t.spine_doc.where(F.lower("text").contains("<idx:entry")).select("pkg_id")
    return found(t.pkg.join(some, "pkg_id", "left_anti"), "R15.4")


@check("R15.5")
def r15_5(t):
    low = F.lower("text")
    return found(t.spine_doc.where(low.contains("<idx:entry") & ~low.contains("<mbp:frameset")), "R15.5", "path")


@check("R15.6")
def r15_6(t):
    at = F.regexp_extract_all("text", F.lit(r"(?is)<idx:orth\b[^>]*/>|<idx:orth\b[^>]*>.*?</idx:orth>"), F.lit(0))
    orth = t.spine_doc.select("pkg_id", "path", F.explode(at).alias("orth"))
    empty = (F.regexp_extract("orth", r"""(?is)^<idx:orth\b[^>]*\bvalue\s*=\s*["']([^"']*)""", 1) == "") & (F.trim(F.regexp_replace("orth", "<[^>]*>", "")) == "")
    return found(orth.where(empty), "R15.6", "path", None, "orth")


@check("R15.7")
def r15_7(t):
    return found(t.pkg.join(t.guide.where("type = 'index'"), "pkg_id", "left_anti"), "R15.7")


@check("R15.e1", "R15.e2")
def dictionary_types(t):
    marked = t.spine_doc.where(F.col("text").rlike("""epub:type\\s*=\\s*["'][^"']*\\bdictionary\\b""")).select("pkg_id").distinct()
    typed = t.nodes("type").where(F.lower(F.trim("text")) == "dictionary").select("pkg_id").distinct()
    three = t.pkg.where(F.col("version").startswith("3"))
    content = three.where("dict_in <> '' or has_entries").select("pkg_id").unionByName(three.join(marked, "pkg_id", "left_semi").select("pkg_id")).distinct()
    return any_of(found(three.join(marked, "pkg_id", "left_anti"), "R15.e1"), found(content.join(typed, "pkg_id", "left_anti"), "R15.e2"))


@check("R15.e3", "R15.e4", "R15.e5", "R15.e6", "R15.e7")
def collections(t):
    """Links of dictionary collections: a missing target ends the tests of a link."""
    own = t.nodes("collection").where(F.col("attrs")["role"] == "dictionary").select("pkg_id", F.col("ord").alias("c"))
    n = t.node.where("element in ('link', 'collection')").select("pkg_id", "ord", "element", F.col("attrs")["href"].alias("href"))
    w = Window.partitionBy("pkg_id").orderBy("ord")
    l = n.withColumn("c", F.last(F.when(F.col("element") == "collection", F.col("ord")), True).over(w)).where("element = 'link'").join(own, ["pkg_id", "c"])  # noqa: E741
    known = l.join(t.item.groupBy("pkg_id", "href").agg(F.first("media_type").alias("type")), ["pkg_id", "href"], "left")
    skm = F.col("type") == "application/vnd.epub.search-key-map+xml"
    there = known.where("type is not null")
    per = own.join(there.where(skm).groupBy("pkg_id", "c").agg(F.count(F.lit(1)).alias("n")), ["pkg_id", "c"], "left")
    return any_of(
        found(there.where(skm & ~F.lower("href").endswith(".xml")), "R15.e3", "href"),
        found(known.where("type is null"), "R15.e4", "href"),
        found(per.where("n > 1"), "R15.e5", None, None, "n"),
        found(per.where("n is null"), "R15.e6"),
        found(there.where(~skm & (F.col("type") != "application/xhtml+xml")), "R15.e7", "href", None, "type"),
    )


# --- metadata ----------------------------------------------------------------------------


@check("R16.1", "R16.2")
def identifiers(t):
    ids = t.nodes("identifier").select("pkg_id", F.col("attrs")["id"].alias("unique_id"))
    return any_of(found(t.pkg.where("unique_id is not null").join(ids, ["pkg_id", "unique_id"], "left_anti"), "R16.1", "path", None, "unique_id"), found(t.pkg.where("unique_id is null"), "R16.2", "path"))


@check("R16.3", "R16.4")
def dates(t):
    d = t.nodes("date").select("pkg_id", "file", "line", F.trim("text").alias("v")).where("v <> ''").withColumn("kind", T.w3cdtf_kind(F.col("v")))
    return any_of(found(d.where("kind = 'bad_syntax'"), "R16.3", "file", "line", "v"), found(d.where("kind = 'bad_value'"), "R16.4", "file", "line", "v"))


@check("R16.5")
def r16_5(t):
    dc = ["title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "identifier", "source", "language", "relation", "coverage", "rights"]
    return found(t.node.where(F.col("element").isin(dc) & F.col("parent").isin("metadata", "dc-metadata") & (F.trim("text") == "")), "R16.5", "file", "line", "element")


@check("R16.6")
def r16_6(t):
    a = F.col("attrs")
    return found(t.node.where(((F.col("element") == "meta") | (F.col("parent") == "x-metadata")) & (F.trim("text") == "") & a["content"].isNull() & a["href"].isNull() & F.col("parent").isin("metadata", "x-metadata")), "R16.6", "file", "line", "element")


@check("R16.7")
def r16_7(t):
    x = t.nodes("identifier").where(F.upper(F.col("attrs")["scheme"]) == "UUID").withColumn("v", F.regexp_replace(F.trim("text"), "^urn:uuid:", ""))
    return found(x.where(~F.col("v").rlike(T.UUID)), "R16.7", "file", "line", "v")


@check("R16.8")
def r16_8(t):
    x = t.nodes("language").withColumn("v", F.trim("text")).where("v <> ''")
    return found(x.where(~F.col("v").rlike(T.BCP47_METADATA)), "R16.8", "file", "line", "v")


def validate(t: Tables, rules: list[str] | None = None) -> DataFrame:
    """All findings of all packages, with levels, for the rules of each package's profile."""
    wanted = list(CHECKS) if rules is None else rules
    every = any_of(*[f(t) for f in dict.fromkeys(_BUILT_BY[r] for r in wanted)])
    return judged(every if rules is None else every.where(F.col("rule_id").isin(wanted)), t.pkg)
