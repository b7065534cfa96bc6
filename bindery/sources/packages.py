"""Publications as tables: package documents, content documents, links, ids, styles, navigation.

Input everywhere: files(pkg_id, path, content BINARY), path relative to the package's root.
Many packages are read at once; every table carries pkg_id."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from dataclasses import dataclass
from functools import cached_property
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_path, percent_decode
from .staging import staged

NODE = "pkg_id string, file string, ord int, element string, parent string, text string, attrs map<string,string>, line int, depth int"


def read_folders(spark: SparkSession, root: str) -> DataFrame:
    """root/<pkg_id>/... as files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace("\\", "/").split("/")[-1] + "/", "")
    cut = F.split(inside, "/", 2)
    return raw.select(cut[0].alias("pkg_id"), cut[1].alias("path"), "content")


def _unzip(frames):
    for pdf in frames:
        for name, content in zip(pdf["path"], pdf["content"]):
            try:
                z = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                continue
            rows = [(name, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["pkg_id", "path", "content"])


def read_epubs(spark: SparkSession, glob: str) -> DataFrame:
    """Zip containers as files; a file that is no zip gives none."""
    raw = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    return raw.mapInPandas(_unzip, "pkg_id string, path string, content binary")


def scan_xml(text: str) -> list[tuple]:
    """(ord, local element, parent, text, attributes, line, depth) up to the first error, which ends the scan."""
    local = lambda n: n.rsplit(":", 1)[-1].lower()
    out, stack = [], []
    p = expat.ParserCreate()
    p.UseForeignDTD(True)

    def start(name, attrs):
        out.append([len(out), local(name), local(stack[-1][0]) if stack else None, "", {local(k): v for k, v in attrs.items()}, p.CurrentLineNumber, len(stack)])
        stack.append((name, len(out) - 1))

    def data(s):
        if stack:
            out[stack[-1][1]][3] += s

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda _: stack.pop(), data
    try:
        p.Parse(text.lstrip("﻿ \n\r\t"), True)
    except expat.ExpatError:
        pass
    return [tuple(x) for x in out]


def xml_error(text: str) -> bool:
    p = expat.ParserCreate()
    p.UseForeignDTD(True)
    try:
        p.Parse(text.lstrip("﻿"), True)
    except expat.ExpatError:
        return True
    return False


def _nodes(frames):
    for pdf in frames:
        rows = [(pkg, path, *n) for pkg, path, text in zip(pdf["pkg_id"], pdf["path"], pdf["text"]) if text is not None for n in scan_xml(text)]
        yield pd.DataFrame(rows, columns=["pkg_id", "file", "ord", "element", "parent", "text", "attrs", "line", "depth"])


# Image types by extension.
IMAGE_EXTENSIONS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp"}
NAV_POINT = "pkg_id string, ord int, depth int, label string, file_href string, fragment string"


class _NavReader(HTMLParser):
    """Links of the navigation lists: (depth, label, href). A list marked as contents takes the place of
    unmarked ones; of several marked ones the first counts. Depth is that of the lists in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.points, self.marked, self.inside, self.navs, self.lists, self.link = [], False, False, 0, 0, None

    def handle_starttag(self, tag, attrs):
        tag, given = tag.rsplit(":", 1)[-1], {k: v or "" for k, v in attrs}
        if tag == "nav":
            types = " ".join(v for k, v in given.items() if k.endswith("type")).lower().split()
            contents = "toc" in types or "doc-toc" in given.get("role", "").lower().split()
            if not self.navs and (not self.marked):
                self.inside, self.lists = True, 0
                if contents:
                    self.marked, self.points = True, []
            self.navs += 1
        elif self.inside and tag == "ol":
            self.lists += 1
        elif self.inside and tag == "a" and self.link is None:
            href = given.get("href", "")
            if href and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", href):
                self.link = (max(0, self.lists - 1), [], href)

    def handle_data(self, data):
        if self.link is not None:
            self.link[1].append(data)

    def handle_endtag(self, tag):
        tag = tag.rsplit(":", 1)[-1]
        if tag == "a" and self.link is not None:
            depth, label, href = self.link
            if label := " ".join("".join(label).split()):
                self.points.append((depth, label, href))
            self.link = None
        elif tag == "ol" and self.inside:
            self.lists = max(0, self.lists - 1)
        elif tag == "nav" and self.navs:
            self.navs -= 1
            self.inside = self.inside and self.navs > 0


def nav_points(text: str, path: str) -> list[tuple[int, str, str, str | None]]:
    """depth, label, file and fragment of the points of a navigation document; links to itself name it."""
    reader, out = _NavReader(), []
    reader.feed(text)
    for depth, label, href in reader.points:
        name, mark, fragment = href.partition("#")
        folder = path.rpartition("/")[0]
        target = posixpath.normpath(posixpath.join(folder, unquote(name.partition("?")[0]))) if name else path
        out.append((depth, label, target, fragment if mark else None))
    return out


def _nav_points(frames):
    for pdf in frames:
        rows = [(pkg, k, *p) for pkg, path, text in zip(pdf["pkg_id"], pdf["path"], pdf["text"]) if text is not None for k, p in enumerate(nav_points(text, path))]
        yield pd.DataFrame(rows, columns=["pkg_id", "ord", "depth", "label", "file_href", "fragment"])


@dataclass
class Tables:
    """The logical tables of files; each is declared once and shared by the rules."""

    files: DataFrame
    #: Whether the parsed tables are written, so that each is parsed once for all the rules.
    keep: bool = True

    def _base(self, name: str, df: DataFrame) -> DataFrame:
        return staged(df, name) if self.keep else df

    @cached_property
    def opf(self) -> DataFrame:
        """pkg_id, path, dir, text of each package document: the container's root file, else the first .opf."""
        root = F.regexp_extract(F.col("content").cast("string"), 'full-path="([^"]+)"', 1)
        named = self.files.where(F.lower("path") == "meta-inf/container.xml").select("pkg_id", root.alias("root"))
        opfs = self.files.where(F.lower("path").endswith(".opf")).join(named, "pkg_id", "left")
        best = opfs.groupBy("pkg_id").agg(F.min(F.struct((F.coalesce(F.col("path") != F.col("root"), F.lit(True))).alias("other"), "path", "content")).alias("b"))
        return self._base("opf", best.select("pkg_id", F.col("b.path").alias("path"), F.regexp_replace(F.col("b.path"), "[^/]*$", "").alias("dir"), F.make_valid_utf8(F.col("b.content").cast("string")).alias("text")))

    @cached_property
    def node(self) -> DataFrame:
        return self._base("node", self.opf.select("pkg_id", "path", "text").mapInPandas(_nodes, NODE))

    def nodes(self, element: str, parent: str | None = None) -> DataFrame:
        x = self.node.where(F.col("element") == element)
        return x.where(F.col("parent") == parent) if parent else x

    @cached_property
    def pkg(self) -> DataFrame:
        """One row for each package: its attributes, languages and profile flags."""
        a = self.nodes("package").groupBy("pkg_id").agg(F.first(F.col("attrs")["version"]).alias("version"), F.first(F.col("attrs")["unique-identifier"]).alias("unique_id"), F.first(F.col("attrs")["prefix"]).alias("prefix"))
        inner = self.node.where(F.col("element").isin("dictionaryinlanguage", "dictionaryoutlanguage", "defaultlookupindex", "language", "type", "title"))
        m = inner.groupBy("pkg_id").pivot("element", ["dictionaryinlanguage", "dictionaryoutlanguage", "defaultlookupindex", "language", "type", "title"]).agg(F.min(F.struct("ord", F.trim("text").alias("t"))))
        m = m.select("pkg_id", *[F.col(f"{k}.t").alias(v) for k, v in (("dictionaryinlanguage", "dict_in"), ("dictionaryoutlanguage", "dict_out"), ("defaultlookupindex", "default_index"), ("language", "language"), ("title", "title"))])
        fixed = self.nodes("meta").groupBy("pkg_id").agg(
            F.max(((F.col("attrs")["property"] == "rendition:layout") & (F.trim("text") == "pre-paginated")) | ((F.lower(F.col("attrs")["name"]) == "fixed-layout") & (F.lower(F.col("attrs")["content"]) == "true"))).alias("is_fixed"),
            F.max(F.when(F.lower(F.col("attrs")["name"]) == "original-resolution", F.col("attrs")["content"])).alias("original_resolution"),
        )
        sized = F.lower("text").rlike(r"""<meta\b(?=[^>]*\sname\s*=\s*"viewport")(?=[^>]*width=)(?=[^>]*height=)""")
        marked = self.spine_doc.groupBy("pkg_id").agg(F.max(F.contains("text", F.lit("<idx:entry"))).alias("has_entries"), F.max(sized).alias("has_viewport"))
        out = self.opf.select("pkg_id", "path", "dir").join(a, "pkg_id", "left").join(m, "pkg_id", "left").join(fixed, "pkg_id", "left").join(marked, "pkg_id", "left")
        dictionary = F.coalesce(F.col("dict_in") != "", F.lit(False)) | F.coalesce("has_entries", F.lit(False))
        fixed_col = F.coalesce("is_fixed", F.lit(False))
        return self._base("pkg", out.withColumn("is_fixed", fixed_col).withColumn("is_dictionary", dictionary).withColumn("profile", F.when(dictionary, 4).when(fixed_col | F.coalesce("has_viewport", F.lit(False)), 2).otherwise(1)))

    @cached_property
    def item(self) -> DataFrame:
        a = F.col("attrs")
        rows = self.nodes("item", "manifest").select("pkg_id", F.col("ord").alias("ordinal"), a["id"].alias("id"), a["href"].alias("href"), a["media-type"].alias("media_type"), F.split(F.trim(F.coalesce(a["properties"], F.lit(""))), r"\s+").alias("properties"), a["fallback"].alias("fallback"), a["fallback-style"].alias("fallback_style"))
        path = normalize_path(F.concat("dir", percent_decode(F.regexp_replace("href", "#.*$", ""))))
        return self._base("item", rows.join(self.opf.select("pkg_id", "dir"), "pkg_id").withColumn("path", path).drop("dir"))

    @cached_property
    def item_last(self) -> DataFrame:
        """Of items with one id the last counts."""
        return self.item.groupBy("pkg_id", "id").agg(F.max_by(F.struct("ordinal", "href", "media_type", "path", "fallback"), "ordinal").alias("i")).select("pkg_id", "id", "i.*")

    @cached_property
    def itemref(self) -> DataFrame:
        a = F.col("attrs")
        return self.nodes("itemref", "spine").select("pkg_id", F.col("ord").alias("ordinal"), a["idref"].alias("idref"), a["linear"].alias("linear"), a["properties"].alias("properties"))

    @cached_property
    def spine(self) -> DataFrame:
        i = self.item_last.select("pkg_id", F.col("id").alias("idref"), "href", "media_type", "path", "fallback")
        return self._base("spine", self.itemref.join(i, ["pkg_id", "idref"]))

    @cached_property
    def guide(self) -> DataFrame:
        a = F.col("attrs")
        return self.nodes("reference", "guide").select("pkg_id", "ord", a["type"].alias("type"), a["href"].alias("href"))

    @cached_property
    def content(self) -> DataFrame:
        """Files that items name, with their types: each file once."""
        i = self.item.where("path is not null").groupBy("pkg_id", "path").agg(F.max_by("media_type", "ordinal").alias("media_type"), F.max_by("href", "ordinal").alias("href"))
        return self.files.join(i, ["pkg_id", "path"])

    @cached_property
    def doc(self) -> DataFrame:
        html = F.col("media_type").isin("application/xhtml+xml", "text/html", "text/x-oeb1-document", "application/x-dtbook+xml")
        return self._base("doc", self.content.where(html).select("pkg_id", "path", "href", "media_type", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))

    @cached_property
    def spine_doc(self) -> DataFrame:
        return self.doc.join(self.spine.select("pkg_id", "path", F.col("ordinal").alias("spine_ord"), "idref").dropDuplicates(["pkg_id", "path"]), ["pkg_id", "path"])

    @cached_property
    def css(self) -> DataFrame:
        return self.content.where(F.lower("media_type") == "text/css").select("pkg_id", "path", "href", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    @cached_property
    def link(self) -> DataFrame:
        """Attributes of tags that link: element, attr, url; quoted either way."""
        tag = r"(?s)<([A-Za-z][\w:.-]*)((?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'))?)*)\s*/?>"
        tags = self.doc.select("pkg_id", "path", F.posexplode(F.regexp_extract_all("text", F.lit(tag), F.lit(0))).alias("ord", "tag"))
        element = F.lower(F.regexp_extract("tag", r"^<([\w:.-]+)", 1))
        pairs = F.regexp_extract_all("tag", F.lit(r"\s(?:xlink:)?(href|src)\s*=\s*(?:\"[^\"]*\"|'[^']*')"), F.lit(0))
        rows = tags.select("pkg_id", "path", "ord", element.alias("element"), F.explode(pairs).alias("pair"))
        return self._base("link", rows.select("pkg_id", "path", "ord", "element", F.lower(F.regexp_extract("pair", r"(href|src)", 1)).alias("attr"), F.regexp_extract("pair", r"""=\s*["'](.*)["']$""", 1).alias("url")))

    @cached_property
    def anchor(self) -> DataFrame:
        ids = F.regexp_extract_all("text", F.lit(r"""\s(?:xml:)?id\s*=\s*["']([^"']*)["']"""))
        return self._base("anchor", self.doc.select("pkg_id", "path", F.explode(ids).alias("id")).distinct())

    @cached_property
    def image(self) -> DataFrame:
        return self.content.where(F.col("media_type").startswith("image/")).select("pkg_id", "path", "href", "media_type", "content", F.octet_length("content").alias("bytes"))

    @cached_property
    def ncx(self) -> DataFrame:
        return self.content.where("media_type = 'application/x-dtbncx+xml'").select("pkg_id", "path", "href", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    @cached_property
    def ncx_node(self) -> DataFrame:
        return self._base("ncx_node", self.ncx.select("pkg_id", "path", "text").mapInPandas(_nodes, NODE))

    @cached_property
    def nav_doc(self) -> DataFrame:
        nav = self.item.where(F.array_contains("properties", "nav")).select("pkg_id", "path").distinct()
        return self.doc.join(nav, ["pkg_id", "path"], "left_semi")

    @cached_property
    def nav_point(self) -> DataFrame:
        """pkg_id, ord, depth, label, href of the NCX's points, in document order."""
        n = self.ncx_node.where(F.col("element").isin("navpoint", "text", "content"))
        own = F.last(F.when(F.col("element") == "navpoint", F.struct("ord", "depth", "line")), ignorenulls=True).over(Window.partitionBy("pkg_id", "file").orderBy("ord"))
        at = lambda element: F.when(F.col("element") == element, F.col("ord"))
        points = n.withColumn("own", own).where("own is not null").groupBy("pkg_id", "file", "own")
        parts = points.agg(F.min_by("text", at("text")).alias("label"), F.min_by(F.col("attrs")["src"], at("content")).alias("href"), F.count(at("text")).alias("texts"), F.count(at("content")).alias("contents"))
        return parts.where("texts > 0 and contents > 0").select("pkg_id", "own.ord", (F.col("own.depth") - 2).alias("depth"), "own.line", "label", "href")

    @cached_property
    def nav_xhtml_point(self) -> DataFrame:
        """pkg_id, ord, depth, label, file_href, fragment of the points of navigation documents."""
        return self.nav_doc.select("pkg_id", "path", "text").mapInPandas(_nav_points, NAV_POINT)

    @cached_property
    def toc_point(self) -> DataFrame:
        """The points of a package's navigation document, or of its NCX where that has none."""
        x = self.nav_xhtml_point
        own = self.ncx.select("pkg_id", F.regexp_replace("path", "[^/]*$", "").alias("folder")).dropDuplicates(["pkg_id"])
        path = normalize_path(F.concat("folder", percent_decode(F.substring_index("href", "#", 1))))
        fragment = F.when(F.col("href").contains("#"), F.substring_index("href", "#", -1))
        n = self.nav_point.join(own, "pkg_id").select("pkg_id", F.col("ord").cast("int").alias("ord"), F.col("depth").cast("int").alias("depth"), "label", path.alias("file_href"), fragment.alias("fragment"))
        return x.unionByName(n.join(x.select("pkg_id").distinct(), "pkg_id", "left_anti"))

    @cached_property
    def undeclared_image(self) -> DataFrame:
        """pkg_id, path, media_type: image files that spine documents show and no item names."""
        shown = self.link.where("element = 'img' and attr = 'src' and url <> ''").where(~F.col("url").rlike("^(#|data:)|://"))
        shown = shown.join(self.spine.select("pkg_id", "path").distinct(), ["pkg_id", "path"], "left_semi")
        target = normalize_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), percent_decode(F.substring_index("url", "#", 1))), keep_escapes=True)
        paths = shown.select("pkg_id", target.alias("path")).distinct()
        there = paths.join(self.files.select("pkg_id", "path"), ["pkg_id", "path"], "left_semi").join(self.item.select("pkg_id", "path"), ["pkg_id", "path"], "left_anti")
        extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        kind = F.create_map(*[F.lit(x) for pair in IMAGE_EXTENSIONS.items() for x in pair])
        return there.withColumn("media_type", F.try_element_at(kind, extension)).where("media_type is not null")

    @cached_property
    def entry(self) -> DataFrame:
        """Dictionary entries: headword from the value, else from the text; entries without one are left out."""
        from ..functions.text import unescape_named

        block = r"(?s)<idx:entry\b.*?</idx:entry>"
        rows = self.doc.select("pkg_id", "path", F.posexplode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("k", "html"))
        value = F.regexp_extract("html", r"""(?s)<idx:orth\b[^>]*?\bvalue\s*=\s*["']([^"']*)["']""", 1)
        body = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<idx:orth\b[^>]*>(.*?)</idx:orth>", 1), "<[^>]*>", ""))
        head = F.trim(unescape_named(F.coalesce(F.nullif(value, F.lit("")), F.nullif(body, F.lit("")))))
        forms = F.transform(F.regexp_extract_all("html", F.lit(r"""(?s)<idx:iform\b[^>]*?\bvalue\s*=\s*["']([^"']*)["']""")), lambda x: F.trim(unescape_named(x)))
        return rows.select("pkg_id", "path", "k", head.alias("headword"), F.filter(forms, lambda x: x != "").alias("inflections"), "html").where("headword is not null and headword <> ''")


def read(files: DataFrame) -> Tables:
    return Tables(files)
