"""Dictionaries as EPUB 3 packages: anchors, entries as documents, links between them, the search key map.

Entries become rows of documents first; a document's entries meet in its own group, and only a
package's short lists (its documents) meet in one row. What a package holds is files, for
sources.writers.epubs to zip."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.markup import Piece, pieces
from ..functions.text import xml_escape
from .terms import search_forms

# The elements that hold nothing, the name spaces, and the date that rebuilt packages keep.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
XHTML, OPS = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops"
DC, OPF = "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/opf"
MODIFIED = "2000-01-01T00:00:00Z"
DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>\n'


# --- anchors -------------------------------------------------------------------------------


def anchor_base(headword: str) -> str:
    """hw_ and the word; a character that no name may hold is an underscore and its code point."""
    return "hw_" + "".join(c if c.isalnum() or c in "-_." else f"_{ord(c):x}" for c in headword)


@pandas_udf(StringType())
def _bases(words: pd.Series) -> pd.Series:
    return words.map(anchor_base, na_action="ignore")


def _numbered(pdf: pd.DataFrame) -> pd.DataFrame:
    seen, out = set(), []
    pdf = pdf.sort_values("entry_ord", kind="stable")
    for base in pdf["base"]:
        name, n = base, 2
        while name in seen:
            name, n = f"{base}_{n}", n + 1
        seen.add(name)
        out.append(name)
    return pdf.assign(anchor=out)[["pkg_id", "entry_ord", "anchor"]]


def anchors(entries: DataFrame) -> DataFrame:
    """pkg_id, entry_ord, headword -> pkg_id, entry_ord, anchor: unique in a package, the first with its plain name.

    Only names that differ by numbers at their end can meet, so these are the groups."""
    kind = entries.schema["entry_ord"].dataType.simpleString()
    based = entries.select("pkg_id", "entry_ord", _bases("headword").alias("base")).withColumn("stem", F.regexp_replace("base", r"(_\d+)+$", ""))
    return based.groupBy("pkg_id", "stem").applyInPandas(_numbered, f"pkg_id string, entry_ord {kind}, anchor string")


# --- bodies --------------------------------------------------------------------------------


class _Writer(HTMLParser):
    """A fragment as XML: quoted attributes, closed elements; an end without a begin is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and tag in self.open[-1:]:
            self.handle_endtag(tag)
        named = dict(reversed(attrs))
        self.out.append(f"<{tag}" + "".join(f' {k}="{entities.escape(named[k] or "")}"' for k in dict(attrs)))
        self.out.append("/>" if tag in VOID else ">")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while tag in self.open:
            last = self.open.pop()
            self.out.append(f"</{last}>")
            if last == tag:
                return

    def handle_data(self, data):
        self.out.append(entities.escape(data, quote=False))


def as_xhtml(fragment: str) -> str:
    writer = _Writer()
    writer.feed(fragment)
    writer.close()
    for tag in reversed(writer.open):
        writer.out.append(f"</{tag}>")
    return "".join(writer.out)


def body(source: str, headword: str) -> str:
    """An entry's body: the headword's element goes with its forms, other dictionary tags go alone."""
    out, gone = [], ""
    for p in pieces(source):
        if gone:
            gone = "" if p.closing and p.name == gone else gone
        elif p.name in ("idx:orth", "idx:infl"):
            gone = "" if p.empty or p.closing else p.name
        elif not _dictionary_tag(p):
            out.append(p.source)
    made = as_xhtml("".join(out))
    return made if made.strip() else f"<p>{entities.escape(headword, quote=False)}</p>"


def _dictionary_tag(p: Piece) -> bool:
    return p.name.startswith(("idx:", "mbp:"))


@pandas_udf(StringType())
def entry_body(html: pd.Series, headword: pd.Series) -> pd.Series:
    return pd.Series([body(x or "", w or "") for x, w in zip(html, headword)], dtype=object)


_LINK = re.compile(r"""\s*href="(?:content_\d+\.html)?#(hw_[^"]+)\"""")


@pandas_udf(StringType())
def _linked(html: pd.Series, targets: pd.Series) -> pd.Series:
    """Links to headwords with their targets; one to no entry loses its address."""
    out = []
    for text, found in zip(html, targets):
        known = dict(zip(found[::2], found[1::2])) if found is not None else {}
        out.append(_LINK.sub(lambda m, known=known: f' href="{entities.escape(known[m[1]])}"' if m[1] in known else "", text))
    return pd.Series(out, dtype=object)


def cross_references(bodies: DataFrame, places: DataFrame) -> DataFrame:
    """bodies: pkg_id, entry_ord, body; places: pkg_id, headword, target. Rewrites links by a join on the
    words that they name, so no entry carries its package's map."""
    asked = bodies.select("pkg_id", "entry_ord", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"""href="(?:content_\d+\.html)?#(hw_[^"]+)\""""), F.lit(1)))).alias("fragment"))
    first = places.groupBy("pkg_id", "headword").agg(F.min_by("target", "entry_ord").alias("target")).select("pkg_id", F.concat(F.lit("hw_"), "headword").alias("word"), "target")
    met = asked.withColumn("word", _unescaped("fragment")).join(first, ["pkg_id", "word"])
    lists = met.groupBy("pkg_id", "entry_ord").agg(F.flatten(F.collect_list(F.array("fragment", "target"))).alias("targets"))
    return bodies.join(lists, ["pkg_id", "entry_ord"], "left").withColumn("body", _linked("body", "targets")).drop("targets")


@pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(entities.unescape, na_action="ignore")


# --- files ---------------------------------------------------------------------------------


def _page(title: Column, language: Column, content: Column, root: str = "", of_body: str = "") -> Column:
    lang = xml_escape(language, True)
    return F.concat(F.lit(f'{DECLARATION}<html xmlns="{XHTML}" xmlns:epub="{OPS}"{root} xml:lang="'), lang, F.lit('" lang="'), lang, F.lit('">\n<head><title>'), xml_escape(title), F.lit(f"</title></head>\n<body{of_body}>\n"), content, F.lit("</body>\n</html>\n"))


def dictionary_files(entries: DataFrame, about: DataFrame, per_file: int = 2000) -> DataFrame:
    """pkg_id, path, content of whole packages.

    entries: pkg_id, entry_ord, headword, inflections, html; about: pkg_id, title, author, identifier,
    source, target. A document holds per_file entries by their order; its title is its first headword."""
    order = Window.partitionBy("pkg_id").orderBy("entry_ord")
    placed = entries.join(anchors(entries), ["pkg_id", "entry_ord"])
    number = F.floor((F.row_number().over(order) - 1) / per_file).cast("int") + 1
    name = F.concat(F.lit("content_"), F.lpad("file_no", 2, "0"), F.lit(".xhtml"))
    # lpad would cut a longer number
    name = F.when(F.col("file_no") < 100, name).otherwise(F.concat(F.lit("content_"), F.col("file_no").cast("string"), F.lit(".xhtml")))
    placed = placed.withColumn("file_no", number).withColumn("name", name).withColumn("target", F.concat("name", F.lit("#"), "anchor"))
    bodies = placed.select("pkg_id", "entry_ord", entry_body("html", "headword").alias("body"))
    linked = cross_references(bodies, placed.select("pkg_id", "entry_ord", "headword", "target"))
    article = F.concat(F.lit('<article id="'), xml_escape(F.col("anchor"), True), F.lit('"><dfn>'), xml_escape(F.col("headword")), F.lit("</dfn>\n"), "body", F.lit("</article>\n"))
    rows = placed.join(linked, ["pkg_id", "entry_ord"]).select("pkg_id", "file_no", "name", F.struct("entry_ord", "headword", article.alias("article")).alias("e"))
    docs = rows.groupBy("pkg_id", "file_no", "name").agg(F.array_sort(F.collect_list("e")).alias("es"))
    docs = docs.select("pkg_id", "file_no", "name", F.get("es", F.lit(0)).headword.alias("first"), F.array_join(F.transform("es", lambda e: e.article), "").alias("body")).join(about, "pkg_id")
    file = lambda df, path, content: df.select("pkg_id", path.alias("path"), content.cast("binary").alias("content"))
    texts = file(docs, F.col("name"), _page(F.col("first"), F.col("source"), F.col("body"), of_body=' epub:type="dictionary"'))
    lists = docs.groupBy("pkg_id").agg(F.array_sort(F.collect_list(F.struct("file_no", "name", "first"))).alias("docs")).join(about, "pkg_id")
    each = lambda f: F.array_join(F.transform("docs", f), "")
    nav = F.concat(F.lit('<nav epub:type="toc" id="toc">\n<ol>\n'), each(lambda d: F.concat(F.lit('<li><a href="'), d["name"], F.lit('">'), xml_escape(d["first"]), F.lit("</a></li>\n"))), F.lit("</ol>\n</nav>\n"))
    container = F.lit(f'{DECLARATION}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
    return (
        texts.unionByName(file(lists, F.lit("nav.xhtml"), _page(F.col("title"), F.col("source"), nav)))
        .unionByName(file(lists, F.lit("package.opf"), _package(each)))
        .unionByName(file(lists, F.lit("META-INF/container.xml"), container))
        .unionByName(_key_map(placed, about))
    )


def _package(each) -> Column:
    """The package document: both languages, the dictionary type, one search key map for all documents."""
    element = lambda name, x, attrs="": F.concat(F.lit(f"<{name}{attrs}>"), xml_escape(F.col(x)), F.lit(f"</{name}>\n"))
    meta = F.concat(
        element("dc:identifier", "identifier", ' id="bookid"'), element("dc:title", "title"), element("dc:language", "source"), element("dc:language", "target"), element("dc:creator", "author"),
        F.lit(f'<dc:type>dictionary</dc:type>\n<meta property="dcterms:modified">{MODIFIED}</meta>\n'), element("meta", "source", ' property="source-language"'), element("meta", "target", ' property="target-language"'),
    )
    own = lambda d: F.regexp_replace(d["name"], r"\.xhtml$", "")
    items = each(lambda d: F.concat(F.lit('<item id="'), own(d), F.lit('" href="'), d["name"], F.lit('" media-type="application/xhtml+xml"/>\n')))
    refs = each(lambda d: F.concat(F.lit('<itemref idref="'), own(d), F.lit('"/>\n')))
    return F.concat(
        F.lit(f'{DECLARATION}<package xmlns="{OPF}" version="3.0" unique-identifier="bookid" xml:lang="'), xml_escape(F.col("source"), True), F.lit(f'">\n<metadata xmlns:dc="{DC}">\n'), meta,
        F.lit('</metadata>\n<manifest>\n<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n'), items,
        F.lit('<item id="skm" href="skm.xml" media-type="application/vnd.epub.search-key-map+xml" properties="search-key-map dictionary"/>\n</manifest>\n<spine>\n'), refs, F.lit("</spine>\n</package>\n"),
    )


def _key_map(placed: DataFrame, about: DataFrame) -> DataFrame:
    """skm.xml of each package: a group for each entry, a match for each of its forms."""
    forms = search_forms(placed).join(placed.select("pkg_id", "entry_ord", "target"), ["pkg_id", "entry_ord"])
    match = F.array_join(F.transform(F.filter("forms", lambda f: f != ""), lambda f: F.concat(F.lit('<match value="'), xml_escape(f, True), F.lit('"/>\n'))), "")
    group = F.concat(F.lit('<search-key-group href="'), xml_escape(F.col("target"), True), F.lit('">\n'), match, F.lit("</search-key-group>\n"))
    whole = forms.groupBy("pkg_id").agg(F.array_sort(F.collect_list(F.struct("entry_ord", group.alias("g")))).alias("gs")).join(about, "pkg_id")
    text = F.concat(F.lit(f'{DECLARATION}<search-key-map xmlns="{OPS}" xml:lang="'), xml_escape(F.col("source"), True), F.lit('">\n'), F.array_join(F.transform("gs", lambda g: g["g"]), ""), F.lit("</search-key-map>\n"))
    return whole.select("pkg_id", F.lit("skm.xml").alias("path"), text.cast("binary").alias("content"))
