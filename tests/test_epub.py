"""Dictionaries as packages: rendered, zipped, read again and judged."""

from pyspark.sql import functions as F

from bindery.operators import epub
from bindery.rules import checks
from bindery.sources import packages, writers

ENTRIES = [
    ("d", 1, "a b", ["ab", "a b", ""], '<idx:entry><idx:orth value="a b">a b<idx:infl><idx:iform value="ab"/></idx:infl></idx:orth><p>one <a href="content_3.html#hw_café">café</a><br>two</idx:entry>'),
    ("d", 2, "café", [], '<idx:entry><idx:orth value="café"/><b>x & y</b> <a href="#hw_gone">gone</a> <a href="http://e.org/">out</a></i></idx:entry>'),
    ("d", 3, "a b", ["<&>"], "<idx:entry><idx:short/></idx:entry>"),
    ("d", 4, "a_20b_2", [], "plain"),
    ("e", 1, "a b", None, "other"),
]
ABOUT = [("d", "T & t", "A", "id", "fr", "en"), ("e", "E", "A", "id2", "de", "en")]


def test_names_and_fragments():
    assert epub.anchor_base("a b'c") == "hw_a_20b_27c"
    assert epub.as_xhtml("<p>a<p>b<br>c<i>d</p></u>&amp;<img src=x alt>") == '<p>a</p><p>b<br/>c<i>d</i></p>&amp;<img src="x" alt=""/>'


def test_dictionary_round_trip(spark):
    entries = spark.createDataFrame(ENTRIES, "pkg_id string, entry_ord long, headword string, inflections array<string>, html string")
    about = spark.createDataFrame(ABOUT, "pkg_id string, title string, author string, identifier string, source string, target string")
    assert {(r.pkg_id, r.entry_ord): r.anchor for r in epub.anchors(entries).collect()} == {("d", 1): "hw_a_20b", ("d", 2): "hw_café", ("d", 3): "hw_a_20b_2", ("d", 4): "hw_a_20b_2_2", ("e", 1): "hw_a_20b"}
    files = epub.dictionary_files(entries, about, per_file=2)
    zips = writers.epubs(files)
    t = packages.read(files.select("pkg_id", "path", "content"))
    assert zips.count() == 2 and {r.path for r in t.files.where("pkg_id = 'd'").collect()} == {"nav.xhtml", "package.opf", "skm.xml", "META-INF/container.xml", "content_01.xhtml", "content_02.xhtml"}
    text = {r.path: bytes(r.content).decode() for r in t.files.where("pkg_id = 'd'").collect()}
    assert '<a href="content_01.xhtml#hw_café">café</a><br/>two' in text["content_01.xhtml"] and "<a>gone</a>" in text["content_01.xhtml"] and "x &amp; y" in text["content_01.xhtml"]
    assert '<article id="hw_a_20b_2"><dfn>a b</dfn>\n<p>a b</p></article>' in text["content_02.xhtml"]
    assert text["skm.xml"].count("<match") == 6 and '<match value="&lt;&amp;&gt;"/>' in text["skm.xml"]
    for x in text.values():
        assert not packages.xml_error(x)
    rules = {r.rule_id for r in checks.validate(t).where("level > 3").collect()}
    assert not rules & {r for r in checks.CHECKS if r.startswith(("R5", "R6", "R7", "R8", "R9", "R13", "R16"))} and not rules & {"R15.e1", "R15.e2"}
    assert [(r.label, r.file_href) for r in t.toc_point.where(F.col("pkg_id") == "d").orderBy("ord").collect()] == [("a b", "content_01.xhtml"), ("a b", "content_02.xhtml")]
