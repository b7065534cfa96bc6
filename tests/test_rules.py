"""Each rule that test_packages.py has no case for: where it fires, and where it is silent."""

import pytest

from bindery.functions import imagery
from bindery.rules import checks
from bindery.sources import packages
from tests.test_packages import DICT_META, ENTRY, ITEMS, META, PAGE, PNG, package


def png(width, height, tail=b""):
    return PNG[:16] + width.to_bytes(4, "big") + height.to_bytes(4, "big") + PNG[24:] + tail


def jpeg(width, height, end=b"\xff\xd9"):
    app = b"\xff\xe0" + (16).to_bytes(2, "big") + b"JFIF\0" + b"\0" * 9
    frame = b"\xff\xc0" + (17).to_bytes(2, "big") + b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + b"\0" * 9
    return b"\xff\xd8" + app + frame + b"\xff\xda\0\0" + b"\x11" * 30 + end


def gif(width, height):
    return b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + b"\0\0\0\x3b"


def html(body, head=""):
    return f"<!DOCTYPE html>\n<html><head>{head}</head><body>{body}</body></html>"


NO_COVER = ITEMS.replace(' properties="cover-image"', "")
NAV_ITEM = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
CHAPTERS = '<item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="d" href="text/d.xhtml" media-type="application/xhtml+xml"/>'
VIEW = '<meta name="viewport" content="width=600, height=800"/>'
LAYOUT = '<meta property="rendition:layout">pre-paginated</meta>'


def image(name, kind, **more):
    rest = "".join(f' {k}="{v}"' for k, v in more.items())
    return f'<item id="i{name.replace(".", "")}" href="{name}" media-type="{kind}"{rest}/>'


ROWS = [
    *package("plain"),
    *package("images", items=ITEMS + image("a.tif", "image/tiff") + image("big.png", "image/png") + image("wide.jpg", "image/jpeg") + image("cut.jpg", "image/jpeg") + image("odd.png", "image/png") + image("named.gif", "image/png") + image("page.png", "image/png"),
             more=[("a.tif", "II"), ("big.png", png(10, 10, b"\0" * 140_000)), ("wide.jpg", jpeg(4000, 2000)), ("cut.jpg", jpeg(10, 10, b"")), ("odd.png", b"nothing known"), ("named.gif", png(10, 10)), ("page.png", "<html></html>"),]),
    *package("cover", items=NO_COVER),
    *package("named cover", items=NO_COVER, meta=META + '<x-metadata><EmbeddedCover>c.png</EmbeddedCover></x-metadata>'),
    *package("small cover", items=NO_COVER.replace('href="c.png"', 'href="s.jpg"').replace("image/png", "image/jpeg"), meta=META + '<meta name="cover" content="c"/>', more=[("s.jpg", jpeg(300, 900))]),
    *package("cover page", items=ITEMS + '<item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>', spine='<itemref idref="cover"/><itemref idref="a"/>', more=[("cover.xhtml", html('<img src="c.png" alt="x"/>'))]),
    *package("no ncx", version="2.0", items=ITEMS.replace("application/x-dtbncx+xml", "text/xml"), toc='toc="a"'),
    *package("ncx", toc="", more=[("toc.ncx", '<ncx><head><meta name="dtb:uid" content=" u2 "/></head><navMap><navPoint><navLabel><text> </text></navLabel><content src="gone.xhtml"/></navPoint><navPoint><navLabel><text>x</text></navLabel><content src="http://e.org/x"/></navPoint></navMap></ncx>')], guide='<reference type="cover" href="c.png"/>'),
    *package("nav order", version="3.0", items=ITEMS + NAV_ITEM + CHAPTERS, spine='<itemref idref="a"/><itemref idref="b"/><itemref idref="d"/>', page=html('<span epub:type="pagebreak" id="x"/>'),
             more=[("nav.xhtml", html('<nav epub:type="toc"><ol><li><a href="text/d.xhtml">D</a></li><li><a href="text/b.xhtml#x">B</a><ol><li><a href="a.xhtml">A  a</a></li></ol></li><li><a href="http://e.org/">E</a></li></ol></nav>')), ("text/b.xhtml", PAGE), ("text/d.xhtml", html('<p id="q">d</p><a href="b.xhtml#x">b</a><a href="../a.xhtml#x">a</a><img src="../img/n.png"/><img src="../c.png"/>')), ("img/n.png", PNG)]),
    *package("long", items=NO_COVER.replace('<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', ""), toc="", page=html("<p>" + "word " * 9000 + "</p>")),
    *package("markup", items=ITEMS + '<item id="s" href="s.css" media-type="text/css"/><item id="t" href="T.xhtml" media-type="application/xhtml+xml"/>', spine='<itemref idref="a"/><itemref idref="t"/>',
             page='<?xml version="1.0" encoding="latin-1"?><!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "dtd/xhtml11.dtd" [<!ENTITY e SYSTEM "x">]>\n<html><body><p>unclosed <table>' + "<tr><td>1</td></tr>" * 60 + "</table></body></html>", more=[("s.css", '@charset "latin-1"; a {}'), ("t.xhtml", PAGE)]),
    *package("manifest", items=ITEMS + '<item id="f" href="f.png" media-type="image/png" fallback-style="none"/><item id="o" href="o.bin" media-type="application/x-odd"/><item id="own" href="p.opf" media-type="text/xml"/><item id="h" href="a.xhtml#x" media-type="application/xhtml+xml"/><item id="g" href="#x" media-type="application/xhtml+xml"/><item id="q" href="q?.png" media-type="image/png"/><item id="e" href="é.png" media-type="image/png"/><item id="w" href="w.png" media-type="image/png" properties="nav 9x"/><item id="j" href="j.jpg" media-type="image/jpeg"/>',
             spine='<itemref idref="a"/><itemref idref="o"/>', more=[("f.png", PNG), ("o.bin", PNG), ("w.png", PNG), ("j.jpg", PNG)]),
    *package("links", version="3.0", items=ITEMS + CHAPTERS + '<item id="v" href="v.svg" media-type="image/svg+xml"/>', spine='<itemref idref="a"/><itemref idref="b"/>',
             page=html('<p id="x"/><img src="c.png#part"/><img src="v.svg#part"/><a href="c.png#y">c</a><svg><use xlink:href="v.svg"/><use xlink:href="v.svg#z"/></svg>'),
             more=[("v.svg", "<svg></svg>"), ("text/b.xhtml", html('<a href="../../out.xhtml?q">1</a><a href="../a.xhtml#x">2</a><a href="../a.xhtml#no">3</a><a href="./d.xhtml">4</a><img src="../c.png"/><a href="..">5</a>')), ("text/d.xhtml", PAGE)]),
    *package("fixed", version="3.0", meta=META + LAYOUT + '<meta property="rendition:spread">odd</meta><meta property="rendition:orientation">odd</meta><meta property="rendition:layout">odd</meta>', items=ITEMS + CHAPTERS, spine='<itemref idref="a"/><itemref idref="b"/>',
             page=html("<p>x</p>"), more=[("text/b.xhtml", html('<img src="../c.png"/>', '<meta name="viewport" content="width=600"/>')), ("text/d.xhtml", PAGE)]),
    *package("fixed well", version="3.0", meta=META + LAYOUT + '<meta property="rendition:spread">auto</meta><meta name="original-resolution" content="600x800"/>', page=html('<img src="c.png"/>', VIEW)),
    *package("undeclared layout", page=html('<img src="c.png"/>', VIEW)),
    *[(p, f, c.replace(b'unique-identifier=""', b"")) for p, f, c in package("no identifier", uid="", meta="<dc:title>T</dc:title><dc:language>en</dc:language>")],
    *package("lost dict", meta=META + "<x-metadata><DictionaryInLanguage>f_r</DictionaryInLanguage><DictionaryOutLanguage>en</DictionaryOutLanguage><DefaultLookupIndex>other</DefaultLookupIndex></x-metadata>", page=ENTRY.replace("<mbp:frameset>", "").replace("</mbp:frameset>", "")),
    *package("dict without entries", meta=DICT_META, spine=""),
    *package("dict in three", version="3.0", meta=DICT_META, items=ITEMS + '<item id="k1" href="k1.bin" media-type="application/vnd.epub.search-key-map+xml"/><item id="k2" href="k2.xml" media-type="application/vnd.epub.search-key-map+xml"/>',
             guide='</guide><collection role="dictionary"><link href="k1.bin"/><link href="k2.xml"/><link href="no.xml"/><link href="c.png"/></collection><collection role="dictionary"><link href="a.xhtml"/></collection><guide>', page=ENTRY, more=[("k1.bin", "x"), ("k2.xml", "<x/>")]),
    *package("good dict in three", version="3.0", meta=DICT_META.replace("EN", "en") + "<dc:type>dictionary</dc:type>", items=ITEMS + '<item id="k2" href="k2.xml" media-type="application/vnd.epub.search-key-map+xml"/>',
             guide='<reference type="index" href="a.xhtml"/></guide><collection role="dictionary"><link href="k2.xml"/><link href="a.xhtml"/></collection><guide>', page=ENTRY.replace("<body>", '<body epub:type="dictionary">').replace('value=""', 'value="x"'), more=[("k2.xml", "<x/>")]),
]

CASES = [
    ("plain", "", "R4.2.1 R4.2.3 R5.2.1 R5.2.2 R5.2.3 R5.5 R5.7 R5.8 R5.9 R5.11 R6.1 R6.7 R6.11 R7.13 R10.4.3 R10.4.4 R10.4.5 R16.2"),
    ("images", "R10.4.1 R10.4.2a R10.4.2b R10.4.3 R10.4.4 R10.4.5 R7.2", "R4.2.3"),
    ("cover", "R4.2.1", "R4.2.3"),
    ("named cover", "", "R4.2.1"),
    ("small cover", "R4.2.3", "R4.2.1 R10.4.2b"),
    ("cover page", "R4.2.4", ""),
    ("no ncx", "R5.2.1 R5.11", "R5.2.2"),
    ("ncx", "R5.2.2 R5.2.3 R5.5 R5.7 R5.8 R5.9 R5.10", "R5.11"),
    ("nav order", "R5.4 R5.5 R5.6", "R9.2 R9.3 R9.4 R9.7 R9.10"),
    ("long", "R5.1 R5.2.1 R7.1", "R5.2.2"),
    ("markup", "R6.1 R6.5 R6.7 R6.11 R6.12 R10.5.1", ""),
    ("manifest", "R7.3 R7.9 R7.10 R7.13 R8.5 R8.8 R9.11 R9.12 R13.1 R13.4", ""),
    ("links", "R9.1 R9.2 R9.3 R9.4 R9.5 R9.7 R9.10", "R9.6 R9.8 R9.9"),
    ("fixed", "R11.2 R11.3 R11.4 R11.5 R11.6 R11.7 R11.8 R11.9", "R11.1"),
    ("fixed well", "", "R11.1 R11.2 R11.3 R11.4 R11.5 R11.6 R11.7 R11.8 R11.9"),
    ("undeclared layout", "R11.1", "R11.3 R11.8"),
    ("no identifier", "R16.2", ""),
    ("lost dict", "R15.1 R15.3 R15.5", "R15.2 R15.4"),
    ("dict without entries", "R15.4", "R15.3 R15.5"),
    ("dict in three", "R15.e1 R15.e2 R15.e3 R15.e4 R15.e5 R15.e6 R15.e7", "R15.4"),
    ("good dict in three", "", "R15.1 R15.2 R15.3 R15.4 R15.5 R15.6 R15.7 R15.e1 R15.e2 R15.e3 R15.e4 R15.e5 R15.e6 R15.e7"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return packages.read(spark.createDataFrame([(p, f, c if isinstance(c, bytes) else c.encode()) for p, f, c in dict(((p, f), (p, f, c)) for p, f, c in ROWS).values()], "pkg_id string, path string, content binary"))


@pytest.fixture(scope="module")
def findings(tables):
    got = {}
    for r in checks.validate(tables).collect():
        got.setdefault(r.pkg_id, []).append(r)
    return got


@pytest.mark.parametrize("name, fires, silent", CASES)
def test_rule(findings, name, fires, silent):
    got = {r.rule_id for r in findings[name]}
    assert sorted(set(fires.split()) - got) == [] and sorted(set(silent.split()) & got) == []


def test_links_are_resolved(findings):
    by = lambda rule, name: sorted(r.detail for r in findings[name] if r.rule_id == rule)
    assert by("R9.7", "links") == ["../../out.xhtml?q"] and by("R9.10", "links") == ["../../out.xhtml?q"]
    assert by("R9.3", "links") == ["../a.xhtml#no"] and by("R9.1", "links") == ["c.png#part"]
    assert by("R9.2", "links") == ["./d.xhtml"] and by("R9.5", "links") == ["v.svg"]


def test_one_rule_alone(tables):
    got = {(r.pkg_id, r.rule_id) for r in checks.validate(tables, ["R9.7", "R11.1"]).collect()}
    assert got == {("links", "R9.7"), ("undeclared layout", "R11.1")}


def test_navigation_document_points(tables):
    got = [(r.depth, r.label, r.file_href, r.fragment) for r in tables.toc_point.where("pkg_id = 'nav order'").orderBy("ord").collect()]
    assert got == [(0, "D", "text/d.xhtml", None), (0, "B", "text/b.xhtml", "x"), (1, "A a", "a.xhtml", None)]
    assert [(r.label, r.file_href, r.fragment) for r in tables.toc_point.where("pkg_id = 'plain'").orderBy("ord").collect()] == [("One", "a.xhtml", None), ("Two", "a.xhtml", "x")]
    assert packages.nav_points('<nav><ol><li><a href="x">1</a></li></ol></nav><nav role="doc-toc"><ol><li><a href="#y"> 2\n3 </a></li></ol></nav><nav epub:type="toc"><ol><li><a href="z">4</a></li></ol></nav>', "n/nav.xhtml") == [(0, "2 3", "n/nav.xhtml", "y")]


def test_undeclared_images(tables):
    assert [(r.pkg_id, r.path, r.media_type) for r in tables.undeclared_image.collect()] == [("nav order", "img/n.png", "image/png")]


def test_image_sizes():
    assert imagery.size_of(jpeg(640, 480)) == (640, 480) and imagery.size_of(png(3, 4)) == (3, 4) and imagery.size_of(gif(5, 6)) == (5, 6)
    for bad in (None, b"", b"\xff\xd8\xff\xe0\xff\xff", b"\xff\xd8" + b"\0" * 40, jpeg(1, 1)[:22], b"RIFF1234WEBP"):
        assert imagery.size_of(bad) is None
