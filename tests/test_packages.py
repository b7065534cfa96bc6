"""Rules and parsers on small packages: what fires, and what stays silent."""

import io
import zipfile

import pytest

from bindery.operators import terms
from bindery.rules import catalog, checks
from bindery.sources import packages

OPF = """<?xml version="1.0"?>
<package xmlns="http://www.idpf.org/2007/opf" version="{version}" unique-identifier="{uid}" {extra}>
<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata>
<manifest>{items}</manifest>
<spine {toc}>{spine}</spine>
<guide>{guide}</guide>
</package>"""
NCX = '<ncx><head><meta name="dtb:uid" content="u1"/></head><navMap><navPoint id="n1"><navLabel><text>One</text></navLabel><content src="a.xhtml"/><navPoint id="n2"><navLabel><text>Two</text></navLabel><content src="a.xhtml#x"/></navPoint></navPoint></navMap></ncx>'
META = '<dc:title>T</dc:title><dc:identifier id="u">u1</dc:identifier><dc:language>en</dc:language><dc:date>2024-02-29</dc:date>'
ITEMS = '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="c" href="c.png" media-type="image/png" properties="cover-image"/>'
PAGE = '<!DOCTYPE html>\n<html><body><p id="x">one</p><a href="a.xhtml#x">l</a></body></html>'
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (600).to_bytes(4, "big") + (800).to_bytes(4, "big") + b"\x08\x02\0\0\0"


def package(name, version="2.0", uid="u", meta=META, items=ITEMS, spine='<itemref idref="a"/>', guide="", toc='toc="ncx"', extra="", page=PAGE, more=()):
    opf = OPF.format(version=version, uid=uid, meta=meta, items=items, spine=spine, guide=guide, toc=toc, extra=extra)
    files = {"p.opf": opf, "a.xhtml": page, "toc.ncx": NCX, "c.png": PNG, **dict(more)}
    return [(name, k, v if isinstance(v, bytes) else v.encode()) for k, v in files.items()]


ENTRY = '<html><body><mbp:frameset><idx:entry name="default"><idx:orth value="rivière">rivière<idx:infl><idx:iform value="rivières"/></idx:infl></idx:orth> water</idx:entry><idx:entry name="default"><idx:orth>fleuve</idx:orth> big</idx:entry><idx:entry><idx:orth value=""/></idx:entry></mbp:frameset></body></html>'
DICT_META = META + "<x-metadata><DictionaryInLanguage>fr</DictionaryInLanguage><DictionaryOutLanguage>EN</DictionaryOutLanguage></x-metadata>"
ROWS = [
    *package("clean"),
    *package("content", page='<?xml version="1.1"?><!DOCTYPE odd>\n<html xmlns:epub="http://bad"><body><p>a<p>b</p></p>\n<script src="x"></script><h1 style="text-align:left">&eacute;</h1>\n<i style="margin: -3px">&nbsp;</i></body></html>'),
    *package("links", page="""<html><body><a href="a.xhtml#none">1</a><a href="../../x">2</a><a href="file:///x">3</a><img src="data:image/png,x"/><a href="a b">4</a><a href="a.xhtml?q=1">5</a><a href='b.xhtml'>6</a><a href="http://e.org/">7</a></body></html>""", items=ITEMS + '<item id="b" href="b.xhtml" media-type="application/xhtml+xml"/>', more=[("b.xhtml", PAGE)]),
    *package("manifest", items=ITEMS + '<item id="x" href="X.bin" media-type="application/x-odd" fallback="y"/><item id="y" href="y.bin" media-type="application/x-odd" fallback="x"/><item id="z" href="z b." media-type="image/jpg" fallback="none"/><item id="z2" href="c.png" media-type="image/jpeg" properties="bad:prop odd"/><item id="h" href="A.xhtml" media-type="text/html"/>', spine='<itemref idref="a" linear="no"/><itemref idref="a" linear="no"/><itemref idref="x" linear="no"/>', more=[("extra.txt", "x"), ("X.bin", "x")]),
    *package("metadata", uid="nope", meta='<dc:title> </dc:title><dc:identifier id="u" scheme="UUID">x</dc:identifier><dc:language>EN_us</dc:language><dc:date>2023-02-30</dc:date><dc:date>soon</dc:date><meta name="a"/>', guide='<reference type="text" href="gone.xhtml"/>'),
    *package("style", items=ITEMS + '<item id="s" href="s.css" media-type="text/css"/>', more=[("s.css", '@namespace x "y"; @import "gone.css"; a { position: fixed; background: url(no.png) } @font-face { font-family: f } @media (hover) { b { color: red } /* } */')]),
    *package("dict", meta=DICT_META, page=ENTRY, more=[]),
    *package("prefix", version="3.0", extra='prefix="a: http://a b: nouri dcterms: http://x a: http://a c"', items=ITEMS.replace('id="a" href', 'id="a" properties="svg" href'), page="<html><body><math></math></body></html>"),
    *package("broken", meta='<dc:title>T</dc:title><dc:language>en</dc:wrong>'),
]


@pytest.fixture(scope="module")
def tables(spark):
    return packages.read(spark.createDataFrame(ROWS, "pkg_id string, path string, content binary"))


@pytest.fixture(scope="module")
def findings(tables):
    got = {}
    for r in checks.validate(tables).collect():
        got.setdefault(r.pkg_id, []).append(r)
    return got


def rules(findings, name):
    return {r.rule_id for r in findings[name]}


def test_catalog():
    all_rules = catalog.rules()
    assert len(all_rules) == len({r for r, _, _ in all_rules}) == 117
    assert sorted(checks.CHECKS) == sorted(r for r, _, _ in all_rules)
    assert [sum(1 for _, level, _ in all_rules if level == k) for k in (2, 3, 4)] == [1, 41, 75]


def test_clean(findings):
    assert rules(findings, "clean") == {"R4.1.1"}


@pytest.mark.parametrize(
    "name, fires, silent",
    [
        ("content", "R6.2 R6.3 R6.4 R6.6 R6.8 R6.9 R6.10 R10.3.1 R17.1", "R6.5 R6.7 R6.11 R15.4 R11.8"),
        ("links", "R9.2 R9.3 R9.6 R9.7 R9.8 R9.9 R9.10", "R9.1 R9.4 R9.5 R9.11 R9.12"),
        ("manifest", "R4.2.2 R7.1 R7.2 R7.4 R7.5 R7.6 R7.7 R7.8 R7.11 R7.12 R8.9 R8.10 R13.2 R13.3 R13.5", "R7.9 R7.10 R7.13 R8.5"),
        ("metadata", "R5.3.1 R16.1 R16.3 R16.4 R16.5 R16.6 R16.7 R16.8", "R16.2 R5.2.3"),
        ("style", "R6.13 R6.14 R6.15 R6.16 R6.17 R6.e1 R6.e2", "R6.12"),
        ("dict", "R15.2 R15.6 R15.7", "R15.1 R15.3 R15.4 R15.5 R15.e1 R11.8"),
        ("prefix", "R8.1 R8.2 R8.3 R8.4 R8.6 R8.7", "R8.5 R8.8"),
    ],
)
def test_rules(findings, name, fires, silent):
    got = rules(findings, name)
    assert set(fires.split()) <= got and not set(silent.split()) & got


def test_levels_and_counts(findings, spark, tables):
    from bindery.rules.lines import severity_counts

    counts = {r.pkg_id: r for r in severity_counts(checks.validate(tables, ["R4.1.1", "R16.3", "R16.5"]), "pkg_id").collect()}
    assert counts["metadata"].errors == 1 and counts["metadata"].warnings == 1 and counts["clean"].infos == 1


def test_broken_package_ends_the_scan(tables):
    assert tables.item.where("pkg_id = 'broken'").count() == 0 and tables.pkg.where("pkg_id = 'broken'").count() == 1


def test_navigation_points(tables):
    got = [(r.depth, r.label, r.href) for r in tables.nav_point.where("pkg_id = 'clean'").orderBy("ord").collect()]
    assert got == [(0, "One", "a.xhtml"), (1, "Two", "a.xhtml#x")]


def test_entries_to_lookup(spark, tables):
    e = tables.entry.where("pkg_id = 'dict'")
    assert sorted((r.headword, tuple(r.inflections)) for r in e.collect()) == [("fleuve", ()), ("rivière", ("rivières",))]
    built = terms.build_terms(e.withColumnRenamed("k", "entry_ord"))
    asked = spark.createDataFrame([("dict", "RIVIERE"), ("dict", "fleuve"), ("dict", "lac")], "pkg_id string, query string")
    assert {r["query"]: r["label"] for r in terms.lookup(built, asked).collect()} == {"RIVIERE": "rivière", "fleuve": "fleuve", "lac": None}
    assert {r["query"]: r["label"] for r in terms.lookup(built, asked, "literal").collect()} == {"RIVIERE": None, "fleuve": "fleuve", "lac": None}


def test_zip_and_folder_sources(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for _, path, content in package("x"):
            z.writestr(path, content)
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "x.epub").write_bytes(raw.getvalue())
    (tmp_path / "zips" / "bad.epub").write_bytes(b"no zip")
    assert packages.read(packages.read_epubs(spark, str(tmp_path / "zips" / "*.epub"))).item.count() == 3
    for _, path, content in package("x"):
        f = tmp_path / "tree" / "x" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)
    got = packages.read_folders(spark, str(tmp_path / "tree"))
    assert {(r.pkg_id, r.path) for r in got.select("pkg_id", "path").collect()} == {("x", p) for p in ("p.opf", "a.xhtml", "toc.ncx", "c.png")}
