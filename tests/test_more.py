"""Collation, markup, sinks and page images."""

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from bindery.functions import collation, markup
from bindery.operators import pixels
from bindery.sources import packages, writers


def values(spark, xs, f):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x string")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_kana(spark):
    a, b, c, d, e = values(spark, ["かな", "カナ", "ヴ", "漢 a", "かー・な"], collation.kana_key)
    assert a == b and c == collation.KANA_WEIGHTS[5:6]
    assert d == [0x10000 + ord("漢"), 3, 2] and e == a
    assert values(spark, ["カー", "んー", "ー", "あーー", "カナ"], collation.long_vowels) == ["カゕ", "んー", "ー", "あゕゕ", "カナ"]


def test_markup(spark):
    entry = '<idx:entry name="d">\n<idx:orth value="w"/><idx:infl><idx:iform value="a/b"/></idx:infl> <a href="content_1.html#hw_x">x</a></idx:entry>'
    assert values(spark, [entry, "<idx:entry></idx:entry>"], lambda x: markup.plain_entry(x, F.lit("h"))) == ['<b>w</b><a href="bword://x">x</a>', "<b>h</b>"]
    page = f'<?xml version="1.0"?><html xmlns:idx="u"><head><title>t</title><style>p {{}}</style></head><body class="c">{entry}</body></html>'
    assert values(spark, [page], markup.index_text) == ['<head><style>p {}</style><guide></guide></head><a href="content_1.html#hw_x">x</a><hr/>']
    assert markup.indexed('<idx:orth>\n w </idx:orth><b class="k">a</b><i style=\'x\'>c  d</i> <p>e</p><hr/><b>f</b> g <br/> <big>h</big>') == "w <b>a</b> <i>c d</i><p>e</p> <hr/> <b>f</b> g <br/> <big>h</big>"
    assert markup.indexed("<ol class='x'><li>a</li><li>b</li></ol>") == '<ol><li value="1">a</li><li value="2">b</li></ol>'
    assert markup.indexed("<head></head>x < y") == "<head><guide></guide></head>x < y"
    assert markup.listed("", "a<b") == "<b>a&lt;b</b>" and markup.listed("x\n\n \ny<mbp:pagebreak/>", "h") == "x\ny"
    assert markup.listed('<idx:orth value="w">v</idx:orth> <idx:short>s</idx:short> <a href="#hw_α">z</a> <a href="x#hw_y">q</a>', "h") == 'v s <a href="bword://α">z</a> <a href="x#hw_y">q</a>'
    assert markup.numbered("<ol><li>a<ol><li>b</ol><li value='7'>c<li>d</ol><ul><li>e</ul>") == "<ol><li value=\"1\">a<ol><li value=\"1\">b</ol><li value='7'>c<li value=\"8\">d</ol><ul><li>e</ul>"
    assert values(spark, ["a\\:b{x} c{y}", "c{y}"], markup.escaped_rules_last) == ["c{y}\na\\:b{x}", "c{y}"]


def test_zip_round_trip(spark):
    rows = [("p", "a.opf", b"<package/>"), ("p", "b/c.txt", b"x"), ("q", "d", b"")]
    built = writers.epubs(spark.createDataFrame(rows, "pkg_id string, path string, content binary"))
    got = {r.pkg_id: bytes(r.content) for r in built.collect()}
    first = zipfile.ZipFile(io.BytesIO(got["p"])).infolist()[0]
    assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
    back = built.select(F.col("pkg_id").alias("path"), "content").mapInPandas(packages._unzip, "pkg_id string, path string, content binary")
    assert sorted((r.pkg_id, r.path, bytes(r.content)) for r in back.where("path <> 'mimetype'").collect()) == sorted(rows)


def test_word_lists(spark):
    rows = [("p", 1, "b", ["bs", "a"], "<b>1</b>"), ("p", 2, "A", [], "é"), ("p", 3, "b", ["x"], "again")]
    got = {r.name: bytes(r.content) for r in writers.word_lists(spark.createDataFrame(rows, "pkg_id string, entry_ord long, headword string, inflections array<string>, html string")).collect()}
    assert writers.read_index(got["p.idx"], got["p.dict"]) == [("A", "é"), ("b", "<b>1</b>")]
    assert got["p.syn"] == b"bs\0\0\0\0\1" and b"wordcount=2\nsynwordcount=1" in got["p.ifo"]


def test_pixels(spark):
    page = np.full((100, 80), 255, np.uint8)
    rng = np.random.default_rng(1)
    page[10:40, 10:35] = rng.integers(0, 255, (30, 25))
    page[10:40, 45:70] = rng.integers(0, 255, (30, 25))
    page[55:90, 10:70] = rng.integers(0, 255, (35, 60))
    assert len(pixels.panels(page)) == 3 and pixels.panels(np.full((9, 9), 7, np.uint8)) == []
    assert pixels.cropped(page).shape == (80, 60)
    assert pixels.shrunk(np.full((100, 80), 9, np.uint8), 40, 40).tolist() == np.full((40, 32), 9).tolist()
    ramp = pixels.enhanced(np.arange(50, 150, dtype=np.uint8).reshape(10, 10))
    assert ramp.min() == 0 and ramp.max() == 255 and (np.diff(ramp.ravel().astype(int)) >= 0).all()
    assert [p.shape for p in pixels.halves(np.zeros((4, 6), np.uint8))] == [(4, 3), (4, 3)]
    assert (pixels.smoothed(np.full((5, 5), 8, np.uint8)) == 8).all()
    df = spark.createDataFrame([("p", 1, 100, 80, page.tobytes())], "pkg_id string, page_no int, height int, width int, data binary")
    assert pixels.panel_table(df).count() == 3 and pixels.prepared(df, 40, 40).count() == 1


def test_assembly_and_balance(spark):
    from bindery.operators import assembly
    from bindery.rules import balance

    rows = [("p", k, f"<idx:entry><b>wört{k}</b> text<hr/> more</idx:entry>") for k in range(3)]
    placed = assembly.entry_text(spark.createDataFrame(rows, "pkg_id string, k int, html string"), ["k"])
    text = bytes(assembly.package_text(placed).first().content)
    for r in placed.collect():
        own = text[r.offset : r.offset + r.size].decode()
        assert own == f"<b>wört{r.k}</b> text<hr/> more<hr/>" and text[r.offset : r.offset + r.text_len].decode() == f"<b>wört{r.k}</b> text"
    long = spark.createDataFrame([("p", ("a" * 4095 + "é<b>x").encode())], "pkg_id string, content binary")
    recs = assembly.split_words(assembly.text_records(long))
    assert [(r.rec_no, len(r.bytes), r.overlap) for r in recs.orderBy("rec_no").collect()] == [(0, 4096, 0), (1, 5, 1)]
    assert balance.unbalanced("<p><b>x</p></i><br><u/>") == ["b", "/i"] and balance.unbalanced("<p>") == ["p"]
    assert balance.findings(spark.createDataFrame([("p", "f", "<p></b>")], "pkg_id string, file string, text string")).count() == 2
    cut = spark.createDataFrame([("p", 0, b"a <b"), ("p", 1, b">x</b>"), ("p", 2, b"y")], "pkg_id string, rec_no int, bytes binary")
    assert [r.rec_no for r in balance.cut_tags(cut).collect()] == [0]
