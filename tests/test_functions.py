"""Truth tables of the functions and codecs, and the operators that have no SQL."""

import random

import pytest
from pyspark.sql import functions as F

from bindery.functions import codecs
from bindery.functions import text as T
from bindery.operators import layout, metadata, navigation, repair, terms
from bindery.sources import records


def values(spark, xs, f, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"k int, x {kind}")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_text_functions(spark):
    assert values(spark, ["é", "Ç", "øłþµƒ", "ΟΔΟΣ", "İ", "a1"], T.fold_latin) == ["e", "c", "oltmf", "οδοσ", "i", "a1"]
    assert values(spark, ["а́б", "x"], T.strip_stress) == ["аб", "x"]
    assert values(spark, ["a b c​d"], T.plain_spaces) == ["a b c d"]
    assert values(spark, ["<p>ab</p>", "a > b", "x<", ""], T.strip_tags_len) == [2, 4, 1, 0]
    assert values(spark, ["a\nb\r\n", "", "\n"], T.lines) == [["a", "b"], [], [""]]
    assert values(spark, ["&amp;lt;", "&nbsp;x"], T.unescape_named) == ["<", "\xa0x"]
    assert values(spark, ["a+b%20c", "%C3%A9", "%zz"], T.percent_decode) == ["a+b c", "é", "%zz"]
    assert values(spark, ["a/./b/../c", "../x", "/a"], T.normalize_path) == ["a/c", "x", "a"]
    assert values(spark, ["a/../../x"], lambda x: T.normalize_path(x, True)) == ["../x"]
    assert values(spark, [0, 31, 32, 40000], T.base32_index, "int") == ["0000", "000V", "0010", "1720"]
    assert values(spark, ["zh_CN", "zh-TW", "ko", "fr-CA", "xx", "en-GB"], T.locale_code) == [0x04, 0x04, 0x0412, 0x040C, 0x09, 0x09]
    assert values(spark, ["Word", "Word en-fr"], lambda x: T.title_with_pair(x, F.lit("de"), F.lit("en"))) == ["Word (de-en)", "Word en-fr"]
    got = values(spark, ["page10", "page2"], T.natural_key)
    assert got[1] < got[0]


def test_dates(spark):
    table = {"2024": "valid", "2024-13": "bad_value", "2023-02-30": "bad_value", "2024-02-29": "valid", "2024-02-29T24:00:00Z": "bad_value", "2024-02-29T10:00:00+01:00": "bad_syntax"}
    assert values(spark, list(table), T.w3cdtf_kind) == list(table.values())


def test_codecs(spark):
    assert codecs.fnv1a(b"") == codecs.FNV_OFFSET and codecs.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert codecs.seeded_uuid("x")[14] == "4" and codecs.seeded_uuid("x") == codecs.seeded_uuid("x")
    assert values(spark, ["a", None, "é"], codecs.fnv1a_hex) == ["af63dc4c8601ec8c", None, f"{codecs.fnv1a('é'.encode()):016x}"]
    for n in (0, 1, 127, 128, 0x11111, 2**28):
        assert codecs.read_varint(codecs.varint(n)) == (n, len(codecs.varint(n)))
    assert codecs.numeric_entities("&#65;&#x42;&#xD800;") == "AB&#xD800;"


def test_record_compression():
    rng = random.Random(1)
    for _ in range(60):
        data = b"".join(rng.choice([b"the ", b"on ", bytes([rng.randrange(256)]), b"\0", b"aaaa"]) for _ in range(rng.randrange(0, 400)))
        assert codecs.decompress(codecs.compress(data)) == data
    assert len(codecs.compress(b"abcabcabc" * 100)) < 300


@pytest.mark.parametrize("n, want", [(0, []), (1, [1]), (4095, [4095]), (4096, [4096]), (4097, [4096, 1])])
def test_record_ranges(spark, n, want):
    df = spark.createDataFrame([(n,)], "n long")
    assert [r.bytes for r in layout.record_ranges(df, "n").orderBy("rec_no").collect()] == want


def test_chunk_size_doubles(spark):
    assert values(spark, [1, 4096 * 65_000, 4096 * 65_000 + 1, 4096 * 65_000 * 3], layout.chunk_size, "long") == [4096, 4096, 8192, 16384]


def test_packing_and_pool(spark):
    rows = spark.createDataFrame([("p", k, n) for k, n in enumerate([40, 30, 40, 100, 10])], "pkg_id string, k int, size long")
    got = [(r.bin, r.bin_offset) for r in layout.greedy_pack(rows, "size", "k", "pkg_id", 100).orderBy("k").collect()]
    assert got == [(0, 0), (0, 40), (1, 0), (2, 0), (3, 0)]
    pool = layout.string_pool(spark.createDataFrame([("p", 0, "aa"), ("p", 1, "b"), ("p", 2, "aa"), ("p", 3, "c")], "pkg_id string, ord int, value string"), limit=5)
    assert {r.value: r.pool_offset for r in pool.collect()} == {"aa": 0, "b": 3, "c": 65536}


def test_navigation_clamp(spark):
    points = [("b", k, d) for k, d in enumerate([2, None, 3, 1, 0, 5])]
    got = navigation.clamp_depths(spark.createDataFrame(points, "pkg_id string, ord int, depth int"))
    assert [r.depth for r in got.orderBy("ord").collect()] == [0, 0, 1, 1, 0, 1]
    t = {r.ord: (r.parent, r.subtree_end, r.bfs_no) for r in navigation.tree(got).collect()}
    assert t == {0: (None, 1, 0), 1: (None, 4, 1), 2: (1, 3, 3), 3: (1, 4, 4), 4: (None, None, 2), 5: (4, None, 5)}


def test_term_precedence(spark):
    rows = [("p", 1, "Run", ["ran", "runs", "go (x)"]), ("p", 2, "Run", ["ran"]), ("p", 3, "ran", []), ("p", 4, "за́мок", [])]
    e = spark.createDataFrame(rows, "pkg_id string, entry_ord long, headword string, inflections array<string>")
    got = {r.label: (r.tier, r.entry_ord) for r in terms.build_terms(e).collect()}
    assert got == {"Run": (0, 2), "ran": (0, 3), "runs": (1, 1), "за́мок": (0, 4), "замок": (2, 4), "run": (3, 2)}
    strict = {r.label for r in terms.build_terms(e, strict_accents=True).collect()}
    assert "run" not in strict


def test_metadata_round(spark):
    old = spark.createDataFrame([("f", 100, "a"), ("f", 101, "b"), ("f", 101, "b2"), ("f", 102, "c")], "file string, type int, value string")
    new = spark.createDataFrame([("f", 100, "a"), ("f", 101, ""), ("f", 103, "d"), ("f", 102, None), ("f", 104, "")], "file string, type int, value string")
    plan = metadata.plan_changes(old, new)
    assert sorted((r.type, r.op) for r in plan.collect()) == [(101, "removed"), (101, "removed"), (103, "added")]
    assert sorted((r.type, r.value) for r in metadata.apply_changes(old, plan).collect()) == [(100, "a"), (102, "c"), (103, "d")]


def test_repair_is_stable(spark):
    docs = spark.createDataFrame([("p", "a.xhtml", '<html><body id="top"><a href="b.xhtml#b0">x</a><img alt=""/><img src="i.png"/></body></html>'), ("p", "b.xhtml", '<?xml version="1.0"?><html><body id="b0"></body></html>')], "pkg_id string, path string, text string")
    once = repair.repaired(docs)
    got = {r.path: r for r in once.collect()}
    assert got["a.xhtml"].fixes == ["body_id_link", "stray_image", "declaration"] and got["b.xhtml"].fixes == []
    assert 'href="b.xhtml"' in got["a.xhtml"].text and '<img src="i.png"/>' in got["a.xhtml"].text
    assert all(r.fixes == [] for r in repair.repaired(once.select("pkg_id", "path", "text")).collect())
    assert repair.report(once).count() == 1


def test_record_containers(spark):
    block = records.metadata_block([(100, b"Author"), (503, "Tïtle".encode())])
    rows = [("f", "My Book!", 0, b"head" + block), ("f", "My Book!", 1, b"x" * 10), ("f", "My Book!", 2, b"")]
    built = records.containers(spark.createDataFrame(rows, "file_id string, title string, rec_no int, bytes binary"))
    recs = records.records(built)
    assert [(r.rec_no, bytes(r.bytes)) for r in recs.orderBy("rec_no").collect()] == [(k, b) for _, _, k, b in rows]
    assert [(r.type, bytes(r.value)) for r in records.metadata(recs).orderBy("ord").collect()] == [(100, b"Author"), (503, "Tïtle".encode())]
    assert records.layout_problems(recs, built.select("file_id", F.octet_length("content").alias("size"))).count() == 0
    assert built.select(records.number(F.col("content"), 76, 2).alias("n")).first().n == 3


def test_watch(spark, tmp_path):
    import io
    import zipfile

    from bindery.streaming.watch import watch

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("p.opf", "<package><metadata/><manifest/><spine/></package>")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.epub").write_bytes(raw.getvalue())
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["R4.1.1", "R16.2"], once=True)
    q.awaitTermination(120)
    assert {r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"R4.1.1", "R16.2"}


def test_index_records(spark):
    from bindery.sources import index_records as ir

    words = sorted((f"wörd{k:04d}" for k in range(500)), key=lambda w: w.encode("utf-16-be"))
    rows = [("p", w, k, k * 300, 7 * k % 1000) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "pkg_id string, label string, index_ord long, start_pos long, text_len long")
    got = sorted(ir.index_records(df, limit=3000).collect(), key=lambda r: r.bin)
    assert len(got) > 3 and all(len(r.record) <= 3000 + ir.HEADER + 6 for r in got)
    back = [e for r in got for e in ir.parse_record(bytes(r.record))]
    assert back == [(w.encode("utf-16-be"), {1: s, 2: n}) for _, w, _, s, n in rows]
    route = ir.routing([(bytes(r.last_label), r.n) for r in got])
    assert ir.parse_tag_table(route) == ir.TERM_TAGS and sum(n for _, n in ir.parse_routing(route)) == 500
    assert ir.parse_routing(route)[-1][0] == words[-1].encode("utf-16-be")
    assert ir.parse_entry(ir.entry(b"x" * 300, {1: 5}), 0) == (b"x" * 254, {1: 5})


def test_precedence_of_long_form_lists(spark):
    forms = [f"f{k}" for k in range(65541)] + ["late"]
    e = spark.createDataFrame([("p", 0, "a", forms), ("p", 1, "b", ["late"])], "pkg_id string, entry_ord long, headword string, inflections array<string>")
    assert terms.build_terms(e).where("label = 'late'").first().entry_ord == 0


def test_named_metadata_and_protection(spark):
    import struct

    from bindery.sources import records

    head = lambda encryption: struct.pack(">HHIHHH", 2, 0, 9000, 3, 4096, encryption) + b"\0\0"
    one = lambda encryption, *pairs: records.build("t", [head(encryption) + records.metadata_block(list(pairs)), b"x"])
    files = [("plain", one(0, (100, b"A"), (201, b"\0\0\0\7"), (999, b"long value"))), ("locked", one(2)), ("limited", one(0, (403, b"x"))), ("short", records.build("t", [b"x"]))]
    recs = records.records(spark.createDataFrame(files, "file_id string, content binary"))
    got = {(r.type, r.name, r.number) for r in records.named_metadata(records.metadata(recs)).where("file_id = 'plain'").collect()}
    assert got == {(100, "creator", 65), (201, "coveroffset", 7), (999, "unknown", None)}
    assert {r.file_id for r in records.refused(recs).collect()} == {"locked", "limited"}
    r = records.text_header(recs).where("file_id = 'plain'").first()
    assert (r.compression, r.text_length, r.text_records, r.record_size) == (2, 9000, 3, 4096)


def test_labels_are_cut_between_characters():
    from bindery.sources import index_records

    text = "a" * 126 + "\U0001f600" * 3
    label, _ = index_records.parse_entry(index_records.entry(text.encode("utf-16-be"), {1: 5, 2: 6}), 0)
    assert label.decode("utf-16-be") == "a" * 126


def test_base32_of_numbers_beyond_the_width(spark):
    import duckdb

    from bindery.plans import queries as q

    ids = [0, 1048575, 1048576, 1048577, 5_999_999, 2**63 - 1, -1, -2, -32, -33, -1024, -(2**63)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT unnest(?)::BIGINT AS event_id", [ids])
    want = dict(con.execute(q.SQL["base32_index"]).fetchall())
    assert want[1048577] == "0001"
    assert dict(zip(ids, values(spark, ids, T.base32_index, "long"))) == want
