"""The pipeline's stages on odd rows, one after the other."""

import corpus_pipeline

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = " ".join(f"word{k} other{k * 7 % 613}." for k in range(300))


def rows():
    edited = GOOD.replace("word50 ", "changed ")
    passage = " ".join(f"p{k}" for k in range(80))
    fresh = lambda s: " ".join(f"{s}{k * 13 % 997}" for k in range(200))
    return [
        (1, GOOD, "en", "s", len(GOOD)),
        (1, GOOD, "en", "s", len(GOOD)),
        (1, GOOD + " ", "en", "t", 0),
        (2, GOOD, "en", None, None),
        (3, edited, None, None, None),
        (4, "", "en", "s", 0),
        (5, None, None, None, None),
        (None, fresh("n"), "de", None, None),
        (None, None, None, None, None),
        (6, " \n\t ", "de", "s", 4),
        (7, f"{fresh('a')}\n{passage}", "fr", "s", 9),
        (8, f"{fresh('b')}\n{passage}", "fr", "s", 9),
        (9, " ".join(f"long{k}" for k in range(40_000)), "fr", "s", 9),
        (10, "same " * 400, "fr", "s", 9),
    ]


def folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"a{k * 13 % 997}" for k in range(40, 70))), (2, None), (None, "x y z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), FIELDS)
    sf, after = folder(spark, tmp_path, docs), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == FIELDS.replace(" long", "").replace(" string", "").split(", ")
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=repr)
    ids = lambda name: sorted(d or 0 for d, _, _ in after[name])
    assert ids("quality_rules") == [0, 1, 1, 1, 2, 3, 7, 8, 9]
    assert ids("simhash_near_dedup") == [0, 1, 7, 8, 9]
    texts = {d: t for d, t, _ in after["substring_dedup"]}
    assert "p5 p6" in texts[7] and "p5" not in texts[8].split() and "b13" in texts[8]
    assert ids("decontaminate") == [0, 1, 8, 9]
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {None, 1, 8, 9}
    assert max(r.piece for r in packed if r.doc_id == 9) > 3


def test_rows_that_stay_are_the_same_every_time(spark, tmp_path):
    docs = spark.createDataFrame(rows(), FIELDS)
    kept = [sorted(map(str, corpus_pipeline.simhash_near_dedup(spark, d, "").collect())) for d in (docs, docs.repartition(5), docs.orderBy("n_chars"))]
    assert kept[0] == kept[1] == kept[2]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, spark.createDataFrame([], FIELDS))).count() == 0
