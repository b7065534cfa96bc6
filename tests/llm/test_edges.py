"""Null columns, empty and long texts, repeated rows, empty tables, clashing column names."""

import pytest

from bindery.llm import decontaminate, language_id, packing, quality_model, quality_rules, simhash, substring_dedup, token_counts, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, score string, fingerprint int, component_id string, task string, rank int, x int, `fp` int"
WORDS = " ".join(f"word{k % 97} other{k % 89}." for k in range(400))


def rows():
    more = (None,) * 8
    return [
        (1, "a b c", "en", "s", 5, True, *more),
        (1, "a b c", "en", "s", 5, True, *more),
        (2, "", "en", None, 0, None, *more),
        (3, None, None, None, None, None, *more),
        (None, "a b c", "de", None, None, None, *more),
        (None, None, None, None, None, None, *more),
        (4, " \n\t ", "de", "s", 4, None, *more),
        (5, WORDS * 30, "fr", "s", 9, None, *more),
        (5, "another text of the same id", "fr", "s", 9, None, *more),
        (6, WORDS * 30, "fr", "s", 9, None, *more),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0), (5, 0, 1), (6, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a b c"), (2, None), (None, "x y z"), (3, ""), (4, "word0 other0. word1 other1. word2 other2. word3 other3."), (4, "word0 other0. word1 other1. word2 other2. word3 other3.")], "item_id long, text string")


def by_id(df, *columns):
    return sorted([tuple(r) for r in df.select("doc_id", *columns).collect()], key=repr)


def test_token_counts(docs, none):
    got = by_id(token_counts.token_counts(docs), "n_bytes", "n_tokens", "over_limit")
    assert len(got) == 10 and got.count((1, 5, 3, False)) == 2 and (2, 0, 0, False) in got and (3, 0, 0, False) in got and (None, 0, 0, False) in got
    assert token_counts.token_counts(none).count() == 0


def test_token_store(spark, docs, none, tmp_path):
    token_store.write_tokens(docs, str(tmp_path / "t"), shards=3)
    got = token_store.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 5, 6]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[0].start == 0
    token_store.write_tokens(none, str(tmp_path / "n"))
    assert token_store.read_tokens(spark, str(tmp_path / "n")).count() == 0


def test_quality_rules(docs, none):
    got = by_id(quality_rules.quality_rules(docs), "n_words", "base_failed", "kept")
    assert len(got) == 10 and (2, 0, True, False) in got and (3, 0, True, False) in got
    assert quality_rules.keep_good(docs).columns == docs.columns and quality_rules.keep_good(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0


def test_simhash(docs, none):
    got = by_id(simhash.simhash_components(docs), "fingerprint", "component_id")
    assert [c for d, _, c in got if d is None] == [None, None]
    zero = {(d, c) for d, f, c in got if f == "0" * 16}
    assert zero == {(2, 2), (3, 2), (4, 2), (None, None)}
    assert {c for d, _, c in got if d == 1} == {1} and {c for d, _, c in got if d == 6} == {5}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 5, 5]
    assert simhash.simhash_components(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_substring_dedup(docs, none):
    got = by_id(substring_dedup.substring_dedup(docs), "__n_words", "__n_removed")
    n = len((WORDS * 30).split())
    assert got.count((1, 3, 0)) == 2 and (5, n, 0) in got and (5, 6, 0) in got and (6, n, n) in got and (3, 0, 0) in got and (None, 3, 0) in got
    assert substring_dedup.substring_dedup(none).count() == 0


def test_decontaminate(docs, none, benchmark):
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(1, 1), (None, 1), (5, 4), (6, 4)}
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5]
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5, 6} and max(r.length for r in got) <= 1024
    assert sum(1 for r in got if r.doc_id == 1) == 2
    assert packing.pack(none).count() == 0


def test_language(docs, none):
    got = by_id(language_id.language_scores(docs), "held_out", "lang_pred", "score")
    assert len(got) == 10 and (2, False, "und", 0.0) in [(d, False, p, s) for d, _, p, s in got] and all(p == "und" for d, _, p, _ in got if d in (3, 4))
    assert not any(h for d, h, _, _ in got if d is None)
    assert language_id.language_scores(none).count() == 0


@pytest.mark.parametrize("scores", [quality_model.quality_scores, toxicity.toxicity_scores])
def test_models(docs, none, labels, scores):
    got = by_id(scores(docs, labels), "held_out", "score", "predicted")
    assert len(got) == 10 and all(0 <= s <= 1 for _, _, s, _ in got) and not any(h for d, h, _, _ in got if d is None)
    assert len({s for d, _, s, _ in got if d == 1}) == 1
    assert scores(none, labels).count() == 0
    assert {s for _, _, s, _ in by_id(scores(docs, labels.limit(0)), "held_out", "score", "predicted")} <= {0.0, 0.5}
