"""The trained operators against plain forms of their methods."""

import random

import numpy as np

from bindery.llm import decontaminate, language_id, quality_model, simhash, toxicity

SMALL = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_op6_equals_a_plain_discriminant(spark):
    from zlib import crc32

    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect() if r.quality is not None and crc32(str(r.doc_id).encode()) % 3 != 1}
    docs = table(spark, "documents").select("doc_id", "text").collect()
    x = {r.doc_id: np.array(quality_model.statistics(r.text)) for r in docs}
    own = [np.array([x[d] for d, y in labels.items() if y == k]) for k in (0, 1)]
    n, cov = [len(o) for o in own], [np.cov(o.T, bias=True) for o in own]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))

    def density(k, v):
        c = (0.7 * cov[k] + 0.3 * pooled) / np.outer(scale, scale)
        c = 0.95 * c + 0.05 * np.eye(len(c)) * np.trace(c) / len(c)
        gap = v / scale - own[k].mean(axis=0) / scale
        return np.log(n[k] / sum(n)) - 0.5 * (np.linalg.slogdet(c)[1] + gap @ np.linalg.inv(c) @ gap)

    got = {r.doc_id: r for r in quality_model.op6_quality_model(spark, SMALL).collect()}
    for d, v in x.items():
        want = 1 / (1 + np.exp(-np.clip(density(1, v) - density(0, v), -500, 500)))
        assert abs(got[d].score - want) < 1e-6 and got[d].held_out == (crc32(str(d).encode()) % 3 == 1)


def test_first_split_of_trees_is_the_best():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
        trees = toxicity.Trees(rounds=1, depth=1, least=5).fit(x, y)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        grow, hess = y - p, np.full(60, max(p * (1 - p), 1e-6))
        part = lambda m: grow[m].sum() ** 2 / (hess[m].sum() + 1)
        gains = {(c, v): part(x[:, c] <= v) + part(x[:, c] > v) - part(np.ones(60, bool)) for c in range(3) for v in range(6) if min((x[:, c] <= v).sum(), (x[:, c] > v).sum()) >= 5}
        raw = trees.raw(x)
        assert len(np.unique(raw)) <= 2
        if len(np.unique(raw)) == 2:
            left = raw == raw.min()
            c, v = max(gains, key=gains.get)
            assert abs(part(left) + part(~left) - part(np.ones(60, bool)) - gains[c, v]) < 1e-9


def test_trees_are_the_sum_of_their_leaves():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] > 0.5).astype(float)
    trees = toxicity.Trees(rounds=12).fit(x, y)
    for row in x[:30]:
        f = trees.base
        for levels, values in trees.trees:
            at = 0
            for splits in levels:
                column, cut = splits[at]
                at = 2 * at + int(np.searchsorted(trees.edges[column], row[column], "left") > cut)
            f += values[at]
        assert abs(f - trees.raw(row[None])[0]) < 1e-9
    assert ((trees.raw(x) > 0) == (y > 0)).mean() > 0.9


def test_isotonic_equals_min_max_means():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(2, 12))
        s, y = rng.permutation(n).astype(float), rng.integers(0, 2, n).astype(float)
        by = y[np.argsort(s)]
        want = [max(min(by[a : b + 1].mean() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        levels = sorted({round(w, 9) for w in want})
        got = toxicity.Isotonic().fit(s, y)
        assert len(got.value) == len(levels) and np.abs(got.value - levels).max() < 0.02


def test_features_don_t_change_with_length():
    told = toxicity.Words({"bad": 3.0})
    for part in ("A² You bad!! ", "ÀB c1d looong bad you? "):
        short, long = toxicity.features(part * 10, told), toxicity.features(part * 4000, told)
        for k in (2, 4, 5, 7, 8, 9, 10, 11, 12, 13):
            assert abs(short[k] - long[k]) < 1e-9
    assert toxicity.features("x bad " * 4 + "you", toxicity.Words({"bad": 1.0}))[6] == 3


def test_cross_parse_equals_a_plain_one():
    rng = random.Random(6)
    texts = {x: [language_id.plain(" ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 7))) for _ in range(30)))] for x, a in (("aa", "abc"), ("bb", "bcd"), ("cc", "xyz"))}
    model = language_id.Languages(texts)

    def brute(text, train):
        n = i = 0
        while i < len(text):
            k = 0
            while i + k < len(text) and text[i : i + k + 1] in train:
                k += 1
            i, n = i + max(1, k), n + 1
        return n

    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdxyzé1 ") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 60)))
        p = language_id.plain(text)
        if not p.strip():
            continue
        codes = model.codes(text)
        assert len(codes) == len(p)
        blocks = [p[a : a + language_id.BLOCK] for a in range(0, len(p), language_id.BLOCK)]
        bits = [sum(brute(b, texts[x][0]) for b in blocks) * c / len(p) for x, c in zip(model.names, model.cost)]
        assert model.predict(text)[0] == model.names[int(np.argmin(bits))]


def test_language_ties_and_letters():
    model = language_id.Languages({"bb": [" ab "], "aa": [" ab "]})
    name, score = model.predict("ab")
    assert name == "aa" and abs(score - 0.5) < 1e-9
    for t in ("² ½ ³ Ⅷ", "123 _ -", "", None, "\n"):
        assert model.predict(t) == ("und", 0.0)
    assert model.predict("AB " * 50_000)[0] == "aa"
    assert [x[0] for x in model.predict_all(["ab", None, "ab ab"])] == ["aa", "und", "aa"]


def test_many_languages_are_all_learnt(spark):
    rows = [(k, " ".join([chr(0x4E00 + k) * 3] * 20), f"l{k:03d}") for k in range(1, 261)]
    got = language_id.language_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(r.lang_pred == f"l{r.doc_id:03d}" for r in got.collect() if not r.held_out)


def test_aligned_span_has_the_score():
    rng = random.Random(7)
    for _ in range(60):
        a, b = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 12))]), np.array([rng.randrange(3) for _ in range(rng.randrange(1, 30))])
        score, begin, end = decontaminate.align(a, b)
        if score:
            assert decontaminate.align(a, b[begin:end])[0] == score
            assert b[begin] in a and b[end - 1] in a
            assert decontaminate.align(a, b[begin : end - 1])[0] < score


def test_op1_equals_alignment_of_all_pairs(spark):
    docs = [(r.doc_id, decontaminate.words(r.text)) for r in table(spark, "documents").collect()]
    items = [(r.item_id, decontaminate.words(r.text)) for r in table(spark, "benchmark").collect()]
    codes: dict = {}
    number = lambda w: np.array([codes.setdefault(x, len(codes)) for x in w], np.int64)
    coded = [(i, number(w)) for i, w in items]
    want = set()
    for d, w in docs:
        text = number(w)
        for i, own in coded:
            if 2 * np.isin(own, text).sum() >= len(own) and decontaminate.align(own, text)[0] >= min(len(own), 2 * decontaminate.LONG):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.op1_decontaminate(spark, SMALL).collect()}
    assert got == want


def test_recall_at_a_quarter_of_the_words_edited(spark):
    rng = random.Random(8)
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    texts = [r.text for r in table(spark, "documents").collect()]
    rows, planted = [], set()
    for k in range(150):
        item, text = items[k % len(items)]
        copy = text.split()
        for p in rng.sample(range(len(copy)), len(copy) // 4):
            copy[p] = rng.choice(["zz", copy[p] + "x"])
        w = texts[k].split()
        rows.append((k, " ".join(w[: len(w) // 2] + copy + w[len(w) // 2 :])))
        planted.add((k, item))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), table(spark, "benchmark"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(planted & found) >= 0.95 * len(planted)


def test_short_and_unspaced_and_long_items(spark):
    long = " ".join(f"q{k}" for k in range(200))
    items = [(1, "zyx"), (2, "two words"), (3, "これは試験です"), (4, long), (5, " . ")]
    rows = [(1, "a zyx b"), (2, "words two"), (3, "so two words here"), (4, "前これは試験ですね"), (5, "これは実験です"), (6, " ".join(long.split()[50:90])), (7, " ".join(long.split()[50:70])), (8, ("pad " * 30 + "two ") * 20_000 + "two words")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (3, 2), (4, 3), (5, 3), (6, 4), (8, 2)]


def test_majority():
    h = np.array([0b1011, 0b0011, 0b0110], np.uint64)
    assert simhash.majority(h) == 0b0011 and simhash.majority(h[:0]) == 0


def test_folds():
    assert {toxicity._part(k) for k in range(1000)} == set(range(toxicity.FOLDS))
