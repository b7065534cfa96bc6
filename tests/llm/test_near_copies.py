"""The pipeline's near duplicates against all pairs, and planted edited copies."""

import random

import numpy as np

from bindery.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def exact(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Smallest id of each text's component, by all pairs."""
    sets, root = {d: exact(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def planted():
    rng, out = random.Random(7), {}
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(60)]
    for base in range(40):
        w = [word() for _ in range(rng.choice((3, 20, 90, 400)))] + (common if base % 3 == 0 else [])
        for _ in range(4):
            out[len(out)] = " ".join(w)
            w = list(w)
            for _ in range(rng.randrange(len(w) // 50 + 2)):
                w[rng.randrange(len(w))] = word()
    return out | {900: "", 901: " \n"}


def test_components_equal_all_pairs(spark):
    texts = planted()
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.components(docs).collect()} == brute(texts)


def test_links_of_a_group_equal_all_pairs():
    texts = planted()
    sets = {near_copies._node(s): s for s in map(near_copies.shingles, texts.values()) if len(s)}
    sets = list(sets.values())
    root = list(range(len(sets)))
    for a, b in near_copies.spanning_links(sets):
        root = [root[a] if r == root[b] else r for r in root]
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert root[a] == root[b] or not near_copies.similar(len(sets[a]), len(sets[b]), both)


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(3)
    rows, far = [], 0
    for k in range(30):
        w = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for copy in range(2):
            rows.append((2 * k + copy, " ".join(w), "en", "s", 1))
            w = list(w)
            for at in range(10, 300, 50):  # 6 edits: similarity 0.82
                w[at] = f"x{rng.randrange(3000)}"
        far += (simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(rows[-2][1])).bit_count() > 2
    assert far > 20
    kept = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, ""), (3, None), (None, "a b c"), (None, None), (5, "x " * 9), (5, "other text"), (6, "X " * 7)], "doc_id long, text string")
    kept = near_copies.keep_one(docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, "a b c"), (0, ""), (1, "a b c"), (2, ""), (5, "x " * 9), (5, "other text")])
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_shingles_that_prefixes_share():
    rng, seen = np.random.default_rng(0), 0
    for _ in range(3000):
        n, k = int(rng.integers(1, 130)), int(rng.integers(0, 12))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[min(k, n - 1) :], rng.integers(0, 2**63, k).astype(np.uint64)]))
        if near_copies.similar(len(a), len(b), len(np.intersect1d(a, b))):
            first = [s[: near_copies.prefix_length(len(s), near_copies.in_common(len(s)))] for s in (a, b)]
            assert len(np.intersect1d(*first)) >= near_copies.least_shared(len(a), len(b)) >= near_copies.in_common(max(len(a), len(b)))
            seen += 1
    assert seen > 500


def test_texts_of_one_passage_are_no_partners():
    """Texts that share a passage without being similar cost no comparison of sets."""
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 26).astype(np.uint64)
    lists = [np.concatenate([passage, rng.integers(0, 2**63, 180).astype(np.uint64)]) for _ in range(50)]
    lists.append(lists[7][:150])
    n = len(lists)
    kept = near_copies.partners(np.arange(n), np.full(n, 800), lists)
    assert np.flatnonzero(kept).tolist() == [7, n - 1]
    assert not near_copies.partners(np.zeros(n), np.full(n, 800), lists).any()


def test_what_fingerprints_link_is_one_part(spark, monkeypatch):
    """Texts that the fingerprints' groups connect take no part in the groups of shingles, all others do."""
    tables, real = {}, near_copies.written

    def spied(df, what):
        got = real(df, what)
        tables.setdefault(what, []).append(got.count())
        return got

    monkeypatch.setattr(near_copies, "written", spied)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in (10, 100, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = lambda prefixes: prefixes.select(prefixes.node.alias("grp") * 0, "node").distinct().toDF("grp", "node")
    assert {r.component_id for r in near_copies.components(docs, known=one).collect()} == {0}
    assert sum(tables["groups"]) == 0
    tables.clear()
    assert {r.component_id for r in near_copies.components(docs).collect()} == {0}
    assert sum(tables["groups"]) > 0


def test_fingerprints_link_most_edited_copies(spark, monkeypatch):
    """Edited copies mostly differ in more than two bits; the fingerprints' links connect most of them before any shingle is grouped."""
    tables, real = {}, near_copies.written

    def spied(df, what):
        got = real(df, what)
        tables.setdefault(what, []).append(got.count())
        return got

    monkeypatch.setattr(near_copies, "written", spied)
    rng, rows, far = random.Random(11), [], 0
    for k in range(40):
        w = [f"w{rng.randrange(3000)}" for _ in range(300)]
        prints = []
        for copy in range(2):
            rows.append((2 * k + copy, " ".join(w), "en", "s", 1))
            prints.append(simhash.majority(near_copies.runs(rows[-1][1])))
            for at in (50, 150, 250):
                w[at] = f"x{rng.randrange(3000)}"
        far += (prints[0] ^ prints[1]).bit_count() > 2
    assert far > 30
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))
    assert tables["parts"][0] >= 60


def test_near_fingerprints_within_three_bits_are_all_linked(spark):
    rng, prints = random.Random(5), []
    for _ in range(300):
        p = rng.getrandbits(64)
        prints += [p, p ^ sum(1 << b for b in rng.sample(range(64), 3))]
    signed = [simhash._signed(p) for p in prints]
    links = {frozenset((r.a, r.b)) for r in simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert all(frozenset(signed[k : k + 2]) in links for k in range(0, 600, 2))
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.FAR for a, b in map(tuple, links))


def test_tasks_leave_no_freed_memory():
    """After the set and quality tasks a worker holds little more than before them, in a process of its own."""
    code = """
import psutil, random, pyarrow as pa
from bindery.llm import near_copies, quality_rules
import numpy as np
held = lambda: psutil.Process().memory_info().rss / 1e6
def batches():
    rng = random.Random(1)
    for n in range(3):
        texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(300)) for _ in range(4000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array(texts)], ["doc_id", "tie", "text"])
def run():
    for _ in near_copies._prefixes(batches(), 5, np.zeros(0, np.uint64), np.zeros(0, np.int64)): pass
    for _ in quality_rules._passing(batches(), "text", 0.3, 100): pass
for _ in quality_rules._passing([next(batches()).slice(0, 50)], "text", 0.3, 100): pass
start = held(); run(); print(held() - start)
"""
    import subprocess
    import sys

    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(got.stdout) < 25, got.stdout
