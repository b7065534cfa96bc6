"""The operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from bindery.llm import decontaminate, encoder, language_id, near_copies, packing, quality_model, quality_rules, simhash, substring_dedup, token_counts, token_store, toxicity

SMALL = "/root/testdata/sf0.001"


def texts(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


def test_encoder_equals_library(spark):
    enc = encoder.encoder(encoder.default_path())
    odd = ["a\n", "a\nb\n", "\na", "a \nb", "x  <|endoftext|>  y\n", "ſa ǅb", "a\xa0b c", "\n\n a", "it's 'll", "a\x1cb", "y" * 200, "a b", " ", "é\tñ"]
    some = [r.text for r in texts(spark).collect()] + odd
    for t, ids in zip(some, enc.encode_all(some)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.library.encode(t, add_special_tokens=False).ids


def test_counts_splice_and_widen():
    enc, rng, stats = encoder.encoder(encoder.default_path()), random.Random(1), {}
    for _ in range(20):
        t = "".join(rng.choice(["the ", "on\n", "er ", "  ", "x", "<|endoftext|>", " é", ". "]) for _ in range(2000))
        assert token_counts.count(t, enc, 400, 48, stats) == len(enc.library.encode(t, add_special_tokens=False).ids)
    assert stats["spliced"] and stats["widened"]
    assert token_counts.count("x" * 3000, enc, 400, 48) == len(enc.library.encode("x" * 3000, add_special_tokens=False).ids)


def test_sentencepiece_counts():
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    enc, rng = encoder.encoder(path), random.Random(2)
    t = " ".join(rng.choice(["the", "ontion", "él", "edly,", "x1"]) for _ in range(2000))
    assert token_counts.count(t, enc, 700, 64) == len(enc.library.encode(t))


@pytest.mark.parametrize("top", [1, 4, 15, 20, 40, 63])
def test_simple8b_round_trip(top):
    rng = random.Random(top)
    for n in (0, 1, 2, 59, 61, 1000):
        ids = np.array([rng.randrange(1 << rng.randrange(1, top + 1)) for _ in range(n)], np.uint64)
        words, escaped, offsets = token_store.pack(ids)
        assert (token_store.unpack(words, escaped, n) == ids).all() and len(offsets) == -(-len(words) // 8 // token_store.STRIDE)
    assert len(token_store.pack(np.zeros(240, np.uint64))[0]) == 32


def test_parts_of_a_block():
    rng = random.Random(12)
    for top in (4, 16, 63):
        ids = np.array([rng.randrange(1 << rng.randrange(1, top + 1)) for _ in range(5000)], np.uint64)
        words, escaped, offsets = token_store.pack(ids)
        for _ in range(40):
            a, b = sorted(rng.randrange(5001) for _ in range(2))
            assert (token_store.unpack_part(words, escaped, offsets, a, b) == ids[a:b]).all()


def test_read_range(spark, tmp_path):
    docs, path = texts(spark), str(tmp_path / "t")
    token_store.write_tokens(docs, path, shards=3)
    every = b"".join(r.ids for r in token_store.read_tokens(spark, path, with_ids=True).orderBy("start").collect())
    for a, b in ((0, 10), (70_000, 140_001), (len(every) // 4 - 5, len(every) // 4 + 9)):
        rows = token_store.read_range(spark, path, a, b).orderBy("start").collect()
        assert b"".join(r.ids for r in rows) == every[4 * a : 4 * b] and rows[0].start == a


def test_merges_of_odd_and_long_texts():
    enc, rng, group = encoder.encoder(encoder.default_path()), random.Random(13), encoder.GROUP
    some = ["".join(rng.choice("abcdeé×÷ñŁ.,!?'\"  \n\n1$ſ µß") for _ in range(rng.randrange(1, 80))) for _ in range(400)] + ["A×b ÷ c", "x" * 64 + " " + "é" * 40, "a\0b c", "word " * 300]
    try:
        for encoder.GROUP in (group, 64):
            for t, ids in zip(some, enc.encode_all(some)):
                assert np.frombuffer(ids, "<u4").tolist() == enc.library.encode(t, add_special_tokens=False).ids
    finally:
        encoder.GROUP = group


def test_token_store_equals_library(spark):
    enc = encoder.encoder(encoder.default_path())
    start, want = 0, []
    for r in texts(spark).orderBy("doc_id").collect():
        ids = np.array([*enc.library.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.op3_token_store(spark, SMALL).collect())) == want


def test_repeats():
    rng = random.Random(3)
    for _ in range(150):
        c = [rng.randrange(rng.choice([2, 3, 8])) for _ in range(rng.randrange(5, 40))]
        n, covered, longest = len(c), set(), 0
        for i in range(n):
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and c[i + k] == c[j + k]:
                    k += 1
                longest = max(longest, k)
                covered |= set(range(i, i + k)) if k >= 4 else set()
        assert quality_rules.repeats(np.array(c)) == (len(covered), longest)
        spans = {p for words, _, starts in quality_rules.maximal_repeats(np.array(c)) for s in starts for p in range(s, s + words)}
        assert spans == covered


def test_quality_base():
    t = "a b c a b c\nx * <b>\nx * <b>\n\n\n"
    assert quality_rules.measures(t)[:5] == (12, 16, 6, 1, 12)


def test_fingerprints_and_components(spark):
    import xxhash

    rows = texts(spark).collect()
    prints = {}
    for r in rows:
        w = r.text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    want = sorted((d, f"{p:016x}", find(d)) for d, p in prints.items())
    assert sorted(map(tuple, simhash.op4_simhash(spark, SMALL).collect())) == want


def test_dense_and_refined_buckets(spark):
    rng, prints = random.Random(4), set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(60):
            prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    from bindery.llm.components import connected_components

    for bucket in (4, 4096):  # 4: buckets are refined to the last level
        links = simhash.hamming_links(df, bucket)
        pairs = {tuple(sorted((r.a, r.b))) for r in links.collect()}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
        got = {r.node: r.root for r in connected_components(links).collect()}
        comp = {p: p for p in prints}
        for _ in range(8):
            for a in prints:
                for b in prints:
                    if (a ^ b).bit_count() <= 2:
                        comp[a] = comp[b] = min(comp[a], comp[b])
        groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
        mine = {p: got.get(simhash._signed(p), simhash._signed(p)) for p in prints}
        assert groups(mine) == groups(comp)


def test_components_of_chains_and_stars(spark):
    from bindery.llm.components import connected_components

    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    for few in (0, 50, 1000):  # by rounds alone, by rounds and then one task, by one task
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), few).collect()}
        assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def brute_substrings(rows, window=50):
    first, out = {}, []
    for d, t in rows:
        w = t.encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = t.encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = b"\1" * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    rows = [tuple(r) for r in texts(spark).collect()]
    assert sorted(map(tuple, substring_dedup.op7_substring_dedup(spark, SMALL).collect())) == brute_substrings(rows)


def test_substring_dedup_planted(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 120, 300)]
    rows = []
    for d in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(4)]
        rows.append((d, "\n".join(parts[:2] + [rng.choice(passages), rng.choice(passages)] + parts[2:])))
    rows += [(50, rows[0][1]), (51, rows[0][1]), (52, passages[1]), (53, "a " * 200), (54, "a " * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.substring_dedup(df).collect()
    said = sorted((r.doc_id, r["__n_words"], r["__n_removed"], hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()) for r in got)
    assert said == brute_substrings(rows)


def test_alignment():
    rng = random.Random(7)
    for _ in range(100):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 15))], [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == h.max()


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_decontamination_finds_edited_copies(spark, block_bytes):
    rng = random.Random(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(10).collect()]
    rows, planted = [], set()
    for k, r in enumerate(texts(spark).limit(120).collect()):
        w = r.text.split()
        if k % 4 == 0:
            item, text = items[k % len(items)]
            copy = text.split()
            for p in rng.sample(range(len(copy)), len(copy) // 7):
                copy[p] = rng.choice(["zz", copy[p] + "x"])
            w[len(w) // 2 : len(w) // 2] = copy
            planted.add((10_000 + k, item))
        rows.append((10_000 + k if k % 4 == 0 else 20_000 + k, " ".join(w)))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    whole = {(d, i) for d, t in rows for i, x in items if " ".join(x.split()) in t}
    assert planted <= pairs and pairs - planted <= whole


def test_packing_is_valid_and_tight(spark):
    got = packing.op8_packing(spark, SMALL).collect()
    enc = encoder.encoder(encoder.default_path())
    lengths = {r.doc_id: enc.encode(r.text) + (2).to_bytes(4, "little") for r in texts(spark).collect()}
    at = {}
    for r in got:
        assert zlib.crc32(lengths[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) // 4 for x in lengths.values())
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(at) <= -(-sum(r.length for r in got) // 1024) + 2


def brute_bins(items, capacity):
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity:
                bins[b] += items[k]
                place(k + 1, bins)
                bins[b] -= items[k]
        bins.append(items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(9)
    for _ in range(60):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        counts = np.bincount(items, minlength=21)
        best = packing.solve(counts, 20)
        used = np.zeros(21, int)
        for m, pattern in best:
            assert sum(pattern) <= 20
            for x in pattern:
                used[x] += m
        assert (used == counts).all() and sum(m for m, _ in best) == brute_bins(items, 20)
        assert packing.lower_bound(counts, 20) <= brute_bins(items, 20)


def test_bin_completion_beyond_small_cases():
    rng = random.Random(14)
    for k in range(60):
        if k % 3 == 0:  # full sequences of six to eight pieces, cut at random
            items = []
            for _ in range(rng.randrange(3, 6)):
                cuts = sorted(rng.sample(range(1, 60), rng.randrange(5, 8)))
                items += [b - a for a, b in zip([0, *cuts], [*cuts, 60])]
            least = sum(items) // 60
        else:
            items = [rng.randrange(8, 45) for _ in range(rng.randrange(10, 15))]
            least = brute_bins(sorted(items, reverse=True), 60)
        best, bound, proven = packing.solved(np.bincount(items, minlength=61), 60)
        assert sorted(x for m, p in best for x in p * m) == sorted(items) and all(sum(p) <= 60 for _, p in best)
        assert proven and sum(m for m, _ in best) == least >= bound


def test_packing_of_whole_histograms():
    rng = np.random.default_rng(15)
    counts = np.bincount(rng.integers(1, 1025, 1500), minlength=1025)
    best, bound, _ = packing.solved(counts)
    used = np.zeros(1025, int)
    for m, p in best:
        assert sum(p) <= 1024
        np.add.at(used, list(p), m)
    assert (used == counts).all() and sum(m for m, _ in best) <= bound + 1
    many, bound, _ = packing.solved(counts * 10**6)
    assert sum(m for m, _ in many) <= 1.0014 * bound


def test_phrases():
    rng = random.Random(10)
    for _ in range(150):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 5))]
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 20)))
        n = i = 0
        while i < len(text):
            k = 0
            while i + k < len(text) and any(text[i : i + k + 1] in w for w in words):
                k += 1
            i, n = i + max(1, k), n + 1
        assert language_id.SuffixAutomaton(words).phrases(text) == n


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    said = [r for r in language_id.op9_language_id(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in said) >= 0.97 * len(said)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    said = [r for r in quality_model.op6_quality_model(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in said) >= 0.95 * len(said)
    said = [r for r in toxicity.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].toxic for r in said) >= 0.9 * len(said)


def test_isotonic_is_monotone_and_pools():
    s, y = np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0])
    got = toxicity.Isotonic().fit(s, y).scores(np.array([0.0, 2.5, 5.0]))
    assert (np.diff(got) >= 0).all() and abs(got[1] - 0.5) < 0.02


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SMALL).collect()
    docs = texts(spark).collect()
    kept = {r.doc_id for r in docs if quality_rules.verdict(quality_rules.measures(r.text), quality_rules.MAX_COVERED, quality_rules.MAX_REPEAT)[1]}
    assert {r.doc_id for r in got} <= kept
    # Components of all pairs with a similarity of 0.8 or more; the smallest id of each stays.
    sets = {r.doc_id: near_copies.shingles(r.text) for r in docs if r.doc_id in kept}
    root = {d: d for d in sets}
    for d in sorted(sets):
        for e in sorted(sets):
            both = len(np.intersect1d(sets[d], sets[e], assume_unique=True)) if d < e and root[d] != root[e] else 0
            if both and near_copies.similar(len(sets[d]), len(sets[e]), both):
                low, high = sorted((root[d], root[e]))
                root = {k: low if v == high else v for k, v in root.items()}
    alone = {d for d in root if root[d] == d}
    assert {r.doc_id for r in got} <= alone
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in docs if any(x in r.text for x in items)}
    assert alone - leaked <= {r.doc_id for r in got} and not leaked & {r.doc_id for r in got}


def test_op2_query(spark):
    want = []
    for r in texts(spark).collect():
        w = r.text.encode().split()
        lines = [x for x in r.text.split("\n") if x.encode().split()]
        threes = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {p for k, t in enumerate(threes) if threes.count(t) > 1 for p in (k, k + 1, k + 2)}
        want.append((r.doc_id, len(w), sum(len(x.decode()) for x in w), sum(r.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = quality_rules.op2_quality_rules(spark, SMALL).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)


def test_op5_query(spark):
    enc = encoder.encoder(encoder.default_path())
    want = [(r.doc_id, len(r.text.encode()), n := len(enc.library.encode(r.text, add_special_tokens=False).ids), n > 1024) for r in texts(spark).collect()]
    assert sorted(map(tuple, token_counts.op5_token_counts(spark, SMALL).collect())) == sorted(want)


def test_op1_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    whole = {(r.doc_id, i) for r in texts(spark).collect() for i, x in items if x in r.text}
    got = decontaminate.op1_decontaminate(spark, SMALL).collect()
    assert whole and whole <= {(r.doc_id, r.item_id) for r in got} and all(r.score >= 0.5 for r in got)
