"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds. The benchmark's runs of GRAM words are counted over all documents. A run is rare, and a
seed, if at most RARE_DOCS documents or RARE of them hold it. As an item that was copied often has no
rare run, the run in fewest documents of every stretch of STRETCH runs is a seed as well.
A document's seeds give the stretches of it to align. Local alignment of words (match 2, mismatch -1, gap
-1), divided by the score of the whole item against itself, is the score; SCORE or more
is contamination, which allows for about a quarter of the words to be edited. So is an aligned
stretch that is worth LONG equal words, whatever part of a long item that is.

The benchmark is a held-out set of bounded size. It is handed to the tasks in blocks of at
most BLOCK_BYTES of text, one pass for each block, so no broadcast exceeds the bound.

Words are runs of letters, digits and underscores, lower case, and single characters of scripts
that set no spaces; other signs don't count.

Defined results: null or empty texts match nothing; an item of fewer than GRAM words is found
where its whole sequence of words stands; one without words or with a null id or text is no test item; repeated documents give a row each, repeated items
one for each of their ids; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM = 3
STRETCH = 8
RARE_DOCS = 8
RARE = 1e-4
SCORE = 0.5
LONG = 30
BLOCK_BYTES = 8 << 20
#: Thai to Khmer, kana, and ideographs: scripts without spaces between words.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_ALONE}]+|(?=\w)[{_ALONE}]")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(w: list[str], n: int = GRAM) -> list[tuple[str, ...]]:
    return list(zip(*(w[k:] for k in range(n))))


def runs(w: list[str]) -> list[tuple[str, ...]]:
    """What can seed an item: its runs of GRAM words, or all its words if they are fewer."""
    return grams(w) or ([tuple(w)] if w else [])


def _held(w: list[str], wanted: dict, sizes: list[int]):
    """(place, run) of the wanted runs of a document."""
    for n in sizes:
        for p, g in enumerate(zip(*(w[k:] for k in range(n)))):
            if g in wanted:
                yield p, g


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of word codes, and the begin and end (exclusive) in text."""
    n = len(text)
    if not n or not len(item):
        return 0, 0, 0
    gaps = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(text == word, 2, -1)
        up = row[1:] - 1
        now, came = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diagonal >= up
        now[1:] = np.where(take, diagonal, up)
        came[1:] = np.where(take, origin[:-1], origin[1:])
        fresh = now <= 0
        now[fresh] = 0
        came[fresh] = gaps[fresh]
        # Gaps in the text: the best cell to the left, one less for each step.
        reach = np.maximum.accumulate(now + gaps)
        left = reach - gaps
        source = np.maximum.accumulate(np.where(now + gaps == reach, gaps, 0))
        came = np.where(left > now, came[source], came)
        row, origin = np.maximum(now, left), came
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(origin[top]), top)
    return best


def _gram_counts(batches, wanted: dict):
    """Documents of this task that hold each wanted run, and all of them as one run more: one row for each at most."""
    counts, sizes = np.zeros(len(wanted) + 1, np.int64), sorted({len(g) for g in wanted})
    for batch in batches:
        counts[-1] += batch.num_rows
        for text in common.texts_of(batch):
            for g in {g for _, g in _held(words(text), wanted, sizes)}:
                counts[wanted[g]] += 1
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["gram", "n"])


def elect_seeds(items: list[tuple[int, tuple[str, ...]]], seen: dict[tuple, int], n_docs: int, stretch: int = STRETCH) -> dict[tuple, list[tuple[int, int]]]:
    """run of words -> (index of the item, position) of the runs that are rare or the rarest of some stretch."""
    seeds, rare = defaultdict(list), max(RARE_DOCS, RARE * n_docs)
    for item, (_, w) in enumerate(items):
        own = runs(list(w))
        chosen = {min(range(a, min(a + stretch, len(own))), key=lambda p: (seen.get(own[p], 0), p)) for a in range(max(1, len(own) - stretch + 1))}
        chosen |= {p for p, g in enumerate(own) if seen.get(g, 0) <= rare}
        for p in sorted(chosen):
            seeds[own[p]].append((item, p))
    return dict(seeds)


def seed_sizes(seeds: dict) -> list[int]:
    return sorted({len(g) for g in seeds})


def matches(w: list[str], seeds: dict, items: list, score: float, sizes: list[int]) -> list[tuple[int, float, int, int, int]]:
    """(item, score, seeds, begin word, end word) of each item that is aligned well enough."""
    hits = defaultdict(list)
    for p, g in _held(w, seeds, sizes):
        for item, q in seeds[g]:
            hits[item].append(p - q)
    if not hits:
        return []
    found = []
    codes: dict[str, int] = {}
    text = np.array([codes.setdefault(x, len(codes)) for x in w])
    for item, begins in hits.items():
        item_id, own = items[item]
        code = np.array([codes.get(x, -1) for x in own])
        slack, best = len(own) // 2 + 2, (0, 0, 0)
        stretches: list[list[int]] = []
        for p in sorted(begins):  # stretches of the text that overlap are aligned as one
            if stretches and p - slack <= stretches[-1][1]:
                stretches[-1][1] = p + len(own) + slack
            else:
                stretches.append([p - slack, p + len(own) + slack])
        for a, b in stretches:
            a = max(0, a)
            got = align(code, text[a:b])
            if got[0] > best[0]:
                best = (got[0], got[1] + a, got[2] + a)
        if best[0] >= min(score * 2 * len(own), 2 * LONG):
            found.append((item_id, best[0] / (2 * len(own)), len(begins), best[1], best[2]))
    return found


def _matched(batches, seeds: dict, items: list, score: float):
    sizes = seed_sizes(seeds)
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), common.texts_of(batch)):
            out += [(doc_id, *m) for m in matches(words(text), seeds, items, score, sizes)]
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "n_seeds", "begin_word", "end_word"])


def _clean(batches, text_col: str, blocks: list, score: float):
    sized = [(seeds, items, seed_sizes(seeds)) for seeds, items in blocks]
    for batch in batches:
        keep = [not any(matches(w, seeds, items, score, sizes) for seeds, items, sizes in sized) for w in map(words, common.texts_of(batch, text_col))]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, block_bytes: int):
    """(seeds, items) of each block of the benchmark."""
    tests = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()  # of bounded size
        items = [(i, w) for i, w in sorted({(r.item_id, tuple(words(r.text))) for r in rows}) if w]
        wanted = {g: j for j, g in enumerate(dict.fromkeys(g for _, w in items for g in runs(list(w))))}
        counted = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_gram_counts, wanted=wanted), "gram long, n long")
        seen = {r.gram: r.n for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # the block's runs at most
        yield elect_seeds(items, {g: seen.get(j, 0) for g, j in wanted.items()}, seen.get(len(wanted), 0)), items


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, n_seeds, begin_word, end_word of each document and item aligned."""
    rows, out = common.id_and_text(docs, id_col, text_col), None
    for seeds, items in _blocks(rows, benchmark, "text", block_bytes):
        got = rows.mapInArrow(partial(_matched, seeds=seeds, items=items, score=score), "doc_id long, item_id long, score double, n_seeds long, begin_word long, end_word long")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, n_seeds long, begin_word long, end_word long")


def keep_clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item."""
    for block in _blocks(docs, benchmark, text_col, block_bytes):
        docs = docs.mapInArrow(partial(_clean, text_col=text_col, blocks=[block], score=score), docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
