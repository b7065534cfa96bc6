"""Substring dedup: repeated token windows by Rabin-Karp hashes, counted in Spark.

A window is WINDOW consecutive words of a row. Each word covered by a window that also starts
in a document with a smaller id is removed; windows are judged on the input.

Not every window is shuffled. Every window of 50 words elects, of its 39 runs of 12 words, the
one with the least hash, so equal windows elect equal runs: an elected run that occurs in
one text only (elections are about a twentieth of the words) proves that no window electing
it repeats. Every window that elected a run found in two different texts is hashed to 96
bits and counted in Spark: the least ids by a pre-aggregated grouping, joined back to
the windows. So a window that isn't counted is one that is proven to be alone; counting all of them
would shuffle some 40 bytes for each word of the corpus. Equal texts take part once, as the
smallest id's; the others of 50 words or more are removed whole, as the smallest id has all their
windows. The starts of a row's repeated windows merge into maximal intervals.

Hot passages: groupings keep only least ids, which are pre-aggregated; elections, windows and
least ids are tables of their own, so the joins back read two plain exchanges with unique keys
on one side, and Spark can split the other.

Defined results: a null text has no words; a row with a null id neither loses words nor
makes others lose them; rows of one id, repeated or not, take nothing from one another;
texts of fewer words than a window stay; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

WINDOW = 50
RUN = 12
_RUN_BASE = 0xD1342543DE82EF95
_BASE, _BASE2 = 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25

_KEY, _FIRST, _AT, _STARTS = "__bindery_key", "__bindery_first", "__bindery_at", "__bindery_starts"


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = common.word_spans(data)
    return data, starts, ends, common.word_hashes(data, starts, ends)


def elected(words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run, and for each window the position of the run that it elects."""
    runs = common.window_hashes(words, run, _RUN_BASE)
    width = window - run + 1
    if len(runs) < width:
        return runs, np.zeros(0, np.int64)
    out, n = [], len(runs) - width + 1
    for a in range(0, n, 1 << 15):
        seen = np.lib.stride_tricks.sliding_window_view(runs[a : a + (1 << 15) + width - 1], width)[: min(1 << 15, n - a)]
        out.append(seen.argmin(axis=1) + np.arange(a, a + len(seen)))
    return runs, np.concatenate(out)


def _elections(batches, window: int, run: int):
    """key, text -> the distinct elected runs of each text."""
    for batch in batches:
        keys, found, at = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), common.texts_of(batch)):
            runs, chosen = elected(_words(text)[3], window, run)
            if len(chosen):
                where = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
                found.append(runs[where])
                at.append(where)
                keys.append(np.full(len(where), key, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(at).astype(np.int32))], ["run", "key", "at"])


def _windows(batches, text_col: str, id_col: str, window: int, run: int):
    """Rows with the positions of their repeated runs -> the windows that elected one of them."""
    for batch in batches:
        name = batch.schema.get_field_index
        parts = []
        for doc_id, key, at, text in zip(batch.column(name(id_col)).to_pylist(), batch.column(name(_KEY)).to_pylist(), batch.column(name(_AT)), common.texts_of(batch, text_col)):
            words = _words(text)[3]
            _, chosen = elected(words, window, run)
            live = np.zeros(len(words), bool)
            live[np.asarray(at.values)] = True
            starts = np.flatnonzero(live[chosen])
            h1 = common.window_hashes(words, window, _BASE)[starts].view(np.int64)
            h2 = (common.window_hashes(words, window, _BASE2)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            parts.append((h1, h2, np.full(len(starts), doc_id, np.int64), np.full(len(starts), key, np.int64), starts.astype(np.int32)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(5)], ["h1", "h2", "doc_id", "key", "start"])


def _removed(n_words: int, window: int, doc_id: int, first: int | None, starts: list[int] | None) -> np.ndarray:
    """A mask of the words that go."""
    if first is not None and first < doc_id and n_words >= window:
        return np.ones(n_words, bool)
    edge = np.zeros(n_words + 1, np.int64)
    if starts is not None and len(starts):
        at = np.unique(np.asarray(starts, np.int64))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _applied(batches, text_col: str, id_col: str, window: int, columns: list[str]):
    """The rows without the removed words, and n_words, n_removed.

    A text that loses nothing stays as it is; else the words kept are joined by the white space
    that stood before each of them."""
    for batch in batches:
        name = batch.schema.get_field_index
        texts, n_words, n_removed = [], [], []
        for doc_id, first, starts, text in zip(batch.column(name(id_col)).to_pylist(), batch.column(name(_FIRST)).to_pylist(), batch.column(name(_STARTS)), common.texts_of(batch, text_col)):
            data, a, b, _ = _words_only(text)
            gone = _removed(len(a), window, doc_id, first, starts.values if starts.is_valid else None)
            n_words.append(len(a))
            n_removed.append(int(gone.sum()))
            if n_removed[-1]:
                text = _kept_text(data, a, b, ~gone)
            texts.append(text)
        out = [pa.array(texts, pa.string()) if c == text_col else batch.column(name(c)) for c in columns]
        yield pa.RecordBatch.from_arrays([*out, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*columns, "__n_words", "__n_removed"])


def _words_only(text: str):
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return (data, *common.word_spans(data), None)


def _kept_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> str:
    """Runs of kept words as they stand in the text, each run after the first with the white space before it."""
    edge = np.diff(np.concatenate(([0], keep.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    raw, out = data.tobytes(), []
    for k, (f, g) in enumerate(zip(first.tolist(), last.tolist())):
        out.append(raw[(int(ends[f - 1]) if f else 0) if k else int(starts[f]) : int(ends[g])])
    return b"".join(out).decode("utf-8", "surrogatepass")


def substring_dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, without repeated windows, and __n_words, __n_removed.

    Row keys are the id and a hash of the text, so rows of one id may differ."""
    columns = docs.columns
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).withColumn(_KEY, F.xxhash64(text_col))
    elections = usable.select(F.col(_KEY).alias("key"), F.col(text_col).alias("text")).mapInArrow(partial(_elections, window=window, run=run), "run long, key long, at int")
    found = common.written(elections, "elections")
    # A table of its own, so that the join reads two plain exchanges and Spark can split a hot run.
    twice = common.written(found.groupBy("run").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("run"), "twice")
    hits = common.written(found.join(twice, "run").groupBy("key").agg(F.collect_set("at").alias(_AT)), "runs")
    common.dropped(found, twice)
    same = F.struct(F.octet_length(text_col).alias("n"), F.crc32(F.col(text_col).cast("binary")).alias("c"))
    rows = common.written(usable.select(F.col(id_col).cast("long").alias("doc_id"), F.col(_KEY).alias("key"), same.alias("same")), "rows")
    first = common.written(rows.groupBy("key", "same").agg(F.min("doc_id").alias("first")), "first")
    rows = rows.join(first, ["key", "same"]).select("doc_id", "key", "first").distinct()
    renamed = lambda df: df.withColumnsRenamed({"doc_id": id_col, "key": _KEY, "first": _FIRST})
    # Two texts of one key, which are as good as never met, keep the smaller first: only a copy of it can have it as its id.
    firsts = rows.where("doc_id = first").join(hits, "key").select(F.col("doc_id").alias(id_col), F.col("key").alias(_KEY), _AT)
    kinds = StructType.fromDDL("h1 long, h2 int, doc_id long, key long, start int")
    live = common.written(usable.join(firsts, [id_col, _KEY]).mapInArrow(partial(_windows, text_col=text_col, id_col=id_col, window=window, run=run), kinds), "windows")
    least = live.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least")
    repeated = live.join(common.written(least, "least"), ["h1", "h2"]).where("doc_id > least")
    starts = repeated.groupBy(F.col("doc_id").alias(id_col), F.col("key").alias(_KEY)).agg(F.collect_set("start").alias(_STARTS))
    marks = renamed(rows).join(starts, [id_col, _KEY], "left")
    joined = usable.join(marks, [id_col, _KEY], "left").select(*columns, _FIRST, _STARTS)
    schema = StructType([*docs.schema.fields]).add("__n_words", "long").add("__n_removed", "long")
    done = joined.mapInArrow(partial(_applied, text_col=text_col, id_col=id_col, window=window, columns=columns), schema)
    rest = docs.where(F.col(id_col).isNull() | F.col(text_col).isNull())
    return done.unionByName(rest.mapInArrow(partial(_untouched, text_col=text_col), schema))


def _untouched(batches, text_col: str):
    for batch in batches:
        n = [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in common.texts_of(batch, text_col)]
        yield batch.append_column("__n_words", pa.array(n, pa.int64())).append_column("__n_removed", pa.array([0] * len(n), pa.int64()))


def _digests(batches):
    for batch in batches:
        said = [hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).hexdigest() for t in common.texts_of(batch)]
        keep = batch.select(["doc_id", "__n_words", "__n_removed"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(said, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(common.id_and_text(common.documents(spark, sf_dir)))
    return done.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def oracle_sql(window: int = WINDOW) -> str:
    """The same rows by SQL, for small tables: every window as its words."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    h AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
    f AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
    x AS (SELECT h.r, h.i FROM h JOIN f USING (k) WHERE least < h.doc_id),
    g AS (SELECT DISTINCT r, i + j AS p FROM x, (SELECT unnest(range({window})) AS j)),
    words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN g USING (r, p) GROUP BY r),
    gone AS (SELECT r, count(*) AS n FROM g GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)"""
