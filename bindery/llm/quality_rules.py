"""Quality rules: size, signs, repeated lines and words, and suffix-array repetition.

Repetition is found on word ids. A suffix array by prefix doubling (which stops as soon as all
suffixes differ) and its longest common prefixes give intervals of equal prefixes; each
interval that is not extendable to the left is a maximal repeated substring of its length.
Occurrences of repeats of MIN_REPEAT words or more are marked, and the union of the
spans is the covered part. A document is kept if the covered part is at most MAX_COVERED of
its words and no repeat is longer than MAX_REPEAT words.

Defined results: a null or empty text has no words, so it fails the base rule and is not
kept; a null id gives a null id; repeated rows give a row each; no rows give no rows.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MIN_REPEAT = 4
MAX_COVERED = 0.3
MAX_REPEAT = 100
_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes (with the predecessor; the first is 0)."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = codes.astype(np.int64)
    if rank.max() >= n:  # keys below need codes under n
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while True:
        following = np.zeros(n, np.int64)
        following[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        k *= 2
        levels.append(rank)
        if k >= n or rank[order[-1]] == n - 1:
            break
    # Common prefixes of neighbours, from the ranks of prefixes of 2**j words.
    a, b, length = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    common_words = np.zeros(n - 1, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        live = np.flatnonzero((a < n) & (b < n))
        same = live[levels[j][a[live]] == levels[j][b[live]]]
        # equal ranks at the text's end mean equal whole suffixes, which two neighbours never have
        a[same] += 1 << j
        b[same] += 1 << j
        common_words[same] += 1 << j
    length[1:] = common_words
    return order, length


def repeats(codes: np.ndarray, least: int = MIN_REPEAT) -> tuple[int, int]:
    """Words covered by repeated substrings of least words or more, and the longest repeat.

    Every suffix of an interval of common prefixes begins an occurrence of the interval's
    repeat; the longest one that begins there is its longer common prefix with a neighbour,
    so the union over maximal repeats is the union of these spans."""
    n = len(codes)
    if n < 2 * 1 or n < least + 1:
        return 0, 0
    order, lcp = suffix_array(codes)
    best = np.maximum(lcp, np.append(lcp[1:], 0))
    longest = int(best.max())
    if longest < least:
        return 0, longest
    span = np.zeros(n, np.int64)
    span[order] = best
    starts = np.flatnonzero(span >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + span[starts], -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), longest


def maximal_repeats(codes: np.ndarray, least: int = MIN_REPEAT) -> list[tuple[int, int, list[int]]]:
    """(words, occurrences, starts) of each maximal repeated substring, from the intervals of
    common prefixes, by a stack; left-extendable intervals are left out."""
    order, lcp = suffix_array(codes)
    found, stack = [], []
    lcp = lcp.tolist() + [0]
    for k in range(1, len(lcp)):
        begin = k - 1
        while stack and stack[-1][1] > lcp[k]:
            begin, words = stack.pop()
            where = order[begin:k]
            before = {int(codes[p - 1]) if p else -1 for p in where}
            if words >= least and (len(before) > 1 or -1 in before):
                found.append((words, len(where), sorted(where.tolist())))
        if lcp[k] > 0 and (not stack or stack[-1][1] < lcp[k]):
            stack.append((begin, lcp[k]))
    return sorted(found)


def measures(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d"))
    symbols = len(_SYMBOLS.findall(raw))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if b"\n" in raw else []
    dup_lines = len(lines) - len(set(lines))
    if not n:
        return n, chars, symbols, dup_lines, 0, 0, 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    repeated = 0
    covered = longest = 0
    if len(ids) < n:
        m = len(ids)
        if n >= 3:
            if m < 2_000_000:
                key = (codes[:-2] * m + codes[1:-1]) * m + codes[2:]
            else:
                pairs = np.unique(codes[:-1] * m + codes[1:], return_inverse=True)[1]
                key = pairs[:-1] * m + codes[2:]
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            at = np.flatnonzero(times[back] > 1)
            if len(at):
                hit = np.zeros(n, bool)
                hit[at] = hit[at + 1] = hit[at + 2] = True
                repeated = int(hit.sum())
        if repeated or n < 3:
            covered, longest = repeats(codes)
        else:
            longest = 1 if not _pair_twice(codes, m) else 2
    return n, chars, symbols, dup_lines, repeated, covered, longest


def _pair_twice(codes: np.ndarray, m: int) -> bool:
    pairs = codes[:-1] * m + codes[1:]
    return len(np.unique(pairs)) < len(pairs)


def verdict(m: tuple, max_covered: float, max_repeat: int) -> tuple[bool, bool]:
    """base_failed, kept."""
    n, repeated, covered, longest = m[0], m[4], m[5], m[6]
    failed = n < 50 or 100 * repeated > 50 * n
    return failed, not failed and covered <= max_covered * n and longest <= max_repeat


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def _measured(batches, max_covered: float, max_repeat: int):
    for batch in batches:
        rows = [measures(t) for t in common.texts_of(batch)]
        said = [verdict(m, max_covered, max_repeat) for m in rows]
        columns = [pa.array([m[k] for m in rows], pa.int64()) for k in range(7)]
        columns[5:5] = [pa.array([x[0] for x in said], pa.bool_()), pa.array([x[1] for x in said], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_NAMES[:5], "base_failed", "kept", *_NAMES[5:]])


def quality_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and verdicts of each row."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
    return common.id_and_text(docs, id_col, text_col).mapInArrow(partial(_measured, max_covered=max_covered, max_repeat=max_repeat), schema)


@common.lean
def _passing(batches, text_col: str, max_covered: float, max_repeat: int):
    for batch in batches:
        yield batch.filter(pa.array([verdict(measures(t), max_covered, max_repeat)[1] for t in common.texts_of(batch, text_col)], pa.bool_()))


def keep_good(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    return docs.mapInArrow(partial(_passing, text_col=text_col, max_covered=max_covered, max_repeat=max_repeat), docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.documents(spark, sf_dir)).drop("longest_repeat")


def oracle_sql(max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, least: int = MIN_REPEAT) -> str:
    """The query's rows by SQL. The words that repeats of least words or more cover are those of the
    runs of least words that occur twice; a repeat is too long if a longer run occurs twice."""
    word = r"[^\x20\x09-\x0D]+"

    def covered(name: str, n: int) -> str:
        return f"""{name}_at AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM
        (SELECT r, i, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d))),
      {name} AS (SELECT r, count(DISTINCT i + j) AS n FROM {name}_at, (SELECT unnest(range({n})) AS j) WHERE n > 1 GROUP BY r)"""

    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
      lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY r),
      {covered("threes", 3)},
      {covered("spans", least)},
      {covered("longest", max_repeat + 1)},
      m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
          CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
          CAST(coalesce(threes.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(spans.n, 0) AS BIGINT) AS n_covered_words, longest.n IS NOT NULL AS too_long
        FROM d LEFT JOIN lines USING (r) LEFT JOIN threes USING (r) LEFT JOIN spans USING (r) LEFT JOIN longest USING (r)),
      b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND n_covered_words <= CAST({max_covered} AS DOUBLE) * n_words AND NOT too_long AS kept, n_covered_words FROM b"""
