"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A text is parsed against it: the longest
match from the current place on is a phrase, and the next one begins behind it; a character that
was never seen is a phrase of its own. Phrases run across words. The language that needs the fewest
phrases, normalised by the logarithm of its training size and by the characters parsed, wins.
Text is lower case, and what is no letter is one space between words.

Texts are parsed in blocks of BLOCK characters, where a phrase ends too, whatever the text's length.
All blocks of a batch go through all automata together, one character at a time: the
transitions are one table of pairs of state and character (byte_pairs.PairTable).

Learning takes stretches of EXCERPT characters, at a hashed place, of about SAMPLE texts a language by
a hash of the id, up to TRAIN_CHARS characters a language, and TOTAL_CHARS shared by all languages:
however many there are, each is learnt and can be predicted. That bound is all that reaches
the driver, beside one row for each language.

Defined results: a null text and one without a letter is und with score 0; a null id is
neither held out nor learnt from; without anything to learn from every text is und. Ties go to the
language that comes first in the alphabet.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, learning
from .byte_pairs import PairTable
from .encoder import grouped

SAMPLE = 400
EXCERPT = 400
TRAIN_CHARS = 100_000
TOTAL_CHARS = 4_000_000
BLOCK = 512


class SuffixAutomaton:
    """All substrings of the added words, by the construction of Blumer and others."""

    def __init__(self, words):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for w in words:
            last = 0
            for c in w:
                last = self._extend(last, c)

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse; a character that was never seen is one of its own."""
        nxt, state, n, open_ = self.next, 0, 0, False
        for c in text:
            to = nxt[state].get(c)
            if to is None and open_:
                n, state, open_ = n + 1, 0, False
                to = nxt[0].get(c)
            if to is None:
                n += 1
            else:
                state, open_ = to, True
        return n + open_


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def plain(text: str) -> str:
    """Lower-case letters, and one space for what is between words, before and behind them."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


class Languages:
    """The automata of all languages in one table; the states of a language begin at its root."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        self.cost = np.array([np.log2(2 + sum(map(len, texts[x]))) for x in self.names])
        letters = sorted(set().union(*(set(t) for x in texts.values() for t in x), {" "}))
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.size = np.uint64(len(letters) + 1)
        # What each code point is: -1 no letter, 0 a letter that was never seen, else its number.
        self.kind = np.array([0 if chr(c).isalpha() else -1 for c in range(0x110000)], np.int32)
        for c, k in number.items():
            if c != " ":
                self.kind[ord(c)] = k
        self.space = number[" "]
        roots, keys, values, base = [], [], [], 0
        for x in self.names:
            automaton = SuffixAutomaton(texts[x])
            roots.append(base)
            for state, to in enumerate(automaton.next):
                for c, t in to.items():
                    keys.append((base + state) * int(self.size) + number[c])
                    values.append(base + t)
            base += len(automaton.next)
        self.roots = np.array(roots, np.int64)
        self.table = PairTable(np.array(keys, np.uint64), np.array(values, np.int64), -1) if keys else None
        every = np.arange(int(self.size), dtype=np.uint64)
        self.first = self.table.get((self.roots.astype(np.uint64)[:, None] * self.size + every).ravel()).reshape(len(roots), -1) if keys else None

    def codes(self, text: str) -> np.ndarray:
        """The numbers of plain(text); of no letters nothing."""
        kind = self.kind[_points(text.lower())]
        kind = np.concatenate(([-1], kind, [-1]))
        keep = (kind >= 0) | np.concatenate(([True], kind[:-1] >= 0))
        out = kind[keep]
        if len(out) < 2:
            return out[:0]
        out[out < 0] = self.space
        return out

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each block in each language. blocks: rows of numbers, the longest first."""
        n, langs = len(blocks), len(self.names)
        count = np.zeros((langs, n), np.int32)
        state = np.repeat(self.roots[:, None], n, axis=1)
        open_ = np.zeros((langs, n), bool)
        columns = np.ascontiguousarray(blocks.T)
        for k in range(int(lengths[0]) if n else 0):
            m = int(np.searchsorted(-lengths, -k, "left"))  # the blocks that are longer than k
            c = columns[k, :m]
            to = self.table.get((state[:, :m].astype(np.uint64) * self.size + c.astype(np.uint64)).ravel()).reshape(langs, m)
            miss = to < 0
            count[:, :m] += miss & open_[:, :m]  # the phrase ends, and the next begins here
            fresh = self.first[:, c]
            to = np.where(miss, fresh, to)
            never = to < 0
            count[:, :m] += never
            state[:, :m] = np.where(never, self.roots[:, None], to)
            open_[:, :m] = ~never
        return (count + open_).T

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [self.codes(t) if t and self.names else np.zeros(0, np.int32) for t in texts]
        owner, at, size = [], [], []
        for k, x in enumerate(found):
            for a in range(0, len(x), BLOCK):
                owner.append(k)
                at.append(a)
                size.append(min(BLOCK, len(x) - a))
        bits = np.zeros((len(texts), len(self.names)))
        if owner:
            order = np.argsort(-np.array(size), kind="stable")
            lengths = np.array(size)[order]
            blocks = np.zeros((len(order), BLOCK), np.int32)
            for row, j in enumerate(order.tolist()):
                blocks[row, : size[j]] = found[owner[j]][at[j] : at[j] + size[j]]
            np.add.at(bits, np.array(owner)[order], self.phrases(blocks, lengths))
        out = []
        for x, row in zip(found, bits):
            if not len(x):
                out.append(("und", 0.0))
                continue
            row = row * self.cost / len(x)  # the cross entropy, in bits a character
            best = int(row.argmin())
            out.append((self.names[best], float(1 / np.exp2((row[best] - row) * 4).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


_models: dict[int, Languages] = {}


def _model(texts: dict[str, list[str]]) -> Languages:
    """The automata of this process, built once for what they are built from."""
    key = hash(tuple((k, tuple(v)) for k, v in sorted(texts.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Languages(texts)
    return _models[key]


def _predicted(batches, texts: dict[str, list[str]]):
    model = _model(texts)
    for batch in batches:
        said = []
        for group in grouped((t or "" for t in common.texts_of(batch)), most=1 << 22):
            said += model.predict_all(group)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["doc_id", "lang_pred", "score"])


def learn(docs: DataFrame, modulus: int, out: int, sample: int = SAMPLE, excerpt: int = EXCERPT, train_chars: int = TRAIN_CHARS, total_chars: int = TOTAL_CHARS) -> dict[str, list[str]]:
    """Plain text to learn each language from. docs: doc_id, text, lang."""
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(common.fold(F.col("doc_id"), modulus) != out)
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    least = min(train_chars, max(1, total_chars // len(sizes)))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in sizes.items()], "lang string, share double")
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    begin = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.lit(1), F.length("text") - excerpt + 1)) + 1
    taken = usable.withColumn("place", place).join(F.broadcast(shares), "lang").where("place < share").select("lang", "place", F.col("text").substr(begin.cast("int"), F.lit(excerpt)).alias("text"))
    ahead = Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, -1)
    kept = taken.withColumn("ahead", F.coalesce(F.sum(F.length("text")).over(ahead), F.lit(0))).where(F.col("ahead") < least)
    texts: dict[str, list[str]] = {k: [] for k in sizes}
    for r in kept.select("lang", "place", F.col("text").substr(F.lit(1), F.lit(least) - F.col("ahead").cast("int")).alias("text")).collect():
        texts[r.lang].append((r.place, plain(r.text)))
    return {k: [t for _, t in sorted(v)] for k, v in texts.items()}


def language_scores(docs: DataFrame, modulus: int = 5, out: int = 0, sample: int = SAMPLE, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = learn(rows, modulus, out, sample, train_chars=train_chars)
    said = rows.select("doc_id", "text").mapInArrow(partial(_predicted, texts=texts), "doc_id long, lang_pred string, score double")
    return said.select("doc_id", learning.held_out(modulus, out).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(common.documents(spark, sf_dir))
