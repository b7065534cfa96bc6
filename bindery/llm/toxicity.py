"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learnt from the labelled rows: those found in
toxic texts far more often than in others, weighted by the lower bound of the log odds of their
document counts. Features of a text: hits of the lexicon and its strongest entries by word, their
nearness to words of the second person, capitals, exclamation and question marks, and obfuscated
words (signs or digits between letters, stretched letters). What is told of a word is told
once and kept; a text is then sums over its words.

No row meets a lexicon or a calibration that has seen its own label: rows are dealt into FOLDS
parts by a hash of the id. A row's features for learning come from the lexicon of the other
parts, trees of logistic loss are grown on quantile bins of the other parts' rows to give its raw
score, and the isotonic calibration is fitted on those scores. The model that scores has the lexicon
and the trees of all labelled rows.

Learning takes about SAMPLE labelled rows by a hash of the id; that bound is what
reaches the driver, beside LEXICON entries for each part. Every row is scored, and over its whole text.

Defined results: null and empty texts have features of no words and a score like any other;
a null id is not held out and not learnt from; with one label or none to learn from, the score is
the share of label 1 (0 without any rows).
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learning

SAMPLE = 20_000
LEXICON = 400
FOLDS = 4
LEAST_DOCS = 4
#: The least lower bound of an entry's log odds, and the standard errors that it is below them.
LEAST_ODDS = 2.0
ERRORS = 1.64
PREFIXES = (4, 5)
#: Second-person words of the four languages that occur, fixed.
SECOND_PERSON = frozenset("you your yours yourself tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su du dich dir dein deine ihr euch euer sie ihnen".split())
NEAR = 5
N_FEATURES = 14
_EDGE = ".,;:!?\"'()[]{}…«»¿¡"
_INSIDE = re.compile(r"[^\W\d_][*@$#0-9!|_.\-]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
#: Words that a worker keeps.
_KEPT = 300_000


def _core(word: str) -> str:
    return word.strip(_EDGE)


def entries(word: str) -> list[str]:
    """What the lexicon can hold of a word: itself, and its beginnings as prefixes."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Words:
    """What is told of each word: its weight, and whether it is of the second person, shouted, or obfuscated.

    Most words are nothing of these and have number 0."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.numbers, self.rows, self.known = lexicon, {}, [(0.0,) * 5], {(0.0,) * 5: 0}

    def _told(self, word: str) -> tuple:
        core = _core(word.lower())
        weight = max((self.lexicon.get(e, 0.0) for e in entries(core)), default=0.0)
        plain = word.isalpha()
        inside = 0 if plain else len(_INSIDE.findall(word))
        return weight, float(core in SECOND_PERSON), float(len(word) > 2 and word.isupper()), float(inside), float(bool(_STRETCHED.search(word)))

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.numbers) > _KEPT:
            self.numbers = {}
        numbers = self.numbers
        for w in set(words).difference(numbers):
            row = self._told(w)
            k = self.known.get(row)
            if k is None:
                k = self.known[row] = len(self.rows)
                self.rows.append(row)
            numbers[w] = k
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def features(text: str | None, told: Words) -> list[float]:
    text = text or ""
    words = text.split()
    codes = told.codes(words)
    at = np.flatnonzero(codes)
    rows = np.array([told.rows[k] for k in codes[at].tolist()], np.float64).reshape(-1, 5)
    weight, second = rows[:, 0], rows[:, 1] > 0
    hits, persons = at[weight > 0], at[second]
    near = np.searchsorted(persons, hits + NEAR, "right") > np.searchsorted(persons, hits - NEAR, "left")
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    if len(data) > 1:
        low = data[1:]
        upper += int(((data[:-1] == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)).sum())
    total, m = float(weight.sum()), max(1, len(words))
    return [
        float(np.log1p(len(words))),
        float(len(hits)),
        1000 * len(hits) / m,
        total,
        1000 * total / m,
        float(weight.max(initial=0.0)),
        float(near.sum()),
        1000 * float(second.sum()) / m,
        upper / max(1, sum(map(len, words))),
        float(rows[:, 2].sum()) / m,
        text.count("!") / m,
        text.count("?") / m,
        float(rows[:, 3].sum()) / m,
        float(rows[:, 4].sum()) / m,
    ]


class Trees:
    """Boosted regression trees of logistic loss, grown on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            grow, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            at, tree = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                splits = []
                for leaf in range(1 << level):
                    rows = np.flatnonzero(at == leaf)
                    splits.append(self._split(binned[rows], grow[rows], hess[rows]))
                tree.append(splits)
                column = np.array([s[0] for s in splits])[at]
                cut = np.array([s[1] for s in splits])[at]
                at = 2 * at + (binned[np.arange(len(y)), column] > cut)
            n = 1 << self.depth
            values = self.rate * np.bincount(at, grow, n) / (np.bincount(at, hess, n) + self.ridge)
            self.trees.append((tree, values))
            f += values[at]
        return self

    def _split(self, b: np.ndarray, grow: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        best = (0.0, 0, self.bins + 1)  # all to the left
        if len(b) >= 2 * self.least:
            g, h = grow.sum(), hess.sum()
            for c in range(b.shape[1]):
                n = len(self.edges[c]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b[:, c], w, n))[:-1] for w in (grow, hess, np.ones(len(b))))
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                gain[(nl < self.least) | (len(b) - nl < self.least)] = 0
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), c, int(gain.argmax()))
        return best[1], best[2]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])
        f = np.full(len(x), self.base)
        for tree, values in self.trees:
            at = np.zeros(len(x), np.int64)
            for splits in tree:
                s = np.array(splits)[at]
                at = 2 * at + (binned[np.arange(len(x)), s[:, 0]] > s[:, 1])
            f += values[at]
        return f


class Isotonic:
    """Non-decreasing means of y along s, by pooling adjacent violators; linear between them."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # sum, rows, sum of s
        for a, b in zip(s[order].tolist(), y[order].tolist()):
            blocks.append([b, 1, a])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                for k in range(3):
                    blocks[-1][k] += last[k]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.value = np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])
        self.value = np.maximum.accumulate(self.value)
        return self

    def scores(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.at, self.value)


class Toxicity:
    """Trees and their calibration; a constant where there is nothing to tell apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, part: np.ndarray):
        self.share, self.trees = float(y.mean()) if len(y) else 0.0, None
        if len(set(y.tolist())) < 2:
            return
        self.trees = Trees().fit(x, y)
        raw = np.empty(len(y))
        for k in np.unique(part):
            mine = part == k
            others = self.trees if mine.all() else Trees().fit(x[~mine], y[~mine])
            raw[mine] = others.raw(x[mine])
        self.isotonic = Isotonic().fit(raw, y)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.trees is None else self.isotonic.scores(self.trees.raw(x))


def _part(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 >> 40) % FOLDS


def _found(batches):
    """doc_id, label, text -> the distinct lexicon candidates of each text."""
    for batch in batches:
        words, labels, parts = [], [], []
        for doc_id, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts_of(batch)):
            own = {e for w in set(text.lower().split()) if (c := _core(w)) for e in entries(c)} if text else ()
            words += own
            labels += [label] * len(own)
            parts += [_part(doc_id)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int64()), pa.array(parts, pa.int32())], ["entry", "label", "part"])


def lexicons(labelled: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """entry -> lower bound of its log odds of being in a toxic text: of all rows but each part's, and of all. labelled: doc_id, label, text."""
    rows = labelled.select("doc_id", "label", "text")
    number = [[0, 0] for _ in range(FOLDS)]
    for r in rows.select("doc_id", "label").mapInArrow(_parts_of, "part int, label long").groupBy("part").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        number[r.part] = [r.t, r.n]
    sums = [f(F.when(F.col("part") == k, x)).alias(f"{name}{k}") for k in range(FOLDS) for name, f, x in (("t", F.sum, F.col("label")), ("n", F.count, F.lit(1)))]
    every = [F.coalesce(f"t{k}", F.lit(0)) for k in range(FOLDS)]
    counts = rows.mapInArrow(_found, "entry string, label long, part int").groupBy("entry").agg(*sums)
    counts = common.written(counts.where(sum(every[1:], every[0]) >= LEAST_DOCS), "entries")
    out = []
    for left in range(FOLDS + 1):
        used = [k for k in range(FOLDS) if k != left]
        toxic, rest = float(sum(number[k][0] for k in used)), float(sum(number[k][1] - number[k][0] for k in used))
        t = sum((every[k] for k in used[1:]), every[used[0]])
        n = sum((F.col(f"n{k}") for k in used[1:]), F.col(f"n{used[0]}"))
        top = counts.select("entry", t.alias("t"), (n - t).alias("o")).where(F.col("t") >= LEAST_DOCS)
        odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (rest + 1))
        low = odds - F.lit(ERRORS) * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
        top = top.withColumn("low", low).where(F.col("low") >= LEAST_ODDS)
        out.append({r.entry: r.low for r in top.orderBy(F.desc("low"), "entry").limit(size).collect()})
    return out


def _parts_of(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_part(d) for d in batch.column(0).to_pylist()], pa.int32()), batch.column(1).cast(pa.int64())], ["part", "label"])


def _arrays(rows: list[list[float]]) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.array(rows, np.float64).ravel()), N_FEATURES).cast(pa.list_(pa.float64()))


def _featured(batches, lexicon: list[dict[str, float]]):
    """doc_id, label, text -> features by the lexicon of the other parts."""
    told = [Words(x) for x in lexicon]
    for batch in batches:
        rows = [features(t, told[_part(d)]) for d, t in zip(batch.column(0).to_pylist(), common.texts_of(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _arrays(rows)], ["doc_id", "label", "x"])


def _scored(batches, model: Toxicity, lexicon: dict[str, float]):
    told = Words(lexicon)
    for batch in batches:
        rows = np.array([features(t, told) for t in common.texts_of(batch)], np.float64).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows))], ["doc_id", "score"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, out: int = 2, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row. labels: doc_id, toxic."""
    rows = common.id_and_text(docs, id_col, text_col)
    known = learning.labels_of(labels, "toxic", modulus, out).where("label in (0, 1)")
    n = max(1, known.count())
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    # About sample ids, so of bounded size; half as many again can't be met by chance.
    chosen = F.broadcast(known.where(place < min(1.0, sample / n)).select("doc_id", "label").limit(sample + sample // 2))
    labelled = common.written(rows.join(chosen, "doc_id").select("doc_id", "label", "text"), "labelled")
    *others, lexicon = lexicons(labelled)
    got = labelled.mapInArrow(partial(_featured, lexicon=others), "doc_id long, label int, x array<double>").select("doc_id", "label", "x").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    x, y = np.array([r.x for r in got]).reshape(-1, N_FEATURES), np.array([r.label for r in got], np.float64)
    model = Toxicity(x, y, np.array([_part(r.doc_id) for r in got], np.int64))
    scored = rows.mapInArrow(partial(_scored, model=model, lexicon=lexicon), "doc_id long, score double")
    return scored.select("doc_id", learning.held_out(modulus, out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
