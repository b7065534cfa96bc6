"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives statistics (sizes, shares of kinds of characters, repetition, compression),
transformed by logarithms and logits towards normal shapes. Class sums and sums of products over
all labelled rows give means and covariances, which are shrunk towards the pooled
covariance and its mean variance. The score is the logistic of the difference of the
classes' Mahalanobis log-densities, with the Cholesky factors kept in the model.

Defined results: null and empty texts have the statistics of no words and a score like any
other; a null id is not held out and is not learnt from; if a label is missing from
the rows to learn from, every score is the share of label 1 (0.5 without any rows).
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learning

TO_POOLED = 0.3
TO_SPHERE = 0.05
_LETTER_CLASS = np.zeros(256, np.int8)  # 1 upper, 2 lower, 3 digit, 4 sentence marks, 5 other signs, 6 white space
for _b in range(256):
    _c = chr(_b)
    _LETTER_CLASS[_b] = 6 if _b in b" \t\n\r\x0b\x0c" else 1 if _b < 128 and _c.isupper() else 2 if _b < 128 and _c.islower() else 3 if _b < 128 and _c.isdigit() else 4 if _c in ".,;:?'\"-" and _b < 128 else 5 if 32 < _b < 127 else 0
_NAMES = ("log_words", "log_word_chars", "distinct_words", "top_word", "bigrams_twice", "upper", "digits", "marks", "signs", "exclaims", "bars", "compressed", "lines_twice", "log_line", "long_word", "lone_words", "repeat_word")
N_FEATURES = len(_NAMES)


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5))) if whole >= part else 0.0


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    counts = np.bincount(_LETTER_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) if raw else np.zeros(7, int)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    pairs = set(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = int(counts[1] + counts[2])
    return [
        float(np.log1p(n)),
        float(np.log1p((len(raw) - int(counts[6])) / max(1, n))),
        _logit(len(kinds), n),
        _logit(max(kinds.values(), default=0), n),
        _logit(max(0, n - 1 - len(pairs)), max(0, n - 1)),
        _logit(int(counts[1]), letters),
        _logit(int(counts[3]), size),
        _logit(int(counts[4]), size),
        _logit(int(counts[5]), size),
        _logit(raw.count(b"!"), size),
        _logit(raw.count(b"|"), size),
        float(np.log((len(zlib.compress(raw, 1)) + 20) / (len(raw) + 20))),
        _logit(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(len(raw) / max(1, len(lines)))),
        float(np.log1p(max(map(len, words), default=0))),
        _logit(sum(1 for v in kinds.values() if v == 1), len(kinds)),
        _logit(sum(map(bytes.__eq__, words, words[1:])), max(0, n - 1)),
    ]


def _features(batches):
    for batch in batches:
        rows = np.array([statistics(t) for t in common.texts_of(batch)], np.float64).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def _moments(batches):
    """Of each label in the task: rows, sums and sums of products."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column(0).to_pylist(), np.float64)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = np.asarray(batch.column(1))
            for k in np.unique(y):
                own = x[y == k]
                sums[int(k)] = sums.get(int(k), 0) + own.T @ own
    for k, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * s.size, pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(s.ravel())], ["label", "cell", "value"])


class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of two classes."""

    def __init__(self, moments: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE):
        n = {k: m[0, 0] for k, m in moments.items()}
        self.share = n.get(1, 0) / sum(n.values()) if n else 0.5
        self.classes = None
        if set(n) != {0, 1} or min(n.values()) < 2:
            return
        means = {k: m[0, 1:] / n[k] for k, m in moments.items()}
        scatter = {k: m[1:, 1:] - n[k] * np.outer(means[k], means[k]) for k, m in moments.items()}
        pooled = sum(scatter.values()) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        z = np.outer(self.scale, self.scale)
        self.classes = []
        for k in (0, 1):
            c = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
            c = c / z
            c = (1 - to_sphere) * c + to_sphere * np.eye(len(c)) * np.trace(c) / len(c)
            factor = np.linalg.cholesky(c)
            self.classes.append((means[k] / self.scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n[k] / sum(n.values()))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        density = [prior - 0.5 * (log_det + (((x / self.scale - mean) @ inverse.T) ** 2).sum(axis=1)) for mean, inverse, log_det, prior in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def _scored(batches, model: Discriminant):
    for batch in batches:
        x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])


def fit(features: DataFrame, labels: DataFrame, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """From all labelled rows: what the tasks send are 18 x 18 sums for each class."""
    rows = features.join(labels, "doc_id").select("x", "label").where("label in (0, 1)")
    cells = rows.mapInArrow(_moments, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    moments: dict[int, np.ndarray] = {}
    for r in cells:
        moments.setdefault(r.label, np.zeros((N_FEATURES + 1, N_FEATURES + 1))).flat[r.cell] = r.value
    return Discriminant(moments, to_pooled, to_sphere)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, out: int = 1, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row. labels: doc_id, quality."""
    features = common.written(common.id_and_text(docs, id_col, text_col).mapInArrow(_features, "doc_id long, x array<double>"), "statistics")
    model = fit(features, learning.labels_of(labels, "quality", modulus, out))
    scored = features.mapInArrow(partial(_scored, model=model), "doc_id long, score double")
    return scored.select("doc_id", learning.held_out(modulus, out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
