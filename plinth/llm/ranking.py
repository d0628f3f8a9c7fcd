"""Quality scores by Bradley-Terry pairwise ranking.

A preference pair is a document labelled good against one labelled bad; the
probability that the first is preferred is the logistic function of the
difference of their scores, scores are linear in text features, and the logistic
loss on feature differences is minimised by Newton steps in numpy on the driver.
Scores are turned into (0, 1) around a threshold that is a quantile of the scores
of the training sample: the share of bad labels in it.

Learning takes at most ``SAMPLE`` labelled rows, chosen by a hash of the id, and
``PAIRS`` pairs of them.  Everything else covers all rows and whole texts.

Null and empty texts have zero features and the score that belongs to them.
Labels without a document, and null labels, teach nothing; repeated label rows
count once each; of several texts under one id one teaches.  Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, free_name, held_out, map_batches, named, word_steps
from .rules import _LOWER, _NOT_TAIL, _SYMBOL, _UPPER, duplicate_lines, repeated_words

SAMPLE = 6000
PAIRS = 30_000

_byte = lambda chars: np.isin(np.arange(256), list(chars.encode()))
_MARKS, _BANG, _BAR, _DIGIT = _byte(".,;:?"), _byte("!"), _byte("|"), _byte("0123456789")

FEATURES = ["symbols", "bars", "bangs", "marks", "upper", "digits", "repeats", "doubled", "distinct", "lines", "same_lines", "length", "short_words", "long_words", "few", "other"]


def features(words: Words) -> np.ndarray:
    """(texts, FEATURES): shares and squashed counts, all between 0 and about 1."""
    data, n = words.data, np.maximum(words.counts, 1)
    share = lambda flags, of: words.per_doc(flags) / np.maximum(of, 1)
    chars = words.per_doc(words.inside & _NOT_TAIL[data])
    letters = words.per_doc(_UPPER[data] | _LOWER[data]) + words.per_doc(data >= 0xC0)
    lines, same = duplicate_lines(words)
    doubled = np.zeros(len(words), bool)
    doubled[1:] = (words.number[1:] == words.number[:-1]) & (words.doc[1:] == words.doc[:-1])
    _, index = np.unique(words.number * words.n_docs + words.doc, return_index=True)
    by_doc = lambda flags: np.bincount(words.doc[flags], minlength=words.n_docs) / n
    size = words.end - words.start
    columns = [
        share(_SYMBOL[data], chars) * 4,
        share(_BAR[data], n),
        share(_BANG[data], n),
        share(_MARKS[data], n),
        share(_UPPER[data], letters),
        share(_DIGIT[data], chars),
        repeated_words(words) / n,
        by_doc(doubled),
        np.bincount(words.doc[index], minlength=words.n_docs) / n,
        np.minimum(1, lines / n * 4),
        same / np.maximum(lines, 1),
        np.log1p(words.counts) / 10,
        by_doc(size <= 2),
        by_doc(size >= 12),
        1 / np.sqrt(n),
        1 - np.minimum(1, letters / np.maximum(chars, 1)),
    ]
    return np.stack(columns, 1).astype(np.float64)


def widen(x: np.ndarray) -> np.ndarray:
    """Features with their square roots and bounded steps, so that a linear score can bend."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), np.minimum(1, 10 * np.maximum(x, 0))], 1)


@dataclass
class Ranker:
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return widen(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold), -30, 30)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25, seed: int = 7) -> np.ndarray:
    """Weights that maximise the likelihood of good over bad in random pairs."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the wrong order
        gradient = d.T @ p / pairs - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Ranker:
    if not len(y) or y.min() == y.max():
        return Ranker(np.zeros(3 * len(FEATURES)), 0.0, 0.0)
    wide = widen(x)
    w = bradley_terry(wide[y == 1], wide[y == 0], pairs)
    scores = np.sort(wide @ w)
    bad = int((y == 0).sum())
    return Ranker(w, float((scores[bad - 1] + scores[bad]) / 2), 1.0)


def extract(docs: DataFrame, key: str, label: str, text: str = "text") -> DataFrame:
    """key, label and the features x."""
    schema = f"key {docs.schema[key].dataType.simpleString()}, y int, x array<double>"

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, last, words in word_steps(batch.column("text")):
            yield {"key": batch.column("key")[first:last], "y": batch.column("y")[first:last], "x": list(features(words))}

    return map_batches(docs.select(named(key).alias("key"), named(label).alias("y"), named(text).alias("text")), run, schema)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Ranker:
    """A ranker from labelled rows that are not held out.

    At most ``sample`` (document, label) pairs, each with the features of one of the
    texts that carry its id: the rows that reach the driver are bounded.
    """
    usable = labels.select(F.col("doc_id").alias("label_id"), named(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    # repeated labels count, so they are numbered; bounded, so it may be broadcast
    chosen = usable.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(sample).groupBy("label_id", "y").agg(F.count("*").alias("times"))
    # a text id may be no number: beside numbers, ids are compared as texts
    mixed = "string" in (kinds := {dict(t.dtypes)["doc_id"] for t in (docs, labels)}) and len(kinds) > 1
    same = F.col("doc_id").cast("string") == F.col("label_id").cast("string") if mixed else F.col("doc_id") == F.col("label_id")
    rows = docs.select(F.col("doc_id"), named(text).alias("text")).join(F.broadcast(chosen), same).select("doc_id", "y", "times", "text")
    found = extract(rows.withColumn("y", (F.col("times") * 2 + F.col("y")).cast("int")), "doc_id", "y")
    one = found.groupBy("key", "y").agg(F.min("x").alias("x")).collect()  # at most ``sample`` rows
    one = sorted((r.key, r.y & 1, tuple(r.x)) for r in one for _ in range(r.y >> 1))
    return fit(np.array([r[2] for r in one], np.float64).reshape(len(one), len(FEATURES)), np.array([r[1] for r in one], np.int64))


def score(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """doc_id and score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, last, words in word_steps(batch.column("text")):
            yield {"doc_id": batch.column("doc_id")[first:last], "score": ranker.score(features(words))}

    return map_batches(docs.select("doc_id", named(text).alias("text")), run, f"doc_id {kind}, score double")


def keep_documents(docs: DataFrame, ranker: Ranker, text: str = "text", least: float = 0.5) -> DataFrame:
    """Documents with a score of at least ``least``, all columns as they were."""
    name = free_name(docs.columns, "rank_score")

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        parts = [ranker.score(features(words)) for _, _, words in word_steps(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.select("*", scores(named(text)).alias(name)).where(named(name) >= least).drop(name)
