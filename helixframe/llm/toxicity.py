"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features: the n-grams of characters, ASCII letters in lower case and runs of ASCII
characters other than letters and digits as one space, hashed into 2**20 buckets; a document has a bucket or
not. For each bucket the log ratio of its smoothed rate in toxic and in clean
documents scales the feature; buckets whose ratio the sample doesn't support
(chi-square) are left out, as are the weaker ones beyond a set number. Logistic regression with an L2 penalty weighs what
remains; a toxic row counts ``POSITIVE`` times, as clean ones are many more. Each n-gram length has its own share of the buckets.
Scores are calibrated to the fixed ``LIMIT``: every training row is scored by a fit on the other
folds of the training rows, the cut is where the smaller of precision and recall of these scores is
largest, and the intercept moves so that the cut scores ``LIMIT``.

Fitting takes at most about ``MAX_ROWS`` labelled documents (a documented
bound; whole texts) in one task. Scoring is a pass over whole texts.

Nulls: a null or empty text scores the intercept, equal texts alike; rows that repeat
an id are scored by their own texts. Without labelled rows of both
kinds every score is the share of toxic ones, or 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.labelled import remainder, training_rows

MAX_ROWS = 10_000
SIZES = (4, 5, 6, 7)
BITS = 20
#: Buckets kept: those that reach CHI_SQUARE, and of them the strongest MOST_KEPT.
CHI_SQUARE, MOST_KEPT = 12.0, 4000
#: Texts that must hold a bucket.
LEAST_TEXTS = 3
#: Weight of a toxic row in the fit, against 1 of a clean one.
POSITIVE = 4.0
LIMIT = 0.7
#: Folds of the training rows for the calibration, which needs so many rows of each kind.
FOLDS, LEAST_ROWS = 4, 8


def characters(text: str) -> np.ndarray:
    """Code points with the blank runs as one, one before and one behind; none for a text of blanks."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    c = np.where((c >= 65) & (c <= 90), c + 32, c)
    blank = ~(((c >= 48) & (c <= 57)) | ((c >= 97) & (c <= 122)) | (c >= 128))
    c = np.r_[32, np.where(blank, 32, c), 32].astype(np.uint32)
    return c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]


def gram_buckets(text: str, sizes=SIZES, bits=BITS) -> np.ndarray:
    """The bucket of every n-gram of the text, repeats included."""
    b = characters(text)
    out, h = [], b.copy()
    for n in range(2, max(sizes) + 1):
        if b.size < n:
            break
        h = h[:-1] * np.uint32(0x01000193)
        h += b[n - 1 :]
        if n in sizes:
            mixed = (h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def held(text: str, wanted: np.ndarray) -> np.ndarray:
    """The distinct buckets of the text among those that wanted marks."""
    h = gram_buckets(text)
    return np.unique(h[wanted[h]])


@dataclass
class Model:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.buckets] = self.weights
        return w


def strongest(with_it: np.ndarray, clean: np.ndarray, good: int, n: int) -> np.ndarray:
    """The buckets that a fit keeps, from the number of toxic and clean rows of its n that hold each."""
    both = with_it + clean
    expected = both * good / n
    chi = (with_it - expected) ** 2 / np.maximum(expected * (1 - both / n), 1e-9) * (n / (n - good))
    kept = np.flatnonzero((chi >= CHI_SQUARE) & (both >= LEAST_TEXTS))
    return np.sort(kept[np.argsort(-chi[kept], kind="stable")[:MOST_KEPT]])


def useful_buckets(texts: list[str], labels: np.ndarray, fold: np.ndarray | None = None) -> list[np.ndarray]:
    """Each text's distinct buckets among those that the fit on all rows keeps, or that on all but one fold: all that these fits use."""
    fold = np.zeros(labels.size, np.int64) if fold is None else fold
    every, counts = np.ones(1 << BITS, bool), np.zeros((int(fold.max(initial=0)) + 1, 2, 1 << BITS), np.int32)
    for t, k, y in zip(texts, fold, labels):
        counts[k, int(y > 0), held(t, every)] += 1
    total, wanted = counts.sum(axis=0, dtype=np.int64), np.zeros(1 << BITS, bool)
    for k in (None, *range(len(counts))):
        rows, left = (labels, total) if k is None else (labels[fold != k], total - counts[k])
        good = int(rows.sum())
        if good not in (0, rows.size):
            wanted[strongest(left[1].astype(float), left[0].astype(float), good, rows.size)] = True
    return [held(t, wanted) for t in texts]


def fit(texts: list[str], labels: np.ndarray, **settings) -> Model:
    return fit_buckets(useful_buckets(texts, labels), labels, **settings)


def fit_buckets(found: list[np.ndarray], labels: np.ndarray, steps: int = 150, penalty: float = 2e-3, positive: float = POSITIVE) -> Model:
    """found: useful_buckets() of the rows."""
    n, good = labels.size, int(labels.sum())
    if good in (0, n):
        share = min(max(good / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0, np.float32))
    with_it, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for f, y in zip(found, labels):
        (with_it if y else clean)[f] += 1
    p, q = (with_it + 0.5) / (good + 1), (clean + 0.5) / (n - good + 1)
    kept = strongest(with_it, clean, good, n)
    ratio = np.log(p / q)[kept]
    place, wanted = np.full(1 << BITS, -1, np.int64), np.zeros(1 << BITS, bool)
    place[kept], wanted[kept] = np.arange(kept.size), True
    row, col = [], []
    for i, f in enumerate(found):
        f = place[f[wanted[f]]]
        row.append(np.full(f.size, i))
        col.append(f)
    row, col = np.concatenate(row), np.concatenate(col)
    x = ratio[col]
    share = np.where(labels > 0, positive, 1.0)
    share /= share.mean()
    w, bias = np.zeros(kept.size), float(np.log(positive * good / (n - good)))
    # Accelerated gradient steps; the curvature bound comes from a few power iterations.
    v = np.ones(max(kept.size, 1))[: kept.size]
    top = 1.0
    for _ in range(15):
        u = np.bincount(col, x * np.bincount(row, x * v[col], n)[row], kept.size) if kept.size else v
        top = max(float(np.linalg.norm(u)), 1e-9)
        v = u / top
    rate = 1 / (0.25 * share.max() * (top + n) / n + penalty)
    w_old, b_old = w, bias
    for k in range(steps):
        m = k / (k + 3)
        wy, by = w + m * (w - w_old), bias + m * (bias - b_old)
        z = np.bincount(row, x * wy[col], n) + by
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        w_old, b_old = w, bias
        w = wy - rate * (np.bincount(col, x * g[row], kept.size) / n + penalty * wy)
        bias = by - rate * g.mean()
    return Model(float(bias), kept, (w * ratio).astype(np.float32))


def balanced_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """Where the smaller of precision and recall of z >= cut is largest: the middle between the scores on both sides of the best cuts."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(labels[order])
    ends = np.flatnonzero(np.r_[z[1:] != z[:-1], True])  # equal scores stay together
    worth = np.minimum(hits[ends] / (ends + 1), hits[ends] / max(hits[-1], 1))
    best = ends[worth >= worth.max() - 1e-12]
    below = z[min(best[-1] + 1, z.size - 1)]
    return float((z[best[0]] + below) / 2)


def fit_calibrated(texts: list[str], labels: np.ndarray, folds: int = FOLDS) -> Model:
    """fit() with the intercept moved to the cut found on scores of rows that their fit didn't see."""
    good = int(labels.sum())
    if min(good, labels.size - good) < LEAST_ROWS:
        return fit(texts, labels)
    z = np.zeros(labels.size)
    fold = np.zeros(labels.size, np.int64)
    for kind in (0, 1):  # each fold has its share of both
        at = np.flatnonzero(labels == kind)
        fold[at] = np.arange(at.size) % folds
    found = useful_buckets(texts, labels, fold)
    model = fit_buckets(found, labels)
    for f in range(folds):
        one = fit_buckets([x for x, k in zip(found, fold) if k != f], labels[fold != f])
        weights = one.dense()
        for i in np.flatnonzero(fold == f):
            z[i] = one.bias + float(weights[found[i][weights[found[i]] != 0]].sum())
    model.bias += float(np.log(LIMIT / (1 - LIMIT))) - balanced_cut(z, labels)
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    rows = training_rows(docs, labels, "toxic", 3, 1, max_rows, 41)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        all_rows = pd.concat(got).sort_values("doc_id")
        m = fit_calibrated(all_rows["text"].tolist(), all_rows["label"].to_numpy(np.float64))
        yield pd.DataFrame({"bias": [m.bias], "buckets": [m.buckets.astype(np.int32).tobytes()], "weights": [m.weights.tobytes()]})

    found = rows.repartition(1).mapInPandas(run, "bias double, buckets binary, weights binary").collect()
    if not found:
        return Model(-20.0, np.zeros(0, np.int64), np.zeros(0, np.float32))
    return Model(found[0]["bias"], np.frombuffer(found[0]["buckets"], np.int32).astype(np.int64), np.frombuffer(found[0]["weights"], np.float32))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1; docs must have text. A column of that name gives way."""
    docs = docs.drop(name)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        weights = model.dense()
        wanted = weights != 0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                z = np.array([model.bias + float(weights[held(t.as_py() or "", wanted)].sum()) for t in part.column(at)], np.float64)
                s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    d = docs.select("doc_id", "text")
    out = score(d, train(d, labels, max_rows))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without those that score LIMIT or more; all other columns stay, whatever their names."""
    name = "_toxic_score"
    while name in docs.columns:
        name += "_"
    out = score(docs, train(docs.select("doc_id", "text"), labels, max_rows), name)
    return out.filter(F.col(name) < LIMIT).drop(name)
