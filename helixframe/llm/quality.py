"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Document statistics (shares of character kinds, word and line shapes, repetition)
are standardised; random Fourier features approximate a Gaussian kernel over
them; each partition sums its part of the normal equations, and the sums are added
and solved for ridge scores. Rows kept out of that fit give the isotonic map
from scores to the probability of label 1.

Fitting takes at most about ``MAX_ROWS`` labelled documents (a documented
bound; whole texts). Scoring is one pass over whole texts.

Nulls: a null text counts as empty; an empty text has all statistics zero and is scored
like any other. Without labelled rows of both kinds every score is the share of label 1, or 0.5.
Rows that repeat an id are scored by their own texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialize
from helixframe.llm.labelled import remainder, training_rows

MAX_ROWS = 20_000
FEATURES, GAMMA, RIDGE, SEED = 384, 0.06, 1e-3, 7
#: Tasks that sum the normal equations, and slices in which their sums are added.
PARTS, SLICES = 8, 16
LIMIT = 0.7

_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 other ASCII, 5 beyond ASCII, 6 line end, 7 sentence end
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 5
_KIND[[32, 9, 11, 12, 13]], _KIND[10], _KIND[[46, 44, 63, 59, 58]] = 3, 6, 7
NAMES = [
    "log_bytes", "lower", "upper", "digit", "blank", "other", "beyond", "line_end", "sentence_end", "word_length", "word_spread", "long_words", "one_letter",
    "distinct_words", "distinct_lines", "log_line", "bars", "bangs", "marked_words", "top_word", "capital_words", "distinct_pairs", "log_words", "common_other",
]


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    b = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[b], minlength=8) / n
    words = text.split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ends = sum(1 for w in words if _KIND[w[-1]] == 4)
    capital = sum(1 for w in words if 65 <= w[0] <= 90)
    other = b[_KIND[b] == 4]
    most_other = np.bincount(other, minlength=1).max() / n if other.size else 0.0
    return [
        np.log1p(n), *kinds[[0, 1, 2, 3, 4, 5, 6, 7]], sizes.mean(), sizes.std(), (sizes > 20).mean(), (sizes == 1).mean(), len(counts) / m, len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)), text.count(b"|") / m, text.count(b"!") / m, ends / m, max(counts.values(), default=0) / m, capital / m,
        len(set(zip(words, words[1:]))) / max(len(words) - 1, 1), np.log1p(m), most_other,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.size:
            return np.full(len(x), float(self.levels[0]))
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """Cosines of random projections, and 1."""
    rng = np.random.default_rng(SEED)
    w, phase = rng.normal(0, np.sqrt(2 * GAMMA), (len(NAMES), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip(z, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators -> knots and non-decreasing levels. Ends are smoothed by half a row of each kind."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    level = [(s + 0.5 * (s / n)) / (n + 0.5) if 0 < s < n else (s + 0.5) / (n + 1) for s, n, _, _ in blocks]
    level = np.maximum.accumulate(level)
    return np.array([v for b in blocks for v in b[2:]]), np.repeat(level, 2)


def _statistics_of(rows: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([statistics((t or "").encode()) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    x = materialize(_statistics_of(training_rows(docs, labels, "quality", 4, 2, max_rows, 43)), "quality-statistics")
    sums = [f(F.col("x")[i]) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    n, share, *moments = x.agg(F.count(F.lit(1)), F.avg("label"), *sums).first()
    if not n or share in (0.0, 1.0):
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.array([0.5 if not n else share]))
    mean, scale = np.array(moments[::2]), np.maximum(np.array(moments[1::2]), 1e-6)
    for_levels = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(4)) == 0
    size = FEATURES + 1

    upper = np.triu_indices(size + 1)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((size + 1, size + 1))
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                rows = pdf.iloc[lo : lo + 2048]
                f = np.c_[fourier((np.stack(rows["x"].to_list()) - mean) / scale), rows["label"].to_numpy(np.float64)]
                a += f.T @ f
        cuts = np.array_split(a[upper], SLICES)
        yield pd.DataFrame({"slice": range(SLICES), "v": [c.tobytes() for c in cuts]})

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    # One triangle a partition; executors add them slice by slice, so SLICES rows come back, of one triangle in all.
    parts = x.filter(~for_levels).coalesce(PARTS).mapInPandas(part, "slice int, v binary")
    sums = parts.groupBy("slice").applyInPandas(added, "slice int, v binary").orderBy("slice").collect()
    a = np.zeros((size + 1, size + 1))
    a[upper] = np.concatenate([np.frombuffer(r["v"]) for r in sums])
    a, b = a[:size, :size] + np.triu(a[:size, :size], 1).T, a[:size, size]
    rows = max(a[-1, -1], 1.0)
    weights = np.linalg.solve(a + RIDGE * rows / size * np.eye(size), b)
    model = Model(mean, scale, weights, np.zeros(0), np.zeros(0))
    kept = x.filter(for_levels).orderBy("doc_id").select("label", "x").toPandas()  # a quarter of the bounded sample
    if not len(kept):
        kept = x.orderBy("doc_id").select("label", "x").toPandas()
    model.knots, model.levels = isotonic(model.raw(np.stack(kept["x"].to_list())), kept["label"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                x = np.array([statistics((t or "").encode()) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(x))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def quality_report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    out = score(docs, train(docs, labels, max_rows))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
