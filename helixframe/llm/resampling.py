"""Resampling documents towards a target distribution by hashed n-gram importance weights.

Features are all runs of 1 to 3 words, hashed by CRC-32 into ``BUCKETS`` buckets.
Both corpora are counted whole, a partition's counts summed before they are
shuffled; the two count arrays give each bucket a gain, and a pass over the
texts sums the gains of a document's features from that array (its size is the
fixed number of buckets). Seeded Gumbel noise, in whole numbers, turns the
weights into scores whose highest ranks are a draw without replacement.

The draw is exact and sorts no documents that can't be drawn: documents are counted by their integer score,
suffix sums over the distinct scores (in blocks) tell how many documents precede each
score, the cutoff is the last score whose offset is below the number wanted,
and only documents at surviving scores are numbered, by id within their score.

A score's group can't be hot by equal texts: the noise depends on the id and spreads them; about 1 in 2,700 documents of one weight share a score.

Nulls: a null or empty text has no features, weight 0; a null doc_id has the
noise of the text ``42:`` and comes after the others in a tie. Rows that repeat an id take
one rank each. Empty tables: without documents an empty result; without a
target every count t is 0. Words may be of any length; texts are read in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import materialize
from helixframe.operators.prefix import running_sum

BUCKETS = 10_000
SEED = 42
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: ASCII other than letters and digits separates words; A-Z are lower-cased; bytes of other letters stay.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def feature_buckets(text: bytes, buckets: int = BUCKETS, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them), piece by piece."""
    folded, at, before = text.translate(FOLD), 0, []
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        new = folded[at:end].split()
        at = end
        if not new:
            continue
        words, k = before + new, len(before)
        rest = [b" " + w for w in words[1:]]
        one = list(map(crc32, words))
        two = list(map(crc32, rest, one))
        three = list(map(crc32, rest[1:], two))
        runs = (one[k:], two[max(k - 1, 0) :], three[max(k - 2, 0) :])
        yield len(new), np.fromiter(chain(*runs), np.uint32, sum(map(len, runs))) % buckets
        before = words[-2:]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features a bucket over all texts."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                for _, found in feature_buckets(t.as_py() or b"", buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    per = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in per.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed rates, rounded down."""
    n, s_all, t_all = source.size, int(source.sum()), int(target.sum())
    ratio = [(float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, rounded down."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row a document."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))

    def weigh(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                n = features = weight = 0
                for new, found in feature_buckets(t.as_py() or b"", buckets):
                    n, features, weight = n + new, features + found.size, weight + int(gain[found].sum())
                rows.append((n, features, weight))
            cols = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", kind.dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(weigh, schema)
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, ... for the drawn ones, null for the rest. scored is read several times: write it first."""
    enough = F.col("n_words") >= least_words
    hist = materialize(scored.filter(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score-counts")
    total, low, high = hist.agg(F.sum("n"), F.min("score"), F.max("score")).first()
    wanted = (total or 0) * percent // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    # A block holds at most its width of distinct scores, however many documents have them.
    width = max(1, -(-(high - low + 1) // 4096))
    placed = hist.select("score", "n", F.lit(0).alias("_all"), (F.lit(high) - F.col("score")).alias("_down"))
    offsets = running_sum(placed, "n", "through", key="_all", pos="_down", block=width).select("score", (F.col("through") - F.col("n")).alias("offset"))
    offsets = materialize(offsets.filter(F.col("offset") < wanted), "score-offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    top = scored.filter(enough & (F.col("score") >= cutoff)).join(offsets, "score").withColumn("rank", (F.col("offset") + within).cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    rest = scored.filter(~enough | (F.col("score") < cutoff)).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest)


def resampling_report(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    scored = materialize(importance(docs.select("doc_id", "text"), target.select("text"), buckets, seed), "importance")
    return draw(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents with all their columns. A row is found again by its id; rows that share an id are kept if one of them is drawn."""
    chosen = resampling_report(docs, target, **settings).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_drawn"]), "left_semi")
