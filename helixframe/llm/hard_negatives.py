"""Hard negatives: for each anchor and positive, the closest rows of another label within limits of the positive's score.

Components become integers, so that scores are exact and ties are real ties. A
stated set of anchors meets all rows in blocks: a task scores a block of anchors
against a block of rows with one matrix product, sorts each anchor's scores in full (lexsort by
score, then id) and reads off its entries; blocks' few best are merged per anchor.
Two rounds: the first finds the positives, the second binary-searches each
positive's upper limit in the sorted scores and reads different-label entries
down to the lower limit. Scores are computed again in the second round rather
than stored, as they are many and a product is cheap. Rows are dealt to blocks by a hash
of the whole row, so no label or id makes a block large. Each block of rows goes to
every block of anchors: the copies grow with the anchors, ``ANCHORS`` a copy.

Nulls: rows with a null id or label, a null vector, or a null or non-finite component take no
part. Vectors of unequal length are compared as if the shorter ended in zeros.
Repeated ids are separate rows; among equal scores and ids the order is by a
hash of label, vector and copy. Fewer positives or negatives than wanted: all there are;
an anchor without any gives no row. An empty table gives an empty result.
Components beyond 2**53 / 256, or scores beyond 63 bits, raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import materialize

SCALE = 256
ANCHORS, ROWS = 1024, 8192
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score that a negative's must reach, and may not exceed.
LOW, HIGH = 30, 90


def integer_rows(embeddings: DataFrame, scale: int = SCALE, shifted: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, q, mark), written once: the rows that take part. Labels of ids divisible by ``shifted`` move on by one."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    e = e.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", sound))
    label = F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    q = F.transform("v", lambda x: F.floor(x * float(scale)))
    same = e.select("vec_id", label.alias("label"), q.alias("q")).groupBy("vec_id", "label", "q").agg(F.count(F.lit(1)).alias("n"))
    each = same.select("vec_id", "label", "q", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return materialize(each.select("vec_id", "label", "q", F.xxhash64("label", "q", "copy").alias("mark")), "negatives-rows")


def matrix(vectors) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with the rows of b."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    bound = int(max(a.max(initial=0), -a.min(initial=0))) * int(max(b.max(initial=0), -b.min(initial=0))) * max(d, 1)
    if bound >= 1 << 63:
        raise ArithmeticError("scores exceed 63 bits")
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def sorted_scores(anchors: pd.DataFrame, rows: pd.DataFrame):
    """For each anchor: (its place, order of the rows by falling score and rising id, their scores in that order)."""
    scores = products(matrix(anchors["q"].tolist()), matrix(rows["q"].tolist()))
    place = np.empty(len(rows), np.int64)
    place[np.lexsort((rows["mark"].to_numpy(), rows["vec_id"].to_numpy()))] = np.arange(len(rows))
    for i in range(len(anchors)):
        order = np.lexsort((place, -scores[i]))
        yield i, order, scores[i][order]


def _best_positives(k: int):
    def run(key, anchors, rows):
        ids, marks, labels = (rows[c].to_numpy() for c in ("vec_id", "mark", "label"))
        out = []
        for i, order, score in sorted_scores(anchors, rows):
            a = anchors.iloc[i]
            same = (labels[order] == a["label"]) & ~((ids[order] == a["vec_id"]) & (marks[order] == a["mark"]))
            out += [(a["vec_id"], a["mark"], ids[order[j]], marks[order[j]], score[j]) for j in np.flatnonzero(same)[:k]]
        return pd.DataFrame(out, columns=["anchor_id", "anchor_mark", "positive_id", "positive_mark", "positive_score"])

    return run


def _best_negatives(k: int, low: int, high: int):
    def run(key, anchors, rows):
        ids, marks, labels = (rows[c].to_numpy() for c in ("vec_id", "mark", "label"))
        out = []
        for i, order, score in sorted_scores(anchors, rows):
            a, down, other = anchors.iloc[i], -score, None
            for p in a["positives"]:
                most, least = high * p["positive_score"] // 100, -(-low * p["positive_score"] // 100)
                start, end = np.searchsorted(down, -most, "left"), np.searchsorted(down, -least, "right")
                if start >= end:
                    continue
                if other is None:
                    other = np.flatnonzero(labels[order] != a["label"])
                lo = np.searchsorted(other, start)
                for j in other[lo : lo + k]:
                    if j >= end:
                        break
                    out.append((a["vec_id"], a["mark"], p["positive_id"], p["positive_mark"], p["positive_score"], ids[order[j]], marks[order[j]], score[j]))
        return pd.DataFrame(out, columns=["anchor_id", "anchor_mark", "positive_id", "positive_mark", "positive_score", "negative_id", "negative_mark", "negative_score"])

    return run


def _first(df: DataFrame, key: list[str], what: str, k: int) -> DataFrame:
    """The k rows of each key with the highest <what>_score, numbered in rank."""
    by = Window.partitionBy(*key).orderBy(F.desc(f"{what}_score"), f"{what}_id", f"{what}_mark")
    return df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_block: int = ANCHORS, row_block: int = ROWS) -> DataFrame:
    """rows: integer_rows(). Anchors are those with vec_id divisible by every. (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    anchors = rows.filter(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    a_blocks, r_blocks = max(1, -(-n_anchors // anchor_block)), max(1, -(-n_rows // row_block))
    dealt = F.xxhash64("vec_id", "mark")
    key = ["_a", "_r"]
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.withColumn("_r", F.pmod(dealt, F.lit(r_blocks)).cast("int")).withColumn("_a", every_block(a_blocks)).groupBy(*key)
    spread = lambda a: a.withColumn("_a", F.pmod(dealt, F.lit(a_blocks)).cast("int")).withColumn("_r", every_block(r_blocks)).groupBy(*key)

    pair = f"anchor_id {kind}, anchor_mark long, positive_id {kind}, positive_mark long, positive_score long"
    found = spread(anchors).cogroup(right).applyInPandas(_best_positives(positives), pair)
    found = _first(found, ["anchor_id", "anchor_mark"], "positive", positives)
    per = found.groupBy("anchor_id", "anchor_mark").agg(F.collect_list(F.struct("positive_id", "positive_mark", "positive_score")).alias("positives"))
    with_them = anchors.join(per.withColumnsRenamed({"anchor_id": "vec_id", "anchor_mark": "mark"}), ["vec_id", "mark"])
    with_them = materialize(with_them.select("vec_id", "label", "q", "mark", "positives"), "negatives-anchors")

    triple = f"{pair}, negative_id {kind}, negative_mark long, negative_score long"
    out = spread(with_them).cogroup(right).applyInPandas(_best_negatives(negatives, low, high), triple)
    out = _first(out, ["anchor_id", "anchor_mark", "positive_id", "positive_mark"], "negative", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def negatives_report(embeddings: DataFrame, **settings) -> DataFrame:
    return hard_negatives(integer_rows(embeddings), **settings)
