"""Choosing labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, unit_hash


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(by))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, by: int, held: int, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents whose crc32 remainder is not the held one: all, or about max_rows by a seeded hash.

    Rows without id or label don't count; of labels that differ for one id the
    largest holds, and of texts that share an id the first in order. The chosen
    labels, at most max_rows ids and a few more, are broadcast.
    """
    lab = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(remainder(F.col("doc_id"), by) != held)
    lab = lab.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    n = lab.count()
    if n > max_rows:
        lab = lab.filter(unit_hash(seed, F.col("doc_id")) < max_rows / n)
    chosen = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
    chosen = chosen.groupBy("doc_id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    return materialize(chosen, "training-rows")
