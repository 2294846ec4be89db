"""Mixing sources to target weights.

Tokens are summed by source; a source's share of the budget follows its weight
but stops at ``cap`` times its own size, and what it can't take goes to the
others by weight (water-filling, in closed form over prefix sums). A document
is then emitted floor(rate) times and once more with probability equal to the
fraction, by a seeded hash of its id, so that reruns agree.

Nulls: a null text has no words and a null source is a source of its own, last
in order. A null id is hashed as "~". Rows that repeat an id share one decision. A
source without words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, unit_hash

#: The table of sources is broadcast up to so many rows and bytes of names; beyond, it is joined by shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 50_000, 4_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=(5.0, 2.0, 1.0), ratio: float = 1.0, cap: float = 3.0) -> DataFrame:
    """totals (source, source_size) -> with weight and target. One row a source; windows run over those only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    row = totals.withColumn("_rank", F.row_number().over(by_name))
    row = row.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    row = row.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    row = (
        row.withColumn("_n", F.row_number().over(by_cap))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_spent", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(ratio)))
        .withColumn("_weights", F.sum("weight").over(whole))
    )
    row = row.withColumn("_level", (F.col("_budget") - F.col("_capped")) / (F.col("_weights") - F.col("_spent")))
    first = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct("_n", "_level"))).over(whole)
    row = row.withColumn("_level", first["_level"])
    target = F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("weight")), F.col("_cap"))
    return row.select("source", "source_size", "weight", target.alias("target"))


def plan_mix(sizes: DataFrame, weights=(5.0, 2.0, 1.0), ratio: float = 1.0, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """sizes (doc_id, source, size, ...) -> with source_size, weight, target and copies."""
    totals = materialize(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ratio, cap), "mix-targets")
    n, names = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    t = totals.select(F.col("source").alias("_source"), "source_size", "weight", "target")
    t = F.broadcast(t) if n <= BROADCAST_SOURCES and names <= BROADCAST_BYTES else t
    out = sizes.join(t, sizes["source"].eqNullSafe(t["_source"]), "inner").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(unit_hash(seed, F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long"))


def mix_sources(docs: DataFrame, weights=(5.0, 2.0, 1.0), ratio: float = 1.0, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: docs' columns, each row as often as its copies say. Whatever else docs holds is carried along."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), whole.alias("_row"))
    planned = plan_mix(sizes, weights, ratio, cap, seed).filter(F.col("copies") > 0)
    return planned.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def mixing_report(docs: DataFrame, **kw) -> DataFrame:
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")  # texts are read once
    return plan_mix(sizes, **kw).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
