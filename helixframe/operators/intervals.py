"""Interval sets and joins of points with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_intervals(df: DataFrame, block: int = 1 << 22) -> DataFrame:
    """contig, start, end -> disjoint intervals; those that touch are joined.

    An interval begins an island if it starts beyond all ends before it: those of its block of starts, and the largest of
    earlier blocks, which is one row a block. Islands are counted in the same two steps.
    """
    cut = df.select("contig", "start", "end").withColumn("_block", F.expr(f"start div {block}"))
    within = Window.partitionBy("contig", "_block").orderBy("start", "end")
    blocks = Window.partitionBy("contig").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy("contig", "_block").agg(F.max("end").alias("_most")).select(F.col("contig").alias("_c"), F.col("_block").alias("_b"), F.max("_most").over(blocks).alias("_far"))
    reach = F.greatest(F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    marked = cut.join(per, (F.col("contig") == F.col("_c")) & (F.col("_block") == F.col("_b"))).drop("_c", "_b")
    marked = marked.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    counts = marked.groupBy("contig", "_block").agg(F.sum("_new").alias("_n")).select(F.col("contig").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias("_base"))
    # Intervals of one start have one number, whichever of them began the island.
    upto = Window.partitionBy("contig", "_block").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("_within", F.sum("_new").over(upto)).join(counts, (F.col("contig") == F.col("_c")) & (F.col("_block") == F.col("_b")))
    islands = placed.groupBy("contig", (F.col("_base") + F.col("_within")).alias("_island"))
    return islands.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def bucketed(intervals: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Each interval once for every bucket that it reaches into."""
    return intervals.filter(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"({end} - 1) div {width}"))))


def interval_join(points: DataFrame, intervals: DataFrame, width: int, pos: str = "pos", how: str = "inner") -> DataFrame:
    """points (contig, pos, ...) with the intervals (contig, start, end, ...) that hold them, by buckets of `width`: an equi-join, never a nested loop."""
    p = points.withColumn("_bucket", F.expr(f"{pos} div {width}"))
    i = bucketed(intervals, width).withColumnsRenamed({"contig": "_contig", "_bucket": "_reached"})
    on = (F.col("contig") == F.col("_contig")) & (F.col("_bucket") == F.col("_reached")) & (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end"))
    return p.join(i, on, how).drop("_contig", "_bucket", "_reached")


def tiles(contigs: DataFrame, size: int, offset: int | None = None, strict: bool = True) -> DataFrame:
    """contig, length -> windows [k*offset, k*offset+size); with strict, those that end before the contig's end, else up to it."""
    offset = offset or size
    last = F.col("length") - size - (1 if strict else 0)
    fit = contigs.filter(last >= 0)
    start = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(offset).cast("long")))
    return fit.select("contig", start.alias("start")).withColumn("end", F.col("start") + size)


def windows_of(pos: Column, size: int, offset: int) -> Column:
    """Numbers k of all windows [k*offset, k*offset+size) that hold pos."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((pos - size + 1) / offset))
    return F.sequence(first, F.floor(pos / offset))


def valid_windows(intervals: DataFrame, contigs: DataFrame, strict: bool) -> DataFrame:
    """Intervals with start < end within their contig; strict ones end before its end."""
    both = intervals.join(F.broadcast(contigs.select("contig", "length")), "contig")
    inside = F.col("end") < F.col("length") if strict else F.col("end") <= F.col("length")
    return both.filter((F.col("start") < F.col("end")) & inside).drop("length")
