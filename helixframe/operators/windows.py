"""Copy number over fixed, sliding, listed and adaptive windows.

Bases: contig, pos, depth, obsexp, expected, for callable positions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.stats import safe_div
from helixframe.operators.intervals import interval_join, union_intervals, valid_windows, windows_of
from helixframe.operators.prefix import BLOCK, rank_rows


def _sums(grouped, ploidy: int, size: Column | None) -> DataFrame:
    s = grouped.agg(F.count(F.lit(1)).alias("mappable"), F.sum("depth").alias("_cov"), F.sum("obsexp").alias("_obs"), F.sum("expected").alias("_exp"), *([F.max("_size").alias("_size")] if size is None else []))
    wide = F.col("_size") if size is None else size
    counts = safe_div(F.col("_cov"), safe_div(F.col("_obs"), F.col("mappable"))) * safe_div(wide.cast("double"), F.col("mappable"))
    cn = safe_div(F.lit(float(ploidy)) * F.col("_cov"), F.col("_exp"))
    return s.withColumn("counts", counts).withColumn("cn", cn).drop("_cov", "_obs", "_exp", "_size")


def fixed_windows(bases: DataFrame, contigs: DataFrame, size: int, offset: int, fraction: float, ploidy: int = 2) -> DataFrame:
    """Windows k*offset..+size that end before the contig does and are callable enough; others are left out."""
    k = F.explode(windows_of(F.col("pos"), size, offset)) if offset < size else F.expr(f"pos div {offset}")
    at = bases.select("contig", "pos", "depth", "obsexp", "expected", k.alias("_k"))
    if offset > size:
        at = at.filter(F.col("pos") < F.col("_k") * offset + size)
    out = _sums(at.groupBy("contig", "_k"), ploidy, F.lit(size))
    out = out.withColumn("start", F.col("_k") * offset).withColumn("end", F.col("start") + size)
    out = out.join(F.broadcast(contigs.select("contig", "length")), "contig").filter((F.col("end") < F.col("length")) & (F.col("mappable") >= fraction * size))
    return out.select("contig", "start", "end", "mappable", "counts", "cn")


def bed_windows(bases: DataFrame, intervals: DataFrame, contigs: DataFrame, fraction: float, ploidy: int = 2, bucket: int = 1 << 14) -> DataFrame:
    """Each listed interval; those not callable enough have nulls."""
    listed = valid_windows(intervals.dropDuplicates(["contig", "start", "end"]), contigs, strict=False).withColumn("_size", F.col("end") - F.col("start"))
    out = _sums(interval_join(bases, listed, bucket).groupBy("contig", "start", "end"), ploidy, None)
    out = listed.drop("_size").join(out, ["contig", "start", "end"], "left")
    enough = F.coalesce(F.col("mappable"), F.lit(0)) >= fraction * (F.col("end") - F.col("start"))
    hide = lambda c: F.when(enough, F.col(c)).alias(c)
    return out.select("contig", "start", "end", F.coalesce("mappable", F.lit(0)).alias("mappable"), hide("counts"), hide("cn"))


def adaptive_windows(bases: DataFrame, size: int, offset: int, ploidy: int = 2, block: int = BLOCK) -> DataFrame:
    """Windows of `size` callable bases, `offset` callable bases apart; an incomplete last one is dropped.

    The first starts at 0; window w starts right after the callable base before its first one.
    """
    ranked = rank_rows(bases, block=block)
    k = F.explode(windows_of(F.col("rank"), size, offset))
    at = ranked.withColumn("_k", k).filter(F.col("rank") < F.col("_k") * offset + size)
    s = at.groupBy("contig", "_k").agg(F.count(F.lit(1)).alias("mappable"), F.sum("depth").alias("_cov"), F.sum("obsexp").alias("_obs"), F.sum("expected").alias("_exp"), F.max("pos").alias("_last")).filter(F.col("mappable") == size)
    before = ranked.filter((F.col("rank") + 1) % offset == 0).select("contig", ((F.col("rank") + 1) / offset).cast("long").alias("_k"), (F.col("pos") + 1).alias("_start"))
    s = s.join(before, ["contig", "_k"], "left")
    start = F.when(F.col("_k") == 0, F.lit(0).cast("long")).otherwise(F.col("_start"))
    end = F.col("_last") + 1
    counts = safe_div(F.col("_cov"), safe_div(F.col("_obs"), F.col("mappable")))
    out = s.withColumn("start", start).withColumn("end", end).withColumn("counts", counts)
    return out.select("contig", "start", "end", "mappable", "counts", safe_div(F.lit(float(ploidy)) * F.col("_cov"), F.col("_exp")).alias("cn"))


def bed_adaptive_windows(bases: DataFrame, intervals: DataFrame, contigs: DataFrame, size: int, offset: int, ploidy: int = 2, bucket: int = 1 << 14, block: int = BLOCK) -> DataFrame:
    """Adaptive windows over the union of the intervals; a start that equals an interval's end moves to the next interval's start."""
    merged = union_intervals(valid_windows(intervals, contigs, strict=False))
    inside = interval_join(bases, merged.select("contig", "start", "end"), bucket).drop("start", "end")
    out = adaptive_windows(inside, size, offset, ploidy, block)
    order = Window.partitionBy("contig").orderBy("start")
    moves = merged.select("contig", F.col("end").alias("start"), F.lead("start").over(order).alias("_to")).filter("_to is not null")
    first = merged.groupBy("contig").agg(F.min("start").alias("_first"))
    out = out.join(F.broadcast(first), "contig").join(moves, ["contig", "start"], "left")  # one row a contig
    start = F.when(F.col("start") == 0, F.col("_first")).otherwise(F.coalesce("_to", "start")).cast("long")
    return out.withColumn("start", start).select("contig", "start", "end", "mappable", "counts", "cn")


def scale_variance(bases: DataFrame, contigs: DataFrame, minsize: int, ploidy: int = 2, fraction: float = 0.0, most: int = 1_000_000) -> DataFrame:
    """(ws, dev, n): for windows of minsize * 2**i, the sum of squared deviations of copy number from ploidy and their number.

    The finest level's sums are rolled up level by level; bases are read once.
    """
    fine = bases.groupBy("contig", F.expr(f"pos div {minsize}").alias("_w")).agg(F.count(F.lit(1)).alias("mappable"), F.sum("depth").alias("_cov"), F.sum("expected").alias("_exp"))
    levels, ws = [], minsize
    while ws < most:
        levels.append(ws)
        ws *= 2
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("ws")) for i, w in enumerate(levels)]))
    up = fine.select("contig", "_w", "mappable", "_cov", "_exp", level.alias("l")).withColumn("_k", F.expr("shiftright(_w, l.i)"))
    per = up.groupBy("contig", "l.ws", "_k").agg(F.sum("mappable").alias("mappable"), F.sum("_cov").alias("_cov"), F.sum("_exp").alias("_exp"))
    per = per.join(F.broadcast(contigs.select("contig", "length")), "contig").filter(((F.col("_k") + 1) * F.col("ws") < F.col("length")) & (F.col("mappable") >= fraction * F.col("ws")) & (F.col("_exp") > 0))
    d = F.lit(float(ploidy)) * F.col("_cov") / F.col("_exp") - ploidy
    return per.groupBy("ws").agg(F.sum(d * d).alias("dev"), F.count(F.lit(1)).alias("n"))
