"""The curve of coverage by stratum (GC content) and its bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.stats import safe_div


def _shares(df: DataFrame) -> DataFrame:
    """Adds frac_s, frac_r, pct_s, pct_r and obsexp from sample and reference, along gc."""
    whole, run = Window.partitionBy(), Window.orderBy("gc").rowsBetween(Window.unboundedPreceding, 0)  # one row a stratum
    total = {c: F.sum(c).over(whole) for c in ("sample", "reference")}
    share = {c: F.coalesce(safe_div(F.col(c), total[c]), F.lit(0.0)) for c in total}
    part = {c: F.coalesce(safe_div(F.sum(c).over(run), total[c]), F.lit(0.0)) for c in total}
    out = df.select("*", share["sample"].alias("frac_s"), share["reference"].alias("frac_r"), part["sample"].alias("pct_s"), part["reference"].alias("pct_r"))
    return out.withColumn("obsexp", F.coalesce(safe_div(F.col("frac_s"), F.col("frac_r")), F.lit(1.0)))


def curve(bases: DataFrame, n_strata: int) -> DataFrame:
    """bases (gc, depth) that are unique and lie in selected windows -> one row for every gc from 0 to n_strata - 1."""
    per = bases.groupBy("gc").agg(F.sum("depth").alias("sample"), F.count(F.lit(1)).alias("reference"))
    every = bases.sparkSession.range(n_strata).select(F.col("id").cast("int").alias("gc"))
    full = every.join(per, "gc", "left").select("gc", F.coalesce("sample", F.lit(0)).cast("long").alias("sample"), F.coalesce("reference", F.lit(0)).cast("long").alias("reference"))
    full = full.withColumn("coverage", F.coalesce(safe_div(F.col("sample"), F.col("reference")), F.lit(0.0)))
    return _shares(full)


def bounds(curve_: DataFrame, percentile: float) -> DataFrame:
    """One row (low, high): the last gc below the percentile and the first above its complement, both exclusive bounds."""
    p = F.lit(percentile).cast("float").cast("double")
    below = (F.col("pct_s") < p) | (F.col("pct_r") < p)
    above = (F.col("pct_s") + p > 1) | (F.col("pct_r") + p > 1)
    out = curve_.agg(F.coalesce(F.max(F.when(below, F.col("gc"))), F.lit(0)).alias("low"), F.coalesce(F.min(F.when(above, F.col("gc"))), F.count(F.lit(1)).cast("int")).alias("high"))
    return out.select("low", F.when(F.col("low") >= F.col("high"), F.col("low") + 1).otherwise(F.col("high")).alias("high"))


def renormalised(curve_: DataFrame, low: int, high: int) -> DataFrame:
    """Shares taken anew inside (low, high); outside they are 0 and obsexp 1. Coverage stays."""
    inside = _shares(curve_.filter((F.col("gc") > low) & (F.col("gc") < high)).select("gc", "sample", "reference")).drop("sample", "reference")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return curve_.select("gc", "sample", "reference", "coverage").join(inside, "gc", "left").select("gc", "sample", "reference", "coverage", *[zero(c, 0.0) for c in ("frac_s", "frac_r", "pct_s", "pct_r")], zero("obsexp", 1.0))


def with_expected(bases: DataFrame, curve_: DataFrame) -> DataFrame:
    """Callable bases (contig, pos, gc, depth) with what the curve says of their gc: obsexp and expected, its coverage. The curve has a row a gc value."""
    return bases.join(F.broadcast(curve_.select("gc", "obsexp", F.col("coverage").alias("expected"))), "gc").select("contig", "pos", F.coalesce("depth", F.lit(0)).alias("depth"), "obsexp", "expected")


def scaled_shares(curve_: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """For plots: within a range of relative gc, sample scaled so that it sums to the reference, and the ratio of both."""
    size = F.max("gc").over(Window.partitionBy())
    mid = curve_.withColumn("share", F.col("gc") / size).filter((F.col("share") > low) & (F.col("share") < high))
    whole = Window.partitionBy()
    scaled = F.col("sample") * safe_div(F.sum("reference").over(whole), F.sum("sample").over(whole))
    return mid.select("gc", "share", "reference", scaled.alias("scaled_sample")).withColumn("bias", safe_div(F.col("scaled_sample"), F.col("reference")))
