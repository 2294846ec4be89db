"""Scan windows: coverage by window and the choice of windows of normal copy number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.stats import median_mad, safe_div
from helixframe.operators.intervals import interval_join


def scan_bins(points: DataFrame, windows: DataFrame, size: int | None = None) -> DataFrame:
    """windows (contig, start, end) -> with cov and uniqcov. points: contig, pos, n, unique (the place counts as unique). size: windows tile their contigs by it."""
    if size:
        by = points.groupBy("contig", F.expr(f"pos div {size}").alias("_bin")).agg(F.sum("n").alias("cov"), F.sum(F.when(F.col("unique"), F.col("n")).otherwise(0)).alias("uniqcov"))
        out = windows.withColumn("_bin", F.expr(f"start div {size}")).join(by, ["contig", "_bin"], "left").drop("_bin")
    else:
        by = interval_join(points, windows, 1 << 14).groupBy("contig", "start", "end").agg(F.sum("n").alias("cov"), F.sum(F.when(F.col("unique"), F.col("n")).otherwise(0)).alias("uniqcov"))
        out = windows.join(by, ["contig", "start", "end"], "left")
    return out.withColumn("cov", F.coalesce("cov", F.lit(0)).cast("long")).withColumn("uniqcov", F.coalesce("uniqcov", F.lit(0)).cast("long"))


def scanned_contigs(contigs: DataFrame, coverage: DataFrame, least_length: int, sex: tuple[str, ...], enough: int) -> DataFrame:
    """Contigs to scan: not the sex chromosomes, and small ones only while earlier contigs hold no more than `enough` coverage. coverage: contig, cov."""
    c = contigs.filter(~F.col("contig").isin(*sex)).join(coverage, "contig", "left").withColumn("cov", F.coalesce("cov", F.lit(0)))
    # Small contigs that are left out add nothing, and what they would add only counts once they are over the limit.
    run = F.coalesce(F.sum("cov").over(Window.orderBy("tid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("_before", run).filter((F.col("length") >= least_length) | (F.col("_before") <= enough)).drop("_before", "cov")


def select_windows(bins: DataFrame, ratio: float, rescale_to: int | None = None, keep_all: bool = False) -> DataFrame:
    """bins with selected: unique enough, and coverage strictly within one MAD of the median of those."""
    if keep_all:
        return bins.withColumn("selected", F.lit(True))
    pre = bins.withColumn("_unique", F.coalesce(safe_div(F.col("uniqcov"), F.col("cov")), F.lit(0.0)) > ratio)
    if rescale_to:
        scale = F.lit(float(rescale_to)) / (F.col("end") - F.col("start"))
        pre = pre.withColumn("cov", F.floor(F.col("cov") * scale)).withColumn("uniqcov", F.floor(F.col("uniqcov") * scale))
    bounds = median_mad(pre.filter("_unique"), "cov")
    out = pre.crossJoin(F.broadcast(bounds))  # one row
    low = F.greatest(F.lit(0), F.col("median") - F.col("mad"))
    inside = F.col("_unique") & (F.col("cov") > low) & (F.col("cov") < F.col("median") + F.col("mad"))
    return out.withColumn("selected", F.coalesce(inside, F.lit(False))).drop("_unique", "median", "mad")
