"""A genome as one axis: which contigs are plotted, and where each begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbered chromosomes and X, in order; the long names have a prefix.
SHORT = (*map(str, range(1, 23)), "X")
LONG = tuple(f"chr{c}" for c in SHORT)
#: Ranges that a plot shows.
MOST_COPIES, MOST_FRACTION = 8.0, 1.5


def plotted_contigs(table: DataFrame) -> tuple[str, ...]:
    """The whitelist by which most rows are named; the short one unless the long one has more."""
    long, short = table.agg(F.count_if(F.col("contig").isin(*LONG)), F.count_if(F.col("contig").isin(*SHORT))).first()
    return LONG if long > short else SHORT


def contig_offsets(table: DataFrame, names: tuple[str, ...], contigs: DataFrame | None = None) -> DataFrame:
    """(contig, place, length, offset) of the whitelist's contigs in the table, at most one row a name. Lengths come from contigs, or from the largest end in the table."""
    seen = table.filter(F.col("contig").isin(*names)).groupBy("contig").agg(F.max("end").cast("long").alias("length"))
    if contigs is not None:
        seen = seen.select("contig").join(contigs.select("contig", F.col("length").cast("long").alias("length")), "contig")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("contig")).cast("int") - 1
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return seen.withColumn("place", place).select("contig", "place", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def _within(value: Column, most: float) -> Column:
    return F.when((value >= 0) & (value <= most), value)


def genome_axis(table: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows of the table (contig, start, end, ...) on plotted contigs, with place, x and x_end on the common axis."""
    o = F.broadcast(offsets.select("contig", "place", "offset"))  # at most 23 rows
    return table.join(o, "contig").withColumn("x", F.col("start") + F.col("offset")).withColumn("x_end", F.col("end") + F.col("offset")).drop("offset")


def plot_frame(windows: DataFrame, segments: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """(kind, contig, place, start, end, x, x_end, cn, maf): windows and segments of plotted contigs. Values outside the plotted range are null, and so is maf where most windows have none or there are no segments."""
    names = plotted_contigs(windows)
    offsets = contig_offsets(windows, names, contigs)
    share = windows.filter(F.col("contig").isin(*names)).agg(F.avg(F.col("maf").isNull().cast("double"))).first()[0]
    with_maf = segments is not None and (1.0 if share is None else share) <= 0.5

    def frame(table: DataFrame, kind: str) -> DataFrame:
        maf = F.col("maf") if with_maf and "maf" in table.columns else F.lit(None).cast("double")
        at = genome_axis(table.withColumn("maf", maf), offsets)
        return at.select(F.lit(kind).alias("kind"), "contig", "place", "start", "end", "x", "x_end", _within(F.col("cn"), MOST_COPIES).alias("cn"), _within(F.col("maf"), MOST_FRACTION).alias("maf"))

    out = frame(windows, "window")
    return out if segments is None else out.unionByName(frame(segments, "segment"))
