"""Scalar and aggregate expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(name: str) -> Column:
    """The element at n div 2 of the sorted values; null if there are none."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def median_mad(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Upper median and upper median absolute deviation, of all rows or by keys; two aggregations."""
    keys = keys or []
    if keys:
        med = df.groupBy(*keys).agg(upper_median(name).alias("median"))
        dev = df.join(med, keys).withColumn("_dev", F.abs(F.col(name) - F.col("median")))
        return dev.groupBy(*keys).agg(F.first("median").alias("median"), upper_median("_dev").alias("mad"))
    med = df.agg(upper_median(name).alias("median"))
    dev = df.select(name).crossJoin(F.broadcast(med)).withColumn("_dev", F.abs(F.col(name) - F.col("median")))  # one row
    return dev.agg(F.first("median").alias("median"), upper_median("_dev").alias("mad"))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def lround(x: Column) -> Column:
    """Half away from zero."""
    return F.round(x).cast("long")


def normal_density(x: Column, mean, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * F.lit(math.sqrt(2 * math.pi)))


def n95_length(contigs: DataFrame, share: float = 0.95) -> int:
    """The length of the contig at which the lengths, longest first, pass a share of the genome."""
    total = contigs.agg(F.sum("length")).first()[0] or 0
    run = F.sum("length").over(Window.orderBy(F.col("length").desc(), "contig").rowsBetween(Window.unboundedPreceding, 0))
    hit = contigs.withColumn("run", run).filter(F.col("run") > share * total).agg(F.max("length")).first()[0]
    return hit or 0


def true_median(name: str) -> Column:
    return F.median(name)


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact two-sided binomial test: the chance of an outcome no likelier than k."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if n == 0 or p in (0.0, 1.0):
        return 1.0
    at = log(k)
    return min(1.0, sum(math.exp(x) for x in map(log, range(n + 1)) if x <= at + 1e-7))


def holds_n(seq: Column) -> Column:
    return F.contains(seq, F.lit("N")) | F.contains(seq, F.lit("n"))


def entropy(seq: Column) -> Column:
    """Shannon entropy in bits of the characters of a string."""
    chars = F.array_distinct(F.split(seq, ""))
    n = F.length(seq)
    share = lambda c: (n - F.length(F.replace(seq, c, F.lit("")))) / n
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def render(x: float | None, digits: int = 6, null: str = "NA") -> str:
    """A number in the shortest form with so many significant digits, as C's %g has it."""
    return null if x is None else f"{x:.{digits}g}"


def percent_identity(seq: str, cigar: list[tuple[str, int]], ref: str, pos: int) -> float:
    """Share of a read's bases that equal the reference, of those compared, inserted, deleted and skipped; a model of the operator on reads."""
    same = total = 0
    r, q = pos, 0
    for op, n in cigar:
        total += n if op in "M=XIDN" else 0
        same += sum(a == b for a, b in zip(seq[q : q + n].upper(), ref[r : r + n].upper())) if op in "M=X" else 0
        r += n if op in "M=XDN" else 0
        q += n if op in "M=XIS" else 0
    return same / total if total else 0.0
