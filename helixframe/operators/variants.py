"""Allele support of variants and allele fractions of windows and segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.stats import safe_div
from helixframe.functions.work import materialize
from helixframe.operators import bases
from helixframe.operators.content import tiled
from helixframe.operators.intervals import bucketed, interval_join
from helixframe.operators.reads import MOST_ALLELES, NOT_COUNTED, aligned_blocks, aligned_length, drop_flagged, mates_here, min_quality


def true_sites(variants: DataFrame, reference: DataFrame, bucket: int = 1 << 10) -> DataFrame:
    """(contig, pos, ref, alt) of the variants whose REF is the genome's base. reference: sequence blocks (contig, block_start, bases), of which a substring is taken."""
    blocks = reference.select("contig", F.col("block_start").alias("start"), (F.col("block_start") + F.length("bases")).alias("end"), "bases")
    at = interval_join(variants.select("contig", "pos", "ref", "alt"), blocks, bucket)
    base = F.substring("bases", (F.col("pos") - F.col("start") + 1).cast("int"), F.lit(1))
    return at.filter(F.upper(base) == F.col("ref")).select("contig", "pos", "ref", "alt")


def pileup(reads: DataFrame, variants: DataFrame, contigs: DataFrame, reference: DataFrame, quality: int, base_quality: int, bucket: int = 1 << 10) -> DataFrame:
    """(contig, pos, ref, alt, ref_n, alt_n). reference: sequence blocks (contig, block_start, bases). Mates that overlap count twice.

    The aligned stretches of reads, cut where words of 64 places end, meet the marks of their word, a long with a bit a site,
    and the letters at marked places are counted within the task before they are shuffled: no row for a base without
    a site. The sites are written first, so that Spark knows their size before it shuffles: a small table of marks goes to the reads.
    """
    r = mates_here(min_quality(drop_flagged(reads, NOT_COUNTED), quality)).join(F.broadcast(contigs.select("tid", "contig")), "tid")
    sites = materialize(true_sites(variants, reference, bucket), "sites")
    bit = F.expr(f"shiftleft(1L, cast(pos % {bases.WORD} as int))")
    marks = sites.groupBy("contig", F.expr(f"pos div {bases.WORD}").alias("word")).agg(F.bit_or(bit).alias("marks"))
    pieces = r.select("contig", "pos", "cigar", "seq", "qual").mapInArrow(bases.cut(base_quality), bases.PIECES)
    met = pieces.join(marks, ["contig", "word"]).select("contig", "lo", "letters", "marks")
    n = met.mapInArrow(bases.count, bases.COUNTS).groupBy("contig", "pos", "base").agg(F.sum("n").alias("n"))
    is_alt, is_ref = F.col("base") == F.col("alt"), F.col("base") == F.col("ref")
    n = n.join(sites, ["contig", "pos"]).groupBy("contig", "pos", "ref", "alt").agg(F.sum(F.when(is_alt, F.col("n"))).alias("alt_n"), F.sum(F.when(is_ref & ~is_alt, F.col("n"))).alias("ref_n"))
    cap = lambda c: F.least(F.col(c), F.lit(MOST_ALLELES)).cast("int").alias(c)
    out = variants.select("contig", "pos", "ref", "alt").join(n, ["contig", "pos", "ref", "alt"], "left").fillna(0, ["ref_n", "alt_n"])
    return out.select("contig", "pos", "ref", "alt", cap("ref_n"), cap("alt_n"))


def total() -> Column:
    return F.col("ref_n") + F.col("alt_n")


def folded(alt: Column, ref: Column) -> Column:
    """The fraction of the rarer allele; null without support."""
    v = safe_div(alt.cast("double"), alt + ref)
    return F.least(v, 1 - v)


def het_sites(support: DataFrame, min_coverage: int, control: bool = False) -> DataFrame:
    """Sites with more than min_coverage reads whose rarer allele has enough support: a tenth, or three tenths of a control's reads, and two at least."""
    h = 0.3 if control else 0.1
    least = F.greatest(F.ceil(F.lit(h) * total()), F.lit(2))
    return support.filter((total() > min_coverage) & (F.col("ref_n") >= least) & (F.col("alt_n") >= least))


def matched_sites(tumour: DataFrame, control_het: DataFrame) -> DataFrame:
    """Tumour sites that are heterozygous in the control."""
    return tumour.join(control_het.select("contig", "pos").distinct(), ["contig", "pos"], "left_semi")


def mean_folded(support: DataFrame) -> DataFrame:
    """One row: mean fraction of the rarer allele; sites without reads don't count."""
    return support.agg(F.avg(folded(F.col("alt_n"), F.col("ref_n"))).alias("mean_maf"))


def baf_table(tumour: DataFrame, control: DataFrame | None = None) -> DataFrame:
    """Supported sites with both samples' alleles, joined by place; without a control 0, 0 and 0.5."""
    t = tumour.filter(total() > 0).select("contig", "pos", F.col("ref_n").alias("ref_t"), F.col("alt_n").alias("alt_t"), safe_div(F.col("alt_n").cast("double"), total()).alias("baf_t"))
    if control is None:
        return t.select("*", F.lit(0).alias("ref_c"), F.lit(0).alias("alt_c"), F.lit(0.5).alias("baf_c"))
    c = control.select("contig", "pos", F.col("ref_n").alias("ref_c"), F.col("alt_n").alias("alt_c"), safe_div(F.col("alt_n").cast("double"), total()).alias("baf_c"))
    return t.join(c, ["contig", "pos"], "left").select("contig", "pos", "ref_t", "alt_t", "baf_t", F.coalesce("ref_c", F.lit(0)).alias("ref_c"), F.coalesce("alt_c", F.lit(0)).alias("alt_c"), F.coalesce("baf_c", F.lit(0.5)).alias("baf_c"))


def maf_sums(windows: DataFrame, support: DataFrame, bucket: int = 1 << 14) -> DataFrame:
    """windows (contig, start, end) with minor, major and n_snps: reads of the rarer and the commoner allele of the sites within, and their number."""
    sites = support.select("contig", "pos", "ref_n", "alt_n")
    keys = windows.select("contig", "start", "end").distinct()
    s = interval_join(sites, keys, bucket).groupBy("contig", "start", "end").agg(F.sum(F.least("ref_n", "alt_n")).alias("minor"), F.sum(F.greatest("ref_n", "alt_n")).alias("major"), F.count(F.lit(1)).alias("n_snps"))
    return windows.join(s, ["contig", "start", "end"], "left").fillna(0, ["minor", "major", "n_snps"])


def expected_folded(depth: int) -> float:
    """Mean fraction of the rarer of two equally likely alleles at this depth, by enumeration."""
    if depth < 1:
        return 0.0
    log = lambda k: math.lgamma(depth + 1) - math.lgamma(k + 1) - math.lgamma(depth - k + 1) - depth * math.log(2)
    return sum(math.exp(log(k)) * min(k, depth - k) / depth for k in range(depth + 1))


def expected_table(spark, most: int = 1_000) -> DataFrame:
    """(depth, exp_maf): what maf_ratio divides by without a control; any table of this shape will do."""
    return spark.createDataFrame([(d, expected_folded(d)) for d in range(1, most)], "depth int, exp_maf double")


def maf_ratio(sums: DataFrame, min_snps: int, min_coverage: int, control: DataFrame | None = None, expected: DataFrame | None = None, beyond: float = 0.491) -> DataFrame:
    """sums of the tumour with maf: its minor-allele fraction against the control's or the expected one; null where sites or reads are too few."""
    t = safe_div(F.col("minor").cast("double"), F.col("minor") + F.col("major"))
    enough = (F.col("n_snps") >= min_snps) & (F.col("minor") + F.col("major") >= min_coverage)
    if control is not None:
        c = control.select("contig", "start", "end", F.col("minor").alias("_minor"), F.col("major").alias("_major"))
        other = safe_div(F.col("_minor").cast("double"), F.col("_minor") + F.col("_major"))
        both = enough & (F.col("_minor") + F.col("_major") >= min_coverage) & (other > 0)
        return sums.join(c, ["contig", "start", "end"], "left").withColumn("maf", F.when(both, t / other)).drop("_minor", "_major")
    depth = F.floor(safe_div((F.col("minor") + F.col("major")).cast("double"), F.col("n_snps"))).cast("int")
    out = sums.withColumn("_depth", depth).join(F.broadcast(expected.select(F.col("depth").alias("_d"), "exp_maf")), F.col("_depth") == F.col("_d"), "left")
    return out.withColumn("maf", F.when(enough, safe_div(t, F.coalesce("exp_maf", F.lit(beyond))))).drop("_depth", "_d", "exp_maf")


def log_factorial(n: Column) -> Column:
    """ln n!: from a short list up to 31, beyond by Stirling's series, whose rest is below 1e-13 there. An expression, so no table of them is joined."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    few = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(32)])
    return F.when(n < 32, F.element_at(few, n.cast("int") + 1)).otherwise(series)


def binomial_test(counts: DataFrame, k: str, n: str) -> DataFrame:
    """counts with p: the exact two-sided chance of k of n at one half, summed over the outcomes of each distinct (k, n). Up to n = 20 the chances are exact fractions of whole numbers."""
    pairs = counts.select(F.col(k).cast("long").alias("_k"), F.col(n).cast("long").alias("_n")).distinct()
    log = lambda i: log_factorial(F.col("_n")) - log_factorial(i) - log_factorial(F.col("_n") - i) - F.col("_n") * F.log(F.lit(2.0))
    each = pairs.withColumn("_own", log(F.col("_k"))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n")))).withColumn("_at", log(F.col("_i")))
    few = lambda c: F.factorial(F.least(c, F.lit(20)).cast("int"))
    exact = few(F.col("_n")) / (few(F.col("_i")) * few(F.col("_n") - F.col("_i"))) / F.pow(F.lit(2.0), F.col("_n"))
    own = F.when(F.col("_n") <= 20, exact).otherwise(F.exp("_at"))
    chance = F.sum(F.when(F.col("_at") <= F.col("_own") + 1e-7, own).otherwise(0.0))
    p = each.groupBy("_k", "_n").agg(F.least(chance, F.lit(1.0)).alias("p"))
    return counts.join(p, (counts[k] == p["_k"]) & (counts[n] == p["_n"])).drop("_k", "_n")


def percent_identity(reads: DataFrame, contigs: DataFrame, reference: DataFrame, tile: int = 1 << 14) -> DataFrame:
    """(ord, same, aligned, identity) of reads with a CIGAR: bases equal to the reference, by bases compared, inserted, deleted and skipped together.

    A read meets the tiles of the sequence that it reaches, its blocks are compared there as arrays of letters,
    and a read across a tile's end adds up what both tiles say.
    """
    c = F.broadcast(contigs.select("tid", "contig", "length"))
    r = reads.join(c, "tid").select("ord", "contig", "pos", "cigar", F.upper("seq").alias("seq"), (F.col("pos") + aligned_length(F.col("cigar"))).alias("end"))
    counted = F.aggregate(F.filter("cigar", lambda x: x["op"].isin("M", "=", "X", "I", "D", "N")), F.lit(0), lambda a, x: a + x["len"])
    totals = r.select("ord", counted.alias("aligned"))
    held = tiled(reference.join(F.broadcast(contigs.select("contig", "length")), "contig"), 0, tile).groupBy("contig", "tile").agg(F.array_sort(F.collect_list(F.struct("at", "bases"))).alias("parts"))
    # Parts of a tile in order; what no part covers is a blank, which equals no base.
    text = F.aggregate("parts", F.lit(""), lambda a, x: F.concat(F.rpad(a, x["at"], " "), F.upper(x["bases"])))
    spans = bucketed(r.withColumn("blocks", aligned_blocks(F.col("cigar"), F.col("pos"))), tile, "pos", "end").withColumnRenamed("_bucket", "tile")
    met = spans.join(held.select("contig", "tile", text.alias("text")), ["contig", "tile"])
    origin = F.col("tile") * tile

    def equal(b):
        lo, hi = F.greatest(b["rp"], origin), F.least(b["rp"] + b["n"], origin + tile)
        size = F.greatest(hi - lo, F.lit(0)).cast("int")
        letters = lambda x, at: F.split(F.substring(x, (at + 1).cast("int"), size), "")
        both = F.zip_with(letters(F.col("seq"), b["sp"] + lo - b["rp"]), letters(F.col("text"), lo - origin), lambda p, q: (p == q) & (p != ""))
        return F.when(size > 0, F.size(F.filter(both, lambda x: x))).otherwise(0)

    same = F.aggregate("blocks", F.lit(0), lambda a, b: a + equal(b))
    found = met.select("ord", same.alias("same")).groupBy("ord").agg(F.sum("same").alias("same"))
    out = totals.join(found, "ord", "left").fillna(0, ["same"])
    return out.select("ord", F.col("same").cast("int").alias("same"), "aligned", F.coalesce(safe_div(F.col("same").cast("double"), F.col("aligned")), F.lit(0.0)).alias("identity"))
