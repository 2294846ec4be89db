"""Genotype likelihoods of copy-number calls and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.stats import lround, normal_density

#: Copy numbers 0..9 get a likelihood; deviations stop at MOST_SD.
STATES, MOST_SD, FLOOR = 10, 0.5, -1000.0
TINY = 1e-6


def level_sd(variance: DataFrame, compat: bool = True) -> DataFrame:
    """(ws, dev, n) -> (ws, sd). compat takes the variance itself as deviation; else its root. Levels of one window get MOST_SD."""
    v = F.col("dev") / (F.col("n") - 1)
    sd = v if compat else F.sqrt(v)
    return variance.select("ws", F.when(F.col("n") > 1, F.least(F.greatest(sd, F.lit(TINY)), F.lit(MOST_SD))).otherwise(F.lit(MOST_SD)).alias("sd"))


def with_sd(calls: DataFrame, levels: DataFrame, size: str = "size") -> DataFrame:
    """calls with sd of the smallest level with 2 * ws > size, or MOST_SD."""
    l = F.broadcast(levels.agg(F.array_sort(F.collect_list(F.struct("ws", "sd"))).alias("_levels")))  # a dozen levels
    fit = F.filter("_levels", lambda x: 2 * x["ws"] > F.col(size))
    return calls.crossJoin(l).withColumn("sd", F.coalesce(F.try_element_at(fit, F.lit(1))["sd"], F.lit(MOST_SD))).drop("_levels")


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once: nested expressions over arrays would else compute it again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def likelihoods(cn: Column, sd: Column) -> Column:
    """Struct of gl (log10 likelihoods of copy numbers 0..9, the best 0) and pl."""
    x = cn.cast("float").cast("double")
    raw = F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda g: normal_density(x, g.cast("double"), sd))

    def logs(r: Column) -> Column:
        whole = F.aggregate(r, F.lit(0.0), lambda a, v: a + v)
        return bind(whole, lambda t: F.transform(r, lambda v: F.when((t > 0) & (v > 0), F.log10(v / t)).otherwise(F.lit(FLOOR))))

    def scaled(l: Column) -> Column:
        return bind(F.array_max(l), lambda best: F.transform(l, lambda v: F.greatest(v - best, F.lit(FLOOR))))

    both = lambda g: F.struct(g.alias("gl"), F.transform(g, lambda v: lround(v * -10)).alias("pl"))
    return bind(raw, lambda r: bind(logs(r), lambda l: bind(scaled(l), both)))


def quality(pl: Column, compat: bool = True) -> Column:
    """GQ. compat has 0 where the other states' chances vanish beside 1; else the sum over the other states is taken by itself."""
    chance = F.transform(pl, lambda v: F.pow(F.lit(10.0), v.cast("double") / -10))
    if compat:
        total = F.aggregate(chance, F.lit(0.0), lambda a, v: a + v)
        p = lambda t: F.greatest(F.log10(F.when(t > 1, 1 - 1 / t)), F.lit(FLOOR))
        return bind(total, lambda t: F.when(t > 1, lround(p(t) * -10)).otherwise(F.lit(0)).cast("int"))
    others = F.aggregate(F.slice(F.array_sort(chance), 1, STATES - 1), F.lit(0.0), lambda a, v: a + v)
    return bind(others, lambda o: lround(F.greatest(F.log10(F.when(o > 0, o / (1 + o))), F.lit(FLOOR / 10)) * -10).cast("int"))


def genotype(calls: DataFrame, levels: DataFrame, contigs: DataFrame, ploidy: int = 2, control_maf: float | None = None, compat: bool = True) -> DataFrame:
    """calls -> numbered records with clamped places, relative intervals, likelihoods, qualities and allele fractions."""
    c = with_sd(calls.withColumn("size", F.col("end") - F.col("start")), levels)
    c = c.withColumn("_l", likelihoods(F.col("cn"), F.col("sd"))).withColumn("gq", quality(F.col("_l.pl"), compat)).withColumn("gq_corrected", quality(F.col("_l.pl"), False))
    c = c.join(F.broadcast(contigs.select("contig", "tid", "length")), "contig")
    s, e = F.greatest(F.col("start"), F.lit(1)), F.least(F.greatest(F.col("end"), F.lit(1)), F.col("length") - 1)
    low, high = lambda x: F.when(x >= 0, -1).otherwise(x), lambda x: F.when(x <= 0, 1).otherwise(x)
    maf = F.when(F.col("nsnps") > 0, F.col("maf") / F.col("nsnps"))
    oemaf = maf / F.lit(control_maf) if control_maf else F.lit(None).cast("double")
    number = F.row_number().over(Window.orderBy("tid", "start", "end", F.col("pty").desc()))  # calls only: a few thousand a genome
    return c.select(
        F.concat(F.lit("CNV"), F.lpad(number.cast("string"), 8, "0")).alias("id"), "contig", s.cast("int").alias("start"), e.cast("int").alias("end"),
        low(F.col("cipos_lo") - F.col("start")).alias("cipos_lo"), high(F.col("cipos_hi") - F.col("start")).alias("cipos_hi"), low(F.col("ciend_lo") - F.col("end")).alias("ciend_lo"), high(F.col("ciend_hi") - F.col("end")).alias("ciend_hi"),
        "srl", "srr", "nsnps", "cn", "rds", "pty", "mpb", F.coalesce(maf, F.lit(0.5)).alias("maf"), F.coalesce(oemaf, F.lit(1.0)).alias("oemaf"), F.col("_l.gl").alias("cnl"), "gq", "gq_corrected",
        F.when(F.col("gq") == 0, -1).otherwise(lround(F.col("cn"))).cast("int").alias("cn_int"), F.when(F.col("gq") < 15, "LowQual").otherwise("PASS").alias("ft"), ((F.col("srl") > 0) & (F.col("srr") > 0)).alias("precise"),
    )
