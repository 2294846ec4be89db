"""Operators on aligned reads: filters, layout, CIGAR, mates, fragments, breakpoints, bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.stats import median_mad, upper_median
from helixframe.operators.prefix import first_rows

# Fixed values of the SAM format: bits of the flag field.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
NOT_COUNTED = SECONDARY | QCFAIL | DUPLICATE | SUPPLEMENTARY | UNMAPPED
#: Split reads are looked for in secondary and supplementary alignments too.
NOT_SPLIT = QCFAIL | DUPLICATE | UNMAPPED
#: Per-base depth and allele counters stop here.
MOST_DEPTH, MOST_ALLELES = 65_534, 65_535


def has(bit: int, flag: Column | None = None) -> Column:
    return (F.col("flag") if flag is None else flag).bitwiseAND(bit) != 0


def drop_flagged(reads: DataFrame, mask: int = NOT_COUNTED) -> DataFrame:
    return reads.filter(F.col("flag").bitwiseAND(mask) == 0)


def min_quality(reads: DataFrame, quality: int) -> DataFrame:
    return reads.filter(F.col("mapq") >= quality)


def mates_here(reads: DataFrame) -> DataFrame:
    """Drops paired reads whose mate is unmapped or on another contig."""
    return reads.filter(~(has(PAIRED) & (has(MATE_UNMAPPED) | (F.col("tid") != F.col("mtid")))))


def layout() -> Column:
    """0 both forward, 1 both reverse, 2 facing each other, 3 facing away."""
    back, mate_back = has(REVERSE), has(MATE_REVERSE)
    ahead = F.col("pos") < F.col("mpos")
    behind = F.col("pos") > F.col("mpos")
    return (
        F.when(~back & ~mate_back, 0).when(back & mate_back, 1)
        .when(~back, F.when(ahead, 2).otherwise(3)).otherwise(F.when(behind, 2).otherwise(3))
    )


def parse_cigar(text: Column) -> Column:
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    sizes, ops = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.zip_with(ops, sizes, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def aligned_length(cigar: Column) -> Column:
    """Reference bases spanned: M, =, X, D and N."""
    return F.aggregate(F.filter(cigar, lambda c: c["op"].isin("M", "=", "X", "D", "N")), F.lit(0), lambda a, c: a + c["len"])


def half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def second_mates(reads: DataFrame) -> DataFrame:
    """Unpaired reads, and of each proper pair the second read (whose first was seen before, in file order `ord`).

    A read is the first of its pair if it lies before its mate, or at the
    same place with no first read of that name there yet. A second read counts if
    the last read of the same pair before it is a first one: one pass over a window of
    the pair's own rows instead of a self-join.
    """
    paired = reads.filter(has(PAIRED))
    here = Window.partitionBy("qname", "tid", "pos").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.when(F.col("pos") <= F.col("mpos"), 1).otherwise(0)).over(here), F.lit(0))
    first = (F.col("pos") < F.col("mpos")) | ((F.col("pos") == F.col("mpos")) & (earlier == 0))
    p = paired.withColumn("_first", first).withColumn("_a", F.when(F.col("_first"), F.col("pos")).otherwise(F.col("mpos"))).withColumn("_b", F.when(F.col("_first"), F.col("mpos")).otherwise(F.col("pos")))
    last = F.lag("_first").over(Window.partitionBy("qname", "tid", "mtid", "_a", "_b").orderBy("ord"))
    seconds = p.withColumn("_seen", last).filter(~F.col("_first") & F.col("_seen")).select(reads.columns)
    return reads.filter(~has(PAIRED)).unionByName(seconds)


def fragment_midpoints(reads: DataFrame, low, high, mode: str = "count", meanisize: int = 251, alen: str = "alen") -> DataFrame:
    """A column mid. Paired reads with an insert size strictly between low and high count at its middle.

    Others: mode "scan" drops them, "count" takes the read's own middle, "bias" half a mean insert from the read's outer end.
    """
    n = F.col(alen)
    own = F.col("pos") + half(n)
    isize = F.col("pos") + n - F.col("mpos")
    normal = (isize > low) & (isize < high)
    middle = F.col("mpos") + half(isize)
    aside = F.when(has(REVERSE), F.col("pos") + n - meanisize // 2).otherwise(F.col("pos") + meanisize // 2)
    other = {"scan": F.lit(None), "count": own, "bias": aside}[mode].cast("int")
    mid = F.when(~has(PAIRED), own).when(normal, middle).otherwise(other)
    return reads.withColumn("mid", mid).filter(F.col("mid").isNotNull())


def paired_reads(reads: DataFrame, quality: int) -> DataFrame:
    """What all ways of counting share: counted reads, unpaired ones and second mates, with alen. Write it where several of them follow."""
    r = mates_here(min_quality(drop_flagged(reads), quality)).withColumn("alen", aligned_length(F.col("cigar")))
    return second_mates(r.select("ord", "qname", "flag", "tid", "pos", "mtid", "mpos", "alen"))


def fragment_points(paired: DataFrame, contigs: DataFrame, low, high, mode: str = "count", meanisize: int = 251, single_end_layout: bool = False) -> DataFrame:
    """(contig, pos): where each fragment of paired_reads() counts. The scan wants facing pairs, which is the same for both reads of a pair; single-end reads have no layout unless single_end_layout asks for it as the paired rule has it."""
    if mode == "scan":
        wanted = layout() == 2
        paired = paired.filter(wanted if single_end_layout else wanted | ~has(PAIRED))
    mids = fragment_midpoints(paired, low, high, mode, meanisize)
    c = contigs.select("tid", "contig", "length")
    return mids.join(F.broadcast(c), "tid").filter((F.col("mid") >= 0) & (F.col("mid") < F.col("length"))).select("contig", F.col("mid").alias("pos"))


def fragments(reads: DataFrame, contigs: DataFrame, quality: int, low, high, mode: str = "count", meanisize: int = 251, single_end_layout: bool = False) -> DataFrame:
    """(contig, pos) of the fragments of reads, counted one way."""
    return fragment_points(paired_reads(reads, quality), contigs, low, high, mode, meanisize, single_end_layout)


def depth(points: DataFrame) -> DataFrame:
    """(contig, pos) -> with depth, which stops at MOST_DEPTH."""
    return points.groupBy("contig", "pos").agg(F.least(F.count(F.lit(1)), F.lit(MOST_DEPTH)).alias("depth"))


def library_stats(reads: DataFrame, mad_cutoff: int = 3, screened: int = 10_000_000, wanted: int = 1_000_000, least: int = 1_000) -> dict:
    """Read length, insert size median, MAD and range of a bounded sample in file order; defaults for single-end data.

    Gives rs, median, mad, min_isize, max_isize, meanisize, facing, not_facing. The sample is cut by counting reads by their number, not by sorting them.
    """
    r = first_rows(drop_flagged(reads).filter(~has(READ2) & (F.col("l_qseq") < 65_000)), screened + 1)
    pair = has(PAIRED) & ~has(MATE_UNMAPPED) & (F.col("tid") == F.col("mtid"))
    sizes = first_rows(r.filter(pair), wanted).select(F.abs("isize").alias("isize"), (layout() == 2).alias("facing"))
    out = {"rs": 0, "median": 250, "mad": 15, "min_isize": 0, "max_isize": 400, "facing": 0, "not_facing": 0}
    n_reads, rs = first_rows(r, wanted).agg(F.count(F.lit(1)), upper_median("l_qseq")).first()
    if n_reads >= least:
        out["rs"] = int(rs)
    n, facing = sizes.agg(F.count(F.lit(1)), F.count_if("facing")).first()
    if n >= least:
        median, mad = map(int, median_mad(sizes, "isize").first())
        if 50 <= median <= 100_000:
            out |= {"median": median, "mad": mad, "min_isize": max(0, median - mad_cutoff * mad), "max_isize": median + mad_cutoff * mad, "facing": facing, "not_facing": n - facing}
    out["meanisize"] = out["median"] // 2 * 2 + 1
    return out


def split_breakpoints(reads: DataFrame, contigs: DataFrame, quality: int, minsize: int, clip: int = 10) -> DataFrame:
    """(contig, pos, left_n, right_n): clips over `clip` bases and deletions over minsize, sparse."""
    r = min_quality(drop_flagged(reads, NOT_SPLIT), quality)
    start = F.struct(F.col("pos").alias("rp"), F.lit(0).alias("sp"), F.array().cast("array<struct<pos:int,left:boolean>>").alias("out"))

    def step(a, c):
        op, n = c["op"], c["len"]
        cut, gap = op.isin("S", "H"), op == "D"
        rp = a["rp"] + F.when(op.isin("M", "=", "X", "D", "N"), n).otherwise(0)
        sp = a["sp"] + F.when(op.isin("M", "=", "X", "I", "S", "H"), n).otherwise(0)
        mark = lambda p, left: F.struct(p.cast("int").alias("pos"), left.alias("left"))
        found = F.when(cut & (n > clip), F.array(mark(a["rp"], a["sp"] == 0))).when(gap & (n > minsize), F.array(mark(a["rp"], F.lit(False)), mark(rp, F.lit(True)))).otherwise(F.array().cast("array<struct<pos:int,left:boolean>>"))
        return F.struct(rp.cast("int").alias("rp"), sp.cast("int").alias("sp"), F.concat(a["out"], found).alias("out"))

    marks = r.select("tid", F.explode(F.aggregate("cigar", start, step, lambda a: a["out"])).alias("m"))
    c = contigs.select("tid", "contig", "length")
    inside = marks.join(F.broadcast(c), "tid").filter((F.col("m.pos") >= 0) & (F.col("m.pos") < F.col("length")))
    cap = lambda x: F.least(F.count_if(x), F.lit(MOST_DEPTH)).cast("int")
    return inside.groupBy("contig", F.col("m.pos").alias("pos")).agg(cap(F.col("m.left")).alias("left_n"), cap(~F.col("m.left")).alias("right_n"))


def base_at(place: Column, pos: str = "pos", cigar: str = "cigar") -> Column:
    """The 0-based place in the read of the base that is aligned to a reference place: prefix sums over the CIGAR's blocks; null in gaps."""
    start = F.struct(F.col(pos).cast("int").alias("rp"), F.lit(0).alias("sp"), F.lit(None).cast("int").alias("at"))

    def step(a, c):
        op, n = c["op"], c["len"]
        inside = op.isin("M", "=", "X") & (place >= a["rp"]) & (place < a["rp"] + n)
        rp = a["rp"] + F.when(op.isin("M", "=", "X", "D", "N"), n).otherwise(0)
        sp = a["sp"] + F.when(op.isin("M", "=", "X", "I", "S"), n).otherwise(0)
        return F.struct(rp.cast("int").alias("rp"), sp.cast("int").alias("sp"), F.when(inside, a["sp"] + (place - a["rp"])).otherwise(a["at"]).cast("int").alias("at"))

    return F.aggregate(cigar, start, step, lambda a: a["at"])


def aligned_blocks(cigar: Column, pos: Column) -> Column:
    """[(rp, sp, n)]: the stretches of aligned bases, by their first place in the reference and in the read."""
    none = F.array().cast("array<struct<rp:int,sp:int,n:int>>")
    start = F.struct(pos.cast("int").alias("rp"), F.lit(0).alias("sp"), none.alias("out"))

    def step(a, c):
        op, n = c["op"], c["len"]
        block = F.when(op.isin("M", "=", "X") & (n > 0), F.array(F.struct(a["rp"].alias("rp"), a["sp"].alias("sp"), n.alias("n")))).otherwise(none)
        rp = a["rp"] + F.when(op.isin("M", "=", "X", "D", "N"), n).otherwise(0)
        sp = a["sp"] + F.when(op.isin("M", "=", "X", "I", "S"), n).otherwise(0)
        return F.struct(rp.cast("int").alias("rp"), sp.cast("int").alias("sp"), F.concat(a["out"], block).alias("out"))

    return F.aggregate(cigar, start, step, lambda a: a["out"])
