"""Readers of SAM, FASTA, BED, VCF and window tables as DataFrames. Text positions that count from 1 become 0-based."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.work import materialize
from helixframe.operators.intervals import union_intervals
from helixframe.operators.reads import parse_cigar
from helixframe.operators.segment import contig_runs


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file in file order: ord, value. Within and across splits of one file ord grows with the line's place."""
    lines = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return lines.select(place.alias("at"), F.monotonically_increasing_id().alias("ord"), "value")


def read_contigs(spark: SparkSession, sam: str) -> DataFrame:
    """The @SQ lines of a SAM header: tid, contig, length."""
    head = _numbered(spark, sam).filter(F.col("value").startswith("@SQ"))
    get = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1)
    rows = head.select("ord", get("SN").alias("contig"), get("LN").cast("int").alias("length"))
    return rows.select((F.row_number().over(Window.orderBy("ord")) - 1).alias("tid"), "contig", "length")  # header lines only


def read_sam(spark: SparkSession, sam: str, contigs: DataFrame | None = None) -> DataFrame:
    """Alignments of a SAM text file, in the canonical schema."""
    contigs = contigs if contigs is not None else read_contigs(spark, sam)
    f = F.split("value", "\t")
    field = lambda i: F.get(f, F.lit(i))
    lines = _numbered(spark, sam).filter(~F.col("value").startswith("@") & (F.length("value") > 0))
    mate = F.when(field(6) == "=", field(2)).when(field(6) != "*", field(6))
    seq = F.when(field(9) != "*", field(9))
    quals = F.transform(F.filter(F.split(F.when(field(10) != "*", field(10)), ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("tinyint"))
    rows = lines.select(
        "ord", field(0).alias("qname"), field(1).try_cast("int").alias("flag"), field(2).alias("_c"), (field(3).try_cast("int") - 1).alias("pos"), field(4).try_cast("int").alias("mapq"), parse_cigar(field(5)).alias("cigar"),
        mate.alias("_m"), (field(7).try_cast("int") - 1).alias("mpos"), field(8).try_cast("int").alias("isize"), F.coalesce(F.length(seq), F.lit(0)).alias("l_qseq"), seq.alias("seq"), quals.alias("qual"),
    )
    c = F.broadcast(contigs.select("tid", "contig"))
    out = rows.join(c.withColumnsRenamed({"tid": "tid", "contig": "_c"}), "_c", "left").join(c.withColumnsRenamed({"tid": "mtid", "contig": "_m"}), "_m", "left")
    unknown = lambda n: F.coalesce(n, F.lit(-1)).alias(n)
    return out.select("ord", "qname", "flag", unknown("tid"), "pos", "mapq", "cigar", unknown("mtid"), "mpos", "isize", "l_qseq", "seq", "qual")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequence lines with the place of their first base: contig, block_start, bases. Names and lengths run within a file split, then from split to split (one row each)."""
    name = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1))
    lines = _numbered(spark, path).filter(F.length("value") > 0).select("ord", F.shiftright("ord", 33).alias("split"), name.alias("name"), F.trim("value").alias("bases"))
    # The numbers follow how this scan was cut into splits, so both sides of the join below must come from one scan.
    lines = materialize(lines.withColumn("n", F.when(F.col("name").isNull(), F.length("bases")).otherwise(0)), "fasta-lines")
    so_far = Window.partitionBy("split").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("own", F.last("name", ignorenulls=True).over(so_far)).withColumn("heads", F.count("name").over(so_far))
    before = Window.partitionBy("split", "heads").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = lines.groupBy("split").agg(F.max_by("own", "ord").alias("own"), F.max("heads").alias("heads"), F.max_by(F.col("offset") + F.col("n"), "ord").alias("tail"))
    by = Window.orderBy("split")
    up_to = by.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("own", F.last("own", ignorenulls=True).over(up_to)).withColumn("run", F.count_if(F.col("heads") > 0).over(up_to))
    ends = ends.withColumn("tail", F.sum("tail").over(Window.partitionBy("run").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)))
    carried = ends.select("split", F.lag("own").over(by).alias("from"), F.coalesce(F.lag("tail").over(by), F.lit(0)).alias("base"))
    placed = lines.filter("name is null").join(carried, "split")
    first = F.col("heads") == 0
    start = F.col("offset") + F.when(first, F.col("base")).otherwise(0)
    return placed.select(F.when(first, F.col("from")).otherwise(F.col("own")).alias("contig"), start.cast("int").alias("block_start"), "bases").filter("contig is not null")


def _intervals(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    f = F.split(F.trim("value"), "[ \\t,;]+")
    rows = spark.read.text(path).filter(F.size(f) >= 3).select(F.get(f, F.lit(0)).alias("contig"), F.expr("try_cast(split(trim(value), '[ \\\\t,;]+')[1] as int)").alias("start"), F.expr("try_cast(split(trim(value), '[ \\\\t,;]+')[2] as int)").alias("end"))
    return rows.filter("start is not null and end is not null").join(F.broadcast(contigs.select("contig")), "contig", "left_semi")


def read_bed_union(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """Intervals joined where they overlap or touch; unknown contigs are skipped."""
    return union_intervals(_intervals(spark, path, contigs))


def read_bed(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """Intervals as listed, without exact repeats."""
    return _intervals(spark, path, contigs).dropDuplicates()


def genotype(text: Column) -> Column:
    """Allele numbers of a GT entry; missing ones are null."""
    return F.transform(F.split(F.split(text, ":").getItem(0), "[/|]"), lambda a: F.when(a != ".", a.cast("int")))


def read_vcf(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Biallelic SNPs: contig, pos, ref, alt, gt. The first of a place; if the header names the sample, those it is heterozygous at."""
    lines = _numbered(spark, path)
    head = lines.filter(F.col("value").startswith("#CHROM")).select("value").first()
    names = head[0].split("\t") if head else []
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select("ord", F.get(f, F.lit(0)).alias("contig"), (F.get(f, F.lit(1)).try_cast("int") - 1).alias("pos"), F.upper(F.get(f, F.lit(3))).alias("ref"), F.upper(F.get(f, F.lit(4))).alias("alt"), f.alias("_f"))
    rows = rows.filter((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != F.col("alt")) & ~F.col("alt").isin(".", "*"))
    if sample in names[9:]:
        rows = rows.withColumn("gt", genotype(F.get("_f", F.lit(names.index(sample)))))
        carried = F.aggregate("gt", F.lit(0), lambda a, x: a + x)
        rows = rows.filter(carried == 1)
    else:
        rows = rows.withColumn("gt", F.lit(None).cast("array<int>"))
    first = F.row_number().over(Window.partitionBy("contig", "pos").orderBy("ord"))
    return rows.withColumn("_n", first).filter("_n = 1").select("contig", "pos", "ref", "alt", "gt")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """A window table written by tsv(): numbers, nulls for NA."""
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="NA")
    kinds = ["string", "int", "int", "int", "double", "double", "double"]
    return raw.select(*[F.col(f"`{c}`").cast(kinds[min(i, 6)]).alias(c) for i, c in enumerate(raw.columns)])


def read_plot(spark: SparkSession, path: str) -> DataFrame:
    """A window table as plots read it, by the places of its columns: contig, start, end, cn, maf."""
    w = read_windows(spark, path)
    return w.toDF(*[f"c{i}" for i in range(len(w.columns))]).select(F.col("c0").alias("contig"), F.col("c1").cast("long").alias("start"), F.col("c2").cast("long").alias("end"), F.col("c5").alias("cn"), F.col("c6").alias("maf"))


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A signal matrix: (contig, start, end, signals, ord, run) and the signals' names; NA and NaN are null. A contig that comes again later in the file begins another run."""
    first = spark.read.text(path).first()
    names = re.split(r"[ \t,;]+", first[0]) if first else []
    lines = _numbered(spark, path).filter(F.col("value") != (first[0] if first else ""))
    f = F.split("value", "[ \\t,;]+")
    number = lambda i: F.when(~F.get(f, F.lit(i)).isin("NA", "NaN", "nan"), F.get(f, F.lit(i)).cast("double"))
    rows = lines.select("ord", F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("end"), *[number(i).alias(n) for i, n in enumerate(names) if i > 2])
    return contig_runs(materialize(rows, "matrix")), names[3:]
