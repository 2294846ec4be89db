"""The three commands: call, merge and segment, from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.config import CallConfig, SegmentConfig
from helixframe.functions.stats import n95_length
from helixframe.functions.work import materialize
from helixframe.operators import bias, calls, content, genotype, intervals, reads, scan, segment, variants, windows
from helixframe.sources import bam, bcf, text


def check_contigs(contigs: DataFrame, *sequences: DataFrame) -> list[str]:
    """Raises if a sequence file shares no contig with the alignments; returns those that are missing somewhere."""
    missing: set[str] = set()
    n = contigs.count()
    for s in sequences:
        lost = [r[0] for r in contigs.join(s.select("contig").distinct(), "contig", "left_anti").select("contig").collect()]
        if len(lost) == n:
            raise ValueError("no contig of the alignments is in the sequence file")
        missing |= set(lost)
    return sorted(missing)


@dataclass
class CallResult:
    library: dict
    bins: DataFrame
    curve: DataFrame
    low: int
    high: int
    windows: DataFrame
    adaptive: DataFrame
    baf: DataFrame | None
    records: DataFrame


def _support(cfg: CallConfig, alignments, sites, contigs, reference):
    return variants.pileup(alignments, sites, contigs, reference, cfg.quality, cfg.basequality)


def call(cfg: CallConfig, alignments: DataFrame, contigs: DataFrame, reference: DataFrame, mappability: DataFrame, sites: DataFrame | None = None, control: DataFrame | None = None, bed: DataFrame | None = None, scan_regions: DataFrame | None = None) -> CallResult:
    """All results of a sample. Two scalars come to the driver: the library's sizes and the bounds of the curve."""
    check_contigs(contigs, reference, mappability)
    # Tables that several branches read are written once; this also keeps the plans small.
    alignments = materialize(alignments, "alignments")
    lib = reads.library_stats(alignments, cfg.mad_cutoff)
    here = materialize(contigs.join(alignments.select("tid").distinct(), "tid", "left_semi"), "contigs")

    baf = support = control_support = None
    control_maf = None
    if sites is not None:
        support = _support(cfg, alignments, sites, contigs, reference)
        if control is not None:
            control_support = materialize(variants.het_sites(_support(cfg, control, sites, contigs, reference), cfg.coverage, control=True), "control")
            support = variants.matched_sites(support, control_support)
        else:
            support = variants.het_sites(support, cfg.coverage)
        support = materialize(support, "support")
        control_maf = variants.mean_folded(support).first()[0]
        baf = variants.baf_table(support, control_support)

    n = lib["meanisize"]
    bases = materialize(content.content(reference, mappability, here, n), "bases")

    # Scan windows and the choice of normal ones.
    paired = materialize(reads.paired_reads(alignments, cfg.quality), "paired")
    points = lambda mode: reads.fragment_points(paired, here, lib["min_isize"], lib["max_isize"], mode, n)
    at = points("scan")
    at = at.groupBy("contig", "pos").agg(F.count(F.lit(1)).alias("n")).join(bases.select("contig", "pos", "uniq"), ["contig", "pos"]).select("contig", "pos", "n", content.unique_enough(cfg.fragment, n).alias("unique"))
    at = materialize(at, "fragments")
    scanned = scan.scanned_contigs(here, at.groupBy("contig").agg(F.sum("n").alias("cov")), n95_length(contigs), cfg.sex_contigs, cfg.enough_coverage)
    if scan_regions is not None:
        regions = intervals.valid_windows(scan_regions, scanned, strict=True)
        bins = scan.scan_bins(at, regions)
    else:
        bins = scan.scan_bins(at, intervals.tiles(scanned, cfg.scan_window), cfg.scan_window)
    bins = materialize(bins, "bins")
    bins = scan.select_windows(bins, cfg.fraction_unique, 10_000 if scan_regions is not None else None, cfg.no_window_selection)
    bins = materialize(bins, "selected")

    # The curve over unique bases of selected windows, and its bounds.
    mids = reads.depth(points("bias"))
    chosen = bins.filter("selected").select("contig", "start", "end")
    known = intervals.interval_join(bases.filter(content.unique_enough(cfg.fragment, n)), chosen, cfg.scan_window).join(mids, ["contig", "pos"], "left")
    curve = bias.curve(known.select("gc", F.coalesce("depth", F.lit(0)).alias("depth")), n + 1)
    curve = materialize(curve, "curve")
    low, high = bias.bounds(curve, cfg.percentile).first()
    curve = materialize(bias.renormalised(curve, low, high), "curve")

    # Callable bases with depth and what the curve expects.
    depth = reads.depth(points("count"))
    ok = bases.filter(content.callable_base(low, high, cfg.fragment, n)).join(depth, ["contig", "pos"], "left")
    ok = materialize(bias.with_expected(ok, curve), "callable")

    if bed is not None:
        fixed = windows.bed_windows(ok, bed, here, cfg.fraction_window, cfg.ploidy)
        adaptive = windows.bed_adaptive_windows(ok, bed, here, cfg.window_size, cfg.window_offset, cfg.ploidy)
    else:
        fixed = windows.fixed_windows(ok, here, cfg.window_size, cfg.window_offset, cfg.fraction_window, cfg.ploidy)
        adaptive = windows.adaptive_windows(ok, cfg.window_size, cfg.window_offset, cfg.ploidy)
    fixed, adaptive = (_with_maf(cfg, w, support, control_support) for w in (fixed, adaptive))

    split = calls.split_peaks(reads.split_breakpoints(alignments, here, cfg.quality, cfg.minsize), cfg.minsize)
    found = materialize(calls.cnv_calls(ok, cfg.minsize, cfg.ploidy), "calls")
    found = calls.refine(found, materialize(split, "split"))
    found = calls.annotate_sites(found, support) if support is not None else found.select("*", F.lit(0).alias("nsnps"), F.lit(0.0).alias("maf"))
    levels = genotype.level_sd(windows.scale_variance(ok, here, cfg.minsize, cfg.ploidy), cfg.compat)
    records = genotype.genotype(found, levels, contigs, cfg.ploidy, control_maf, cfg.compat)
    return CallResult(lib, bins, curve, low, high, fixed, adaptive, baf, records)


def _with_maf(cfg: CallConfig, table: DataFrame, support: DataFrame | None, control: DataFrame | None) -> DataFrame:
    if support is None:
        return table.withColumn("maf", F.lit(None).cast("double"))
    sums = variants.maf_sums(table, support)
    if control is not None:
        return variants.maf_ratio(sums, cfg.snps, cfg.coverage, control=variants.maf_sums(table.select("contig", "start", "end"), control)).drop("minor", "major", "n_snps")
    return variants.maf_ratio(sums, cfg.snps, cfg.coverage, expected=variants.expected_table(table.sparkSession)).drop("minor", "major", "n_snps")


#: Bins of one contig that a task takes; beyond, the search goes over blocks, with the same breakpoints.
TASK_ROWS = 5_000_000


def segment_matrix(cfg: SegmentConfig, matrix: DataFrame, signals: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    settings = (cfg.ploidy, cfg.kchange, cfg.dpthreshold, cfg.epsilon)
    keys = [c for c in ("contig", "run") if c in matrix.columns]
    most = matrix.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= task_rows:
        return segment.segment(matrix, signals, *settings)
    named = matrix.withColumn("contig", F.concat_ws("\t", *keys))
    return segment.segment_blocks(named, signals, *settings).withColumn("contig", F.substring_index("contig", "\t", 1))


def load(spark: SparkSession, cfg: CallConfig, path: str) -> dict:
    """The inputs of call() from BAM, SAM or Parquet alignments, text sequences and intervals, VCF or BCF sites."""
    if path.rstrip("/").endswith(".parquet"):
        contigs = spark.read.parquet(path.replace(".parquet", ".contigs.parquet"))
    else:
        contigs = (bam if path.endswith(".bam") else text).read_contigs(spark, path)

    def read(path: str) -> DataFrame:
        if path.rstrip("/").endswith(".parquet"):
            return spark.read.parquet(path)
        return bam.read_bam(spark, path) if path.endswith(".bam") else text.read_sam(spark, path, contigs)

    out = {"alignments": read(path), "contigs": contigs, "reference": text.read_fasta(spark, cfg.genome), "mappability": text.read_fasta(spark, cfg.mappability)}
    if cfg.vcffile:
        out["sites"] = (bcf.read_bcf if cfg.vcffile.endswith(".bcf") else text.read_vcf)(spark, cfg.vcffile, cfg.sample)
    if cfg.controlfile:
        out["control"] = read(cfg.controlfile)
    if cfg.bed_intervals:
        out["bed"] = text.read_bed(spark, cfg.bed_intervals, contigs)
    if cfg.scan_regions:
        out["scan_regions"] = text.read_bed_union(spark, cfg.scan_regions, contigs)
    return out
