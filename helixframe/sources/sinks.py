"""Writers of window tables, allele tables, statistics, matrices, segments and VCF text; Parquet is the canonical form."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.stats import render


def rendered(df: DataFrame) -> DataFrame:
    """Floating-point columns as text with six significant digits in the shortest form."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in floats else f for f in df.schema.fields])

    def run(batches):
        for b in batches:
            columns = [pa.array([None if x is None else render(x) for x in c.to_pylist()], pa.string()) if n in floats else c for n, c in zip(b.schema.names, b.columns)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.mapInArrow(run, schema)


def tsv(df: DataFrame, path: str, null: str = "NA", compression: str = "gzip", single: bool = False) -> None:
    """Tab-separated text with a header. single asks for one file, for small results."""
    out = rendered(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue=null, emptyValue="", compression=compression)


def window_table(windows: DataFrame, sample: str) -> DataFrame:
    """contig, start, end, mappable, counts, cn, maf -> the columns of a window file."""
    maf = F.col("maf") if "maf" in windows.columns else F.lit(None).cast("double")
    return windows.select(F.col("contig").alias("chr"), "start", "end", F.col("mappable").alias(f"{sample}_mappable"), F.col("counts").alias(f"{sample}_counts"), F.col("cn").alias(f"{sample}_CN"), maf.alias(f"{sample}_MAF"))


def baf_file(baf: DataFrame, sample: str) -> DataFrame:
    return baf.select(F.col("contig").alias("chr"), "pos", F.col("ref_t").alias("refCountTarget"), F.col("alt_t").alias("altCountTarget"), F.col("baf_t").alias(f"{sample}_target_baf"), F.col("ref_c").alias("refCountControl"), F.col("alt_c").alias("altCountControl"), F.col("baf_c").alias(f"{sample}_control_baf"))


def stats_lines(library: dict, bins: DataFrame, curve: DataFrame, low: int, high: int) -> DataFrame:
    """Statistics as tagged tab-separated lines: LP library, SW scan windows, GC curve, BoundsGC bounds."""
    spark = bins.sparkSession
    head = spark.createDataFrame([("LP", "\t".join(str(library[k]) for k in ("rs", "median", "mad", "min_isize", "max_isize")))], "tag string, line string")
    line = lambda *c: F.concat_ws("\t", *[F.coalesce(F.col(x).cast("string"), F.lit("NA")) for x in c])
    sw = bins.select(F.lit("SW").alias("tag"), line("contig", "start", "end", "selected", "cov", "uniqcov").alias("line"))
    gc = rendered(curve).select(F.lit("GC").alias("tag"), line("gc", "sample", "reference", "pct_s", "pct_r", "frac_s", "frac_r", "obsexp", "coverage").alias("line"))
    tail = spark.createDataFrame([("BoundsGC", f"{low}\t{high}")], "tag string, line string")
    return head.unionByName(sw).unionByName(gc).unionByName(tail)


# Fixed names and types of the format's fields: (id, number, type, meaning).
INFO = (
    ("CIEND", "2", "Integer", "Interval of END, relative"), ("CIPOS", "2", "Integer", "Interval of POS, relative"), ("END", "1", "Integer", "End of the variant"), ("SRL", "1", "Integer", "Split reads at the left end"),
    ("SRR", "1", "Integer", "Split reads at the right end"), ("NSNPS", "1", "Integer", "Sites within"), ("MAF", "1", "Float", "Mean fraction of the rarer allele"), ("OEMAF", "1", "Float", "MAF against the expected one"),
    ("PTY", "1", "Float", "Penalty of the boundaries"), ("MPB", "1", "Float", "Callable share"), ("RDS", "1", "Float", "Read-depth support"), ("IMPRECISE", "0", "Flag", "Ends from read depth"), ("PRECISE", "0", "Flag", "Both ends from split reads"),
    ("SVTYPE", "1", "String", "Type"), ("SVMETHOD", "1", "String", "Method"),
)
FORMAT = (("GT", "1", "String", "Genotype"), ("CNL", ".", "Float", "Log10 likelihoods of copy numbers 0 to 9"), ("GQ", "1", "Integer", "Quality"), ("FT", "1", "String", "Filter"), ("CN", "1", "Integer", "Copy number"))


def vcf_header(contigs: list[tuple[str, int]], sample: str, reference: str = "", day: str = "") -> list[str]:
    """day as YYYYMMDD; what is empty gets no line."""
    out = ["##fileformat=VCFv4.2", *([f"##fileDate={day}"] if day else []), *([f"##reference={reference}"] if reference else []), '##FILTER=<ID=LowQual,Description="Quality below 15">', '##ALT=<ID=CNV,Description="Copy-number variant">']
    out += [f'##INFO=<ID={a},Number={n},Type={t},Description="{d}">' for a, n, t, d in INFO]
    out += [f'##FORMAT=<ID={a},Number={n},Type={t},Description="{d}">' for a, n, t, d in FORMAT]
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def vcf_lines(records: DataFrame, method: str = "helixframe") -> DataFrame:
    """Genotyped records -> (id, line). FILTER is always PASS; the verdict is in FT."""
    records, short = rendered(records), F.col
    info = F.concat_ws(
        ";", F.when(F.col("precise"), "PRECISE").otherwise("IMPRECISE"), F.lit("SVTYPE=CNV"), F.lit(f"SVMETHOD={method}"), F.concat(F.lit("END="), "end"), F.concat(F.lit("SRL="), "srl"), F.concat(F.lit("SRR="), "srr"), F.concat(F.lit("NSNPS="), "nsnps"),
        F.concat(F.lit("MAF="), short("maf")), F.concat(F.lit("OEMAF="), short("oemaf")), F.concat(F.lit("CIEND="), "ciend_lo", F.lit(","), "ciend_hi"), F.concat(F.lit("CIPOS="), "cipos_lo", F.lit(","), "cipos_hi"),
        F.concat(F.lit("PTY="), short("pty")), F.concat(F.lit("MPB="), short("mpb")), F.concat(F.lit("RDS="), short("rds")),
    )
    gl = F.array_join(F.transform("cnl", lambda v: _plain(v)), ",")
    entry = F.concat_ws(":", F.lit("./."), gl, F.col("gq").cast("string"), "ft", F.col("cn_int").cast("string"))
    return records.select("id", F.concat_ws("\t", "contig", (F.col("start") + 1).cast("string"), "id", F.lit("N"), F.lit("<CNV>"), F.col("gq").cast("string"), F.lit("PASS"), info, F.lit("GT:CNL:GQ:FT:CN"), entry).alias("line"))


def _plain(v):
    """Six decimals without trailing zeros, within JVM expressions."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v.cast("double")), "0+$", ""), "\\.$", "")


def write_vcf(records: DataFrame, contigs: DataFrame, path: str, sample: str, reference: str = "", day: str = "") -> None:
    """One text file: the header, then the records in order of their numbers; calls only, a few thousand a genome."""
    spark = records.sparkSession
    names = [(r["contig"], r["length"]) for r in contigs.orderBy("tid").collect()]
    head = spark.createDataFrame([(f"!{i:08d}", x) for i, x in enumerate(vcf_header(names, sample, reference, day))], "id string, line string")
    head.unionByName(vcf_lines(records)).coalesce(1).sortWithinPartitions("id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
