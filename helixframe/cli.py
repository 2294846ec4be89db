"""Command line: call, merge and segment."""

from __future__ import annotations

import argparse
import dataclasses
import datetime
import sys

from pyspark.sql import SparkSession

from helixframe import __version__
from helixframe.config import CallConfig, MergeConfig, SegmentConfig


INFO = {
    "version": f"helixframe {__version__}",
    "warranty": "helixframe comes without warranty of any kind; whoever runs it bears the risk of its results.",
    "license": "No licence text comes with this copy of helixframe; ask those you have it from before you pass it on.",
}


def _options(parser: argparse.ArgumentParser, kind) -> None:
    for f in dataclasses.fields(kind):
        if f.name in ("sex_contigs", "enough_coverage"):
            continue
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(name, dest=f.name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(name, dest=f.name, type=type(f.default) if f.default is not None else str, default=f.default)


def build() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="helixframe", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("call", help="windows, allele fractions and copy-number calls of a sample")
    _options(one, CallConfig)
    one.add_argument("input")
    many = sub.add_parser("merge", help="one matrix of many samples' windows")
    _options(many, MergeConfig)
    many.add_argument("inputs", nargs="+")
    seg = sub.add_parser("segment", help="piecewise constant levels of a matrix")
    _options(seg, SegmentConfig)
    seg.add_argument("--signals", nargs="*", help="columns to use; all after the third by default")
    seg.add_argument("input")
    for verb in INFO:
        sub.add_parser(verb, help=f"the {verb}")
    sub.add_parser("help", help="this text")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from helixframe.functions.work import materialize
    from helixframe.operators.merge import merge_tables
    from helixframe.plans import pipeline
    from helixframe.sources import bcf, sinks, text

    args = vars(build().parse_args(argv))
    if args["command"] in (*INFO, "help"):
        print(INFO.get(args["command"]) or build().format_help())
        return 0
    spark = spark or SparkSession.builder.appName("helixframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    kind = {"call": CallConfig, "merge": MergeConfig, "segment": SegmentConfig}[args["command"]]
    cfg = kind(**{f.name: args[f.name] for f in dataclasses.fields(kind) if f.name in args})
    if isinstance(cfg, CallConfig):
        if not cfg.genome or not cfg.mappability:
            print("call needs --genome and --mappability", file=sys.stderr)
            return 2
        inputs = pipeline.load(spark, cfg, args["input"])
        r = pipeline.call(cfg, **inputs)
        sinks.tsv(sinks.window_table(r.windows.orderBy("contig", "start"), cfg.sample), f"{cfg.outprefix}.fixed.cov.gz")
        sinks.tsv(sinks.window_table(r.adaptive.orderBy("contig", "start"), cfg.sample), f"{cfg.outprefix}.adaptive.cov.gz")
        if r.baf is not None:
            sinks.tsv(sinks.baf_file(r.baf.orderBy("contig", "pos"), cfg.sample), f"{cfg.outprefix}.baf.gz")
        if cfg.statsfile:
            sinks.stats_lines(r.library, r.bins, r.curve, r.low, r.high).write.mode("overwrite").csv(cfg.statsfile, sep="\t", quote="", compression="gzip")
        records = materialize(r.records, "records")
        said = {"reference": cfg.genome, "day": datetime.date.today().strftime("%Y%m%d")}
        sinks.write_vcf(records, inputs["contigs"], f"{cfg.outprefix}.vcf", cfg.sample, **said)
        bcf.write_bcf(records, inputs["contigs"], f"{cfg.outprefix}.bcf", cfg.sample, **said)
    elif isinstance(cfg, MergeConfig):
        sinks.tsv(merge_tables([text.read_windows(spark, p) for p in args["inputs"]], cfg.by_type).withColumnRenamed("contig", "chr"), cfg.outfile, null="NaN")
    else:
        matrix, signals = text.read_matrix(spark, args["input"])
        out = pipeline.segment_matrix(cfg, matrix, args["signals"] or signals)
        sinks.tsv(out.withColumnRenamed("contig", "chr").orderBy("chr", "start"), cfg.outfile)
    return 0


if __name__ == "__main__":
    sys.exit(main())
