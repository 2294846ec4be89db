import glob
import gzip
import os
import random
import struct

from helixframe import cli
from helixframe.sources import bcf, bgzf
from helixframe.streaming import depth as stream


def write_inputs(tmp):
    rng = random.Random(11)
    n = 24_000
    ref = "".join(rng.choice("ACGT") for _ in range(n))
    fasta = lambda s: ">chr1 test\n" + "\n".join(s[i : i + 80] for i in range(0, n, 80)) + "\n"
    (tmp / "ref.fa").write_text(fasta(ref))
    (tmp / "map.fa").write_text(fasta("C" * n))
    lines = ["@HD\tVN:1.6", f"@SQ\tSN:chr1\tLN:{n}", "@SQ\tSN:chr2\tLN:900"]
    recs = []
    for i in range(9_000):
        a = rng.randint(0, n - 400)
        if 9_000 <= a < 12_000 and rng.random() < 0.5:
            continue
        size = rng.randint(240, 260)
        b = a + size - 50
        recs += [(a, f"r{i}\t{0x1 | 0x20 | 0x40}\tchr1\t{a + 1}\t60\t50M\t=\t{b + 1}\t{size}\t{ref[a:a+50]}\t{'I' * 50}"), (b, f"r{i}\t{0x1 | 0x10 | 0x80}\tchr1\t{b + 1}\t60\t50M\t=\t{a + 1}\t-{size}\t{ref[b:b+50]}\t{'I' * 50}")]
    (tmp / "in.sam").write_text("\n".join([*lines, *[r for _, r in sorted(recs)]]) + "\n")
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    vcf = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]
    vcf += [f"chr1\t{p + 1}\t.\t{ref[p]}\t{other[ref[p]]}\t.\tPASS\t.\tGT\t{'0/1' if p % 200 else '1/1'}" for p in range(100, n, 100)]
    (tmp / "sites.vcf").write_text("\n".join(vcf) + "\n")


def read_gz(path):
    return [line.rstrip("\n").split("\t") for f in sorted(glob.glob(f"{path}/part-*")) for line in gzip.open(f, "rt")]


def test_three_commands(spark, tmp_path):
    write_inputs(tmp_path)
    t = lambda x: str(tmp_path / x)
    args = ["call", t("in.sam"), "--genome", t("ref.fa"), "--mappability", t("map.fa"), "--sample", "S1", "--outprefix", t("o"), "--window-size", "1000", "--window-offset", "1000", "--scan-window", "1000", "--vcffile", t("sites.vcf"), "--statsfile", t("stats")]
    assert cli.main(args, spark) == 0
    rows = read_gz(t("o.fixed.cov.gz"))
    assert rows[0] == ["chr", "start", "end", "S1_mappable", "S1_counts", "S1_CN", "S1_MAF"]
    cn = {int(r[1]): float(r[5]) for r in rows[1:]}
    assert 1.6 < cn[3000] < 2.4 and 0.6 < cn[10_000] < 1.4
    assert read_gz(t("o.adaptive.cov.gz"))[0] == rows[0]
    assert {r[0] for r in read_gz(t("stats"))} == {"LP", "SW", "GC", "BoundsGC"}
    vcf = [x for f in glob.glob(t("o.vcf") + "/part-*") for x in open(f)]
    assert vcf[0].startswith("##fileformat") and vcf[1][:11] == "##fileDate=" and len(vcf[1].strip()) == 19 and vcf[2].startswith("##reference=") and sum(x.startswith("##INFO") for x in vcf) == 15
    calls = [x.split("\t") for x in vcf if x[0] != "#"]
    header, first = bcf.read_header(t("o.bcf"))
    with open(t("o.bcf"), "rb") as f:
        stream = bgzf.Stream(f, first >> 16, bgzf.size_of(t("o.bcf")))
        records = list(bgzf.read_records(stream, first & 0xFFFF, None, bcf.HEAD, bcf.length))
    assert [struct.unpack_from("<i", r, 12)[0] + 1 for r in records] == [int(c[1]) for c in calls] and os.path.exists(t("o.bcf.csi"))
    assert cli.main(["merge", t("o.fixed.cov.gz"), t("o.adaptive.cov.gz"), "--outfile", t("m.gz")], spark) == 0
    merged = read_gz(t("m.gz"))
    assert merged[0][:3] == ["chr", "start", "end"]
    assert cli.main(["segment", t("m.gz"), "--outfile", t("seg.gz")], spark) == 0
    seg = read_gz(t("seg.gz"))
    assert seg[0] == ["chr", "start", "end", "cn"] and len(seg) > 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [("c", p) for p in (1, 1, 5, 9, 30, 31)]
    spark.createDataFrame(rows, "contig string, pos int").write.parquet(str(tmp_path / "in"))
    for i, (make, want) in enumerate((
        (lambda s: stream.stream_depth(s), {("c", 1, 2), ("c", 5, 1), ("c", 9, 1), ("c", 30, 1), ("c", 31, 1)}),
        (lambda s: stream.stream_windows(s, 10, 10), {("c", 0, 10, 4), ("c", 30, 40, 2)}),
        (lambda s: stream.stream_sessions(s, 5), {("c", 1, 10, 4), ("c", 30, 32, 2)}),
    )):
        source = spark.readStream.schema("contig string, pos int").parquet(str(tmp_path / "in"))
        q = make(source).writeStream.outputMode("complete" if i < 2 else "complete").format("memory").queryName(f"s{i}").start()
        q.processAllAvailable()
        q.stop()
        assert {tuple(r) for r in spark.table(f"s{i}").collect()} == want


def test_words_about_the_program(capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.startswith("helixframe ")
    assert cli.main(["help"]) == 0 and "segment" in capsys.readouterr().out
