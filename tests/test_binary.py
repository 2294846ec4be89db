"""BAM and BCF: the same rows as from text, at every split size; damage is an error."""

import gzip
import random
import re
import struct

import pytest

from helixframe.schemas import ALIGNMENTS, CONTIGS
from helixframe.sources import bam, bcf, bgzf, text
from helixframe.sources.sinks import vcf_header

CONTIG_ROWS = [("chr1", 50_000), ("chr2", 9_000)]


def sam_lines(n, rng):
    lines = ["@HD\tVN:1.6", *[f"@SQ\tSN:{c}\tLN:{k}" for c, k in CONTIG_ROWS]]
    for i in range(n):
        size = rng.choice([1, 30, 75, 76, 400 if i % 50 else 70_000])
        size = min(size, 9_000)
        seq = "".join(rng.choices("ACGTN", k=size))
        qual = "".join(chr(33 + rng.randrange(60)) for _ in range(size))
        if i % 11 == 0:
            lines.append(f"u{i}\t4\t*\t0\t0\t*\t*\t0\t0\t{seq}\t{qual}")
        elif i % 13 == 0:
            lines.append(f"s{i}\t256\tchr2\t{1 + i % 8000}\t3\t10M2D5M\t*\t0\t0\t*\t*")
        elif i % 17 == 0:
            lines.append(f"q{i}\t0\tchr1\t{1 + i}\t20\t{size}M\t=\t{1 + i}\t0\t{seq}\t*")
        else:
            lines.append(f"r{i}\t99\tchr1\t{1 + i}\t60\t{size}M\tchr2\t{1 + i % 900}\t-{i}\t{seq}\t{qual}")
    return lines


def bam_bytes(lines):
    ids = {c: i for i, (c, _) in enumerate(CONTIG_ROWS)} | {"*": -1}
    head = "\n".join(x for x in lines if x[0] == "@") + "\n"
    out = [b"BAM\1", struct.pack("<i", len(head)), head.encode(), struct.pack("<i", len(CONTIG_ROWS))]
    out += [struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in CONTIG_ROWS]
    for line in lines:
        if line[0] == "@":
            continue
        q, flag, c, pos, mapq, cigar, m, mpos, isize, seq, qual = line.split("\t")
        ops = [int(n) << 4 | "MIDNSHP=X".index(o) for n, o in re.findall(r"(\d+)(\D)", cigar)]
        seq = "" if seq == "*" else seq
        four = ["=ACMGRSVTWYHKDBN".index(x) for x in seq] + [0] * (len(seq) % 2)
        score = bytes([255] * len(seq)) if qual == "*" else bytes(ord(x) - 33 for x in qual)
        body = struct.pack("<iiBBHHHiiii", ids[c], int(pos) - 1, len(q) + 1, int(mapq), 0, len(ops), int(flag), len(seq), ids[c if m == "=" else m], int(mpos) - 1, int(isize))
        body += q.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(four[::2], four[1::2])) + score + b"NMC\x02"
        out.append(struct.pack("<i", len(body)) + body)
    return b"".join(out)


@pytest.fixture(scope="module")
def both(tmp_path_factory):
    at = tmp_path_factory.mktemp("bam")
    lines = sam_lines(3_000, random.Random(5))
    (at / "in.sam").write_text("\n".join(lines) + "\n")
    (at / "in.bam").write_bytes(bgzf.compress(bam_bytes(lines))[0])
    return at


def test_bam_equals_sam(spark, both):
    contigs = bam.read_contigs(spark, str(both / "in.bam"))
    assert contigs.collect() == text.read_contigs(spark, str(both / "in.sam")).collect()
    want = [tuple(r)[1:] for r in text.read_sam(spark, str(both / "in.sam")).orderBy("ord").collect()]
    for split in (0, 20_000, 100_000, bgzf.SPLIT_BYTES):
        got = bam.read_bam(spark, str(both / "in.bam"), split)
        assert got.schema.simpleString() == spark.createDataFrame([], ALIGNMENTS).schema.simpleString()
        rows = got.orderBy("ord").collect()
        assert len({r["ord"] for r in rows}) == len(rows)
        assert [tuple(r)[1:] for r in rows] == want


def test_long_cigar_comes_from_its_tag():
    ops = [16, 17]
    body = struct.pack("<iiBBHHHiiii", 0, 0, 2, 9, 0, 2, 0, 2, -1, -1, 0) + b"a\0" + struct.pack("<II", 2 << 4 | 4, 7 << 4 | 3) + b"\x12\x05\x05"
    body += b"XZZ" + b"t\0" + b"XBBs" + struct.pack("<Ihh", 2, 1, 1) + b"CGBI" + struct.pack("<III", 2, *ops)
    got = bam.decode([struct.pack("<i", len(body)) + body], 0).to_pylist()[0]
    assert got["cigar"] == [{"op": "M", "len": 1}, {"op": "I", "len": 1}] and got["seq"] == "AC" and got["qual"] == [5, 5]


def test_empty_and_damaged_bam(spark, both, tmp_path):
    empty = tmp_path / "empty.bam"
    empty.write_bytes(bgzf.compress(bam_bytes(["@HD\tVN:1.6"]))[0])
    assert bam.read_bam(spark, str(empty)).count() == 0
    whole = bytearray((both / "in.bam").read_bytes())
    whole[len(whole) // 2] ^= 0xFF
    for name, data in (("flip.bam", whole), ("cut.bam", whole[: len(whole) // 3])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="damaged|no whole block|ends within|planned start"):
            bam.read_bam(spark, str(tmp_path / name), 0).count()
    with pytest.raises(ValueError, match="not a BAM"):
        (tmp_path / "no.bam").write_bytes(bgzf.compress(b"something else")[0])
        bam.read_header(str(tmp_path / "no.bam"))


def bcf_bytes(lines):
    header = "\n".join(x for x in lines if x[0] == "#") + "\n\0"
    out = [b"BCF\2\2", struct.pack("<I", len(header)), header.encode()]
    for line in lines:
        if line[0] == "#":
            continue
        c, pos, _, ref, alt, _, _, _, _, *gts = line.split("\t")
        alleles = [ref, *[a for a in alt.split(",") if a != "."]]
        shared = struct.pack("<iii", 0 if c == "chr1" else 1, int(pos) - 1, len(ref)) + bcf.MISSING_FLOAT + struct.pack("<II", len(alleles) << 16, 1 << 24 | len(gts))
        shared += bcf.string(".") + b"".join(bcf.string(a) for a in alleles) + bcf.descriptor(0, 0)
        codes = [[0 if a == "." else int(a) + 1 << 1 for a in re.split(r"[/|]", g)] for g in gts]
        each = bcf.integers([1]) + bcf.descriptor(bcf.INT8, 2) + b"".join(struct.pack("<bb", *(x if len(x) == 2 else [x[0], -127])) for x in codes)
        out.append(struct.pack("<II", len(shared), len(each)) + shared + each)
    return b"".join(out)


def test_bcf_equals_vcf(spark, tmp_path):
    rng = random.Random(8)
    lines = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', "##contig=<ID=chr1,length=900000>", "##contig=<ID=chr2,length=900000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"]
    for i in range(4_000):
        ref, alt = rng.choice(["A", "c", "G", "ACGTACGTACGTACGTACGT"]), rng.choice(["T", "t", "A", "G,T", "."])
        gts = [rng.choice(["0/1", "1|0", "0/0", "1/1", "./.", "./1", "1"]) for _ in range(2)]
        lines.append("\t".join(["chr1" if i < 2_500 else "chr2", str(1 + i * 3 // 2 * 2), ".", ref, alt, ".", ".", ".", "GT", *gts]))
    (tmp_path / "v.vcf").write_text("\n".join(lines) + "\n")
    (tmp_path / "v.bcf").write_bytes(bgzf.compress(bcf_bytes(lines))[0])
    for sample in ("S2", "nobody"):
        want = sorted(map(tuple, text.read_vcf(spark, str(tmp_path / "v.vcf"), sample).collect()), key=str)
        assert want
        for split in (0, 4_000):
            got = bcf.read_bcf(spark, str(tmp_path / "v.bcf"), sample, split)
            assert sorted(map(tuple, got.collect()), key=str) == want


RECORD = "id string, contig string, start int, end int, cipos_lo int, cipos_hi int, ciend_lo int, ciend_hi int, srl int, srr int, nsnps int, cn float, rds float, pty float, mpb float, maf double, oemaf double, cnl array<double>, gq int, gq_corrected int, cn_int int, ft string, precise boolean"


def call(i, contig, start, end):
    return (f"CNV{i:08d}", contig, start, end, -5, 5, -300, 40_000, 2, 0, 7, 1.0, 1.5, 0.25, 0.5, 0.5, 1.0, [-0.5 * k for k in range(10)], 40, 40, 1, "PASS", False)


def test_written_calls_and_index(spark, tmp_path):
    rows = [call(i, "chr1", 100 + 1_000 * i, 900 + 1_000 * i) for i in range(40)] + [call(90, "chr2", 10, 8_000)]
    contigs = spark.createDataFrame([(i, *c) for i, c in enumerate(CONTIG_ROWS)], CONTIGS)
    path = str(tmp_path / "o.bcf")
    bcf.write_bcf(spark.createDataFrame(rows, RECORD), contigs, path, "S1")
    data = gzip.open(path).read()
    header, first = bcf.read_header(path)
    samples, names, strings, lines = bcf.dictionaries(header)
    assert samples == ["S1"] and names == {0: "chr1", 1: "chr2"} and strings[0] == "PASS" and strings[1] == "LowQual"
    assert [x for x in lines if "ID=PASS" not in x][:-1] == vcf_header(CONTIG_ROWS, "S1")[:-1]
    with open(path, "rb") as f:
        stream = bgzf.Stream(f, first >> 16, bgzf.size_of(path))
        records = list(bgzf.read_records(stream, first & 0xFFFF, None, bcf.HEAD, bcf.length))
    assert data.endswith(b"".join(records)) and len(records) == 41
    for r, want in zip(records, rows):
        contig, pos, rlen, qual = struct.unpack_from("<iiif", r, 8)
        assert (names[contig], pos, pos + rlen, qual) == (want[1], want[2], want[3], 40.0)
        assert bcf._alleles(r) == ["N", "<CNV>"] and bcf._genotype(r, 0, next(k for k, v in strings.items() if v == "GT")) == [None, None]
    # Every record can be reached from its bin in the index.
    csi = gzip.open(path + ".csi").read()
    assert csi[:4] == b"CSI\1" and struct.unpack_from("<iiii", csi, 4) == (14, 5, 0, 2)
    at, found = 20, 0
    for contig in range(2):
        n, at = struct.unpack_from("<i", csi, at)[0], at + 4
        for _ in range(n):
            number, _, chunks = struct.unpack_from("<IQi", csi, at)
            at += 16
            for _ in range(chunks):
                low, high = struct.unpack_from("<QQ", csi, at)
                at += 16
                with open(path, "rb") as f:
                    s = bgzf.Stream(f, low >> 16, bgzf.size_of(path))
                    place = low & 0xFFFF
                    while s.has(place + 1) and s.virtual(place) < high:
                        n_bytes = bcf.length(s.get(place, 32) if s.has(place + 32) else b"")
                        assert s.has(place + n_bytes)
                        c, start, rlen = struct.unpack_from("<iii", s.get(place, n_bytes), 8)
                        assert c == contig and bcf.bin_of(start, start + rlen, 5) == number
                        found += 1
                        place += n_bytes
    assert found == 41 and at == len(csi)


def test_no_calls(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "chr1", 50)], CONTIGS)
    bcf.write_bcf(spark.createDataFrame([], RECORD), contigs, str(tmp_path / "e.bcf"), "S1")
    assert bcf.read_bcf(spark, str(tmp_path / "e.bcf")).count() == 0
