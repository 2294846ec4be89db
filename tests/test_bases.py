"""Allele support from pieces of reads: what the plan holds, and pieces and counts against plain walks."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.operators import bases, variants
from helixframe.plans import queries as own

from .conftest import DATA
from .test_blocks import plan, walk

READS = "ord long, qname string, flag int, tid int, pos int, mapq int, cigar array<struct<op:string,len:int>>, mtid int, mpos int, isize int, l_qseq int, seq string, qual array<tinyint>"


def batches(rows, step=7):
    """Rows as Arrow batches cut out of one, so that offsets don't start at 0."""
    kinds = [("contig", pa.string()), ("pos", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("seq", pa.string()), ("qual", pa.list_(pa.int8()))]
    whole = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])
    return [whole.slice(at, step) for at in range(0, len(rows), step)]


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        cigar = [(rng.choice("MM=XDNISHP"), rng.randint(0, 90)) for _ in range(rng.randint(0, 6))]
        size = walk(0, cigar)[1]
        seq, qual = "".join(rng.choice("ACGTNacgtn") for _ in range(size)), [rng.randint(0, 30) for _ in range(size)]
        seq, qual = rng.choice([(seq, qual)] * 6 + [(None, qual), (seq, None), (seq[: size // 2], qual), (seq, qual[: size // 2]), (seq.replace("A", "漢"), qual), (seq, [None if q > 25 else q for q in qual])])
        rows.append((rng.choice("xy"), rng.randint(-30, 300), [{"op": o, "len": k} for o, k in cigar] if rng.random() < 0.95 else None, seq, qual))
    return rows


def plainly(rows, least):
    """{(contig, place): letters} of the bases that count."""
    out = {}
    for contig, pos, cigar, seq, qual in rows:
        for p, k in walk(pos, [(c["op"], c["len"]) for c in cigar or []])[0].items():
            if p >= 0 and k < len(seq or "") and k < len(qual or []) and (qual[k] if qual[k] is not None else -1) >= least:
                out.setdefault((contig, p), Counter())[seq[k].upper() if seq[k].isascii() else "?"] += 1
    return out


@pytest.mark.parametrize("letters", [1, 200, 1 << 20])
def test_pieces(monkeypatch, letters):
    monkeypatch.setattr(bases, "LETTERS", letters)
    rows, got = made(letters), {}
    for b in bases.cut(10)(iter(batches(rows))):
        for r in b.to_pylist():
            assert r["word"] * 64 <= r["lo"] < r["lo"] + len(r["letters"]) <= (r["word"] + 1) * 64
            for k, c in enumerate(r["letters"]):
                if c != " ":
                    got.setdefault((r["contig"], r["lo"] + k), Counter())[c] += 1
    assert got == plainly(rows, 10) and got


@pytest.mark.parametrize("held", [3, 1 << 20])
def test_counts_at_marks(monkeypatch, held):
    """Also where a task holds few counts: rows are then given in parts, with equal sums."""
    monkeypatch.setattr(bases, "HELD", held)
    rows, rng = made(5, 200), random.Random(9)
    marks = {(c, w): rng.choice([rng.getrandbits(64), 1 << 63, 1, (1 << 64) - 1]) for c in "xy" for w in range(20)}
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    met = (b.append_column("marks", pa.array([signed(marks[r["contig"], r["word"]]) for r in b.to_pylist()], pa.int64())) for b in bases.cut(10)(iter(batches(rows))))
    got, parts = {}, 0
    for b in bases.count(met):
        parts += 1
        for r in b.to_pylist():
            got.setdefault((r["contig"], r["pos"]), Counter())[r["base"]] += r["n"]
    assert got == {(c, p): n for (c, p), n in plainly(rows, 10).items() if marks[c, p // 64] >> p % 64 & 1} and got
    assert parts > 1 if held == 3 else parts == 1
    assert not list(bases.count(iter([]))) and not list(bases.cut(10)(iter([])))


def test_deep_places_leave_a_task_as_counts(spark):
    """3,000 reads over one place: a few rows are shuffled, and no lambda runs over a bucket's sites for each read."""
    rows = [(k, f"r{k}", 0, 0, 60, 60, [("M", 10)], -1, -1, 0, 10, "ACGTACGTAC"[k % 4 :] + "AAAA"[: k % 4], [30] * 10) for k in range(3_000)]
    r = spark.createDataFrame(rows, READS).repartition(2)
    v = spark.createDataFrame([("x", p, "ACGT"[p % 4], "ACGT"[(p + k) % 4]) for p in range(200) for k in (1, 2)], "contig string, pos int, ref string, alt string")
    seq = spark.createDataFrame([("x", 0, "ACGT" * 50)], "contig string, block_start int, bases string")
    out = variants.pileup(r, v, spark.createDataFrame([(0, "x", 200)], "tid int, contig string, length int"), seq, 10, 10)
    assert "lambdafunction" not in plan(out) and "explode" not in plan(out)
    want = {}
    for _, _, _, _, pos, *_, letters, _ in rows:
        for k, c in enumerate(letters):
            want.setdefault(pos + k, Counter())[c] += 1
    got = out.collect()
    assert len(got) == 400
    for x in got:
        n = want.get(x.pos, Counter())
        assert (x.ref_n, x.alt_n) == (n[x.ref], n[x.alt])


def test_query_reads_lines_twice(spark):
    """Once for the days, written before, and once for the reads; four times before."""
    said = plan(own.QUERIES["pileup"](spark, DATA)).split("== Physical Plan ==")[1]
    assert said.count("lineitem.parquet") == 1


def test_qualities_from_hashes(spark):
    from hashlib import md5

    from helixframe.plans import views

    rows = views.records(spark, DATA).select(F.expr("ord & ((1L << 33) - 1)").alias("key"), "line", "qual").limit(300).collect()
    for r in rows:
        key = f"{r.key // 8}-{r.line}"
        assert r.qual == [2 * int(c, 16) for i in range(2) for c in md5(f"q{i}{key}".encode()).hexdigest()]
