"""Operators that work block by block against naive walks over the whole contig, at several block sizes."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import content, prefix, reads, variants


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("tile", [4, 16, 1000])
@pytest.mark.parametrize("half", [0, 2, 7])
def test_block_sums(spark, tile, half):
    rng = random.Random(tile + half)
    texts = {c: "".join(rng.choice("acgtACGTN漢") for _ in range(n)) for c, n in (("a", 53), ("b", 16), ("c", 1))}
    gone = set(range(20, 27))  # the second sequence lacks these of contig a
    blocks = lambda keep: [(c, len(t), p, t[p : p + 5]) for c, t in texts.items() for p in range(0, len(t), 5) if keep(c, p)]
    frame = lambda rows: spark.createDataFrame(rows, "contig string, length int, block_start int, bases string")
    one, two = frame(blocks(lambda c, p: True)), frame(blocks(lambda c, p: c != "a" or p not in gone))
    got = {(r.contig, r.pos): (r.gc, r.uniq) for r in content.block_sums({"gc": (one, "cCgG"), "uniq": (two, "C漢")}, half, tile).collect()}
    want = {}
    for c, t in texts.items():
        for p in range(len(t)):
            if c == "a" and p // 5 * 5 in gone:
                continue
            whole = half <= p < len(t) - half
            span = range(p - half, p + half + 1)
            want[c, p] = (sum(t[q] in "cCgG" for q in span), sum(t[q] in "C漢" and not (c == "a" and q // 5 * 5 in gone) for q in span)) if whole else (0, 0)
    assert got == want


def test_block_sums_shuffle_text_only(spark):
    one = spark.createDataFrame([("a", 8, 0, "ACGTACGT")], "contig string, length int, block_start int, bases string")
    said = plan(content.block_sums({"gc": (one, "cCgG")}, 1))
    assert "posexplode" not in said and said.split("== Physical Plan ==")[1].count("Exchange") == 1


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_ranked_sums_and_islands(spark, block):
    rng = random.Random(block)
    rows = [(c, p, rng.randint(0, 9), rng.randint(0, 9)) for c in "ab" for p in sorted(rng.sample(range(120), 50))]
    df = spark.createDataFrame(rows, "contig string, pos long, x long, y long")
    got = {(r.contig, r.pos): (r["rank"], r.x_before, r.y_before) for r in prefix.ranked_sums(df, ["x", "y"], block=block).collect()}
    for c in "ab":
        own = [r for r in rows if r[0] == c]
        for k, r in enumerate(own):
            assert got[c, r[1]] == (k, sum(q[2] for q in own[:k]), sum(q[3] for q in own[:k]))
    for gap in (1, 3, 8):
        for again in (df, df.unionByName(df)):
            found = {}
            for r in prefix.islands(again, gap, block=block).collect():
                found.setdefault((r.contig, r.island), set()).add(r.pos)
            want = []
            for c in "ab":
                for _, p, _, _ in (r for r in rows if r[0] == c):
                    if want and want[-1][0] == c and p - max(want[-1][1]) <= gap:
                        want[-1][1].add(p)
                    else:
                        want.append((c, {p}))
            assert sorted((c, sorted(s)) for (c, _), s in found.items()) == sorted((c, sorted(s)) for c, s in want)


def test_first_rows(spark):
    ords = [(s << 33) + k for s in (0, 1, 2, 5) for k in range(0, 5000, 3)]
    df = spark.createDataFrame([(o,) for o in ords], "ord long").repartition(5)
    for n in (0, 1, 2, 700, 1667, 1668, 4000, len(ords) - 1, len(ords), len(ords) + 9):
        first = prefix.first_rows(df, n)
        assert sorted(r.ord for r in first.collect()) == ords[:n]
        assert "Sort" not in plan(first) and "TakeOrdered" not in plan(first)
    assert prefix.first_rows(df.limit(0), 4).count() == 0


def walk(pos, cigar):
    """Reference place -> place in the read."""
    out, r, q = {}, pos, 0
    for op, n in cigar:
        if op in "M=X":
            out |= {r + k: q + k for k in range(n)}
        r += n if op in "M=XDN" else 0
        q += n if op in "M=XIS" else 0
    return out, q


@pytest.mark.parametrize("bucket", [4, 64, 1024])
def test_pileup(spark, bucket):
    rng = random.Random(bucket)
    genome = {c: "".join(rng.choice("ACGTacgt") for _ in range(300)) for c in ("x", "y")}
    sites = {(c, p): (genome[c][p].upper() if rng.random() < 0.8 else "A", rng.choice("ACGT")) for c in genome for p in rng.sample(range(300), 60)}
    rows, want = [], {k: [0, 0] for k in sites}
    for k in range(400):
        tid = rng.randrange(2)
        c, pos = "xy"[tid], rng.randint(0, 250)
        cigar = [(rng.choice("MM=XDNIS"), rng.randint(1, 9)) for _ in range(rng.randint(1, 6))] + [("H", 3)]
        at, n = walk(pos, cigar)
        seq, qual = "".join(rng.choice("ACGTacgt") for _ in range(n)), [rng.randint(0, 30) for _ in range(n)]
        flag, mapq = rng.choice([0, 0, 0, 16, 1024, 4]), rng.choice([5, 10, 60])
        rows.append((k, f"r{k}", flag, tid, pos, mapq, cigar, -1, -1, 0, n, seq, qual))
        if flag in (0, 16) and mapq >= 10:
            for (sc, sp), (ref, alt) in sites.items():
                if sc == c and sp in at and genome[c][sp].upper() == ref and qual[at[sp]] >= 10:
                    base = seq[at[sp]].upper()
                    want[sc, sp][1 if base == alt else 0] += base in (ref, alt)
    r = spark.createDataFrame(rows, "ord long, qname string, flag int, tid int, pos int, mapq int, cigar array<struct<op:string,len:int>>, mtid int, mpos int, isize int, l_qseq int, seq string, qual array<tinyint>")
    v = spark.createDataFrame([(c, p, a, b) for (c, p), (a, b) in sites.items()], "contig string, pos int, ref string, alt string")
    contigs = spark.createDataFrame([(0, "x", 300), (1, "y", 300)], "tid int, contig string, length int")
    for width in (7, 300):
        seq = spark.createDataFrame([(c, p, t[p : p + width]) for c, t in genome.items() for p in range(0, 300, width)], "contig string, block_start int, bases string")
        out = variants.pileup(r, v, contigs, seq, 10, 10, bucket)
        assert {(x.contig, x.pos): [x.ref_n, x.alt_n] for x in out.collect()} == want
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_base_at_edges(spark):
    df = spark.createDataFrame([(10, [("S", 2), ("M", 3), ("D", 2), ("M", 1)], p) for p in range(8, 18)], "pos int, cigar array<struct<op:string,len:int>>, p int")
    assert [r.k for r in df.select("p", reads.base_at(F.col("p")).alias("k")).orderBy("p").collect()] == [None, None, 2, 3, 4, None, None, 5, None, None]
