import random

from pyspark.sql import functions as F

from helixframe.operators import reads
from helixframe.schemas import ALIGNMENTS, CONTIGS

P, R, MR = reads.PAIRED, reads.REVERSE, reads.MATE_REVERSE


def read(ord_, name, flag, pos, mpos, mapq=60, tid=0, mtid=0, cigar=(("M", 20),), isize=0, n=20):
    return (ord_, name, flag, tid, pos, mapq, list(cigar), mtid, mpos, isize, n, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, ALIGNMENTS)


def test_filters_layout_and_pairs(spark):
    rows = [
        read(1, "a", P | MR, 10, 100), read(2, "a", P | R, 100, 10),  # facing pair
        read(3, "b", P | MR, 50, 50), read(4, "b", P | R, 50, 50),  # same place: the first in file order is the first read
        read(5, "orphan", P | R, 300, 200),
        read(6, "low", P | MR, 10, 80, mapq=9), read(7, "low", P | R, 80, 10),  # first read under the quality limit
        read(8, "far", P | MR, 10, 80, mtid=1), read(9, "dup", P | MR | reads.DUPLICATE, 10, 80),
        read(10, "one", 0, 400, -1), read(11, "oneback", R, 500, -1),
    ]
    r = frame(spark, rows)
    kept = reads.mates_here(reads.min_quality(reads.drop_flagged(r), 10))
    assert {x.qname for x in reads.second_mates(kept).collect()} == {"a", "b", "one", "oneback"}
    by = {(x.qname, x.flag): x.l for x in r.select("qname", "flag", reads.layout().alias("l")).collect()}
    assert by["a", P | MR] == 2 and by["a", P | R] == 2 and by["one", 0] == 0 and by["b", P | R] == 3
    c = spark.createDataFrame([(0, "c", 1000)], CONTIGS)
    at = lambda mode, **kw: sorted(x.pos for x in reads.fragments(r, c, 10, 19, 111, mode, **kw).collect())
    # isize of a: 100 + 20 - 10 = 110; of b: 20, both strictly inside (19, 111).
    assert at("count") == [60, 65, 410, 510]
    assert at("scan") == [65, 410, 510]
    assert at("scan", single_end_layout=True) == [65, 510]
    # At the limits themselves a pair is not normal: count takes the read's own middle.
    assert sorted(x.pos for x in reads.fragments(r, c, 10, 20, 110).collect()) == [60, 110, 410, 510]


def test_consumed_once(spark):
    rows = [read(1, "x", P | MR, 10, 90), read(2, "x", P | R, 90, 10), read(3, "x", P | R, 90, 10)]
    assert reads.second_mates(frame(spark, rows)).count() == 1


def test_cigar(spark):
    texts = ["5S20M", "12S20M", "20M11H", "10M600D10M", "10M5I10M", "10M100N10M", "10S10M10S"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", reads.parse_cigar(F.col("t")).alias("cigar"))
    n = {r.i: r.n for r in rows.select("i", reads.aligned_length(F.col("cigar")).alias("n")).collect()}
    assert n == {0: 20, 1: 20, 2: 20, 3: 620, 4: 20, 5: 120, 6: 10}
    full = rows.select(F.col("i").cast("long").alias("ord"), F.lit("q").alias("qname"), F.lit(0).alias("flag"), F.lit(0).alias("tid"), (F.col("i") * 1000).alias("pos"), F.lit(60).alias("mapq"), "cigar")
    c = spark.createDataFrame([(0, "c", 10_000)], CONTIGS)
    got = {(r.pos, r.left_n, r.right_n) for r in reads.split_breakpoints(full, c, 10, 500).collect()}
    assert got == {(1000, 1, 0), (2020, 0, 1), (3010, 0, 1), (3610, 1, 0)}


def test_depth_stops(spark):
    d = reads.depth(spark.range(70_000).select(F.lit("c").alias("contig"), F.lit(5).alias("pos"))).first()
    assert d.depth == reads.MOST_DEPTH


def test_library_stats(spark):
    rng = random.Random(2)
    sizes = [rng.randint(150, 350) for _ in range(1500)]
    rows = [read(i, f"r{i}", P | MR | reads.READ1, i, i + 200, isize=s if i % 2 else -s, n=75) for i, s in enumerate(sizes)]
    got = reads.library_stats(frame(spark, rows))
    med = sorted(sizes)[750]
    mad = sorted(abs(s - med) for s in sizes)[750]
    assert (got["rs"], got["median"], got["mad"], got["min_isize"], got["max_isize"]) == (75, med, mad, max(0, med - 3 * mad), med + 3 * mad)
    assert got["meanisize"] == med // 2 * 2 + 1 and got["facing"] == 1500
    few = reads.library_stats(frame(spark, rows[:10]))
    assert (few["median"], few["mad"], few["max_isize"], few["meanisize"]) == (250, 15, 400, 251)
