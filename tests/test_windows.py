import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import bias, content, intervals, prefix, scan, windows


def bases(spark, rows):
    return spark.createDataFrame(rows, "contig string, pos long, depth long, obsexp double, expected double")


def adaptive_walk(mask, depth, size, offset):
    """One base after another, with a step back of all but `offset` callable bases."""
    at = [p for p, ok in enumerate(mask) if ok]
    out, w = [], 0
    while w * offset + size <= len(at):
        part = at[w * offset : w * offset + size]
        out.append((0 if w == 0 else at[w * offset - 1] + 1, part[-1] + 1, sum(depth[p] for p in part)))
        w += 1
    return out


@pytest.mark.parametrize(("size", "offset", "block"), [(4, 4, 7), (4, 2, 5), (5, 3, 1000)])
def test_adaptive(spark, size, offset, block):
    rng = random.Random(size * offset)
    mask, depth = [rng.random() < 0.6 for _ in range(60)], [rng.randint(0, 9) for _ in range(60)]
    rows = [("c", p, depth[p], 1.0, 2.0) for p in range(60) if mask[p]]
    got = [(r.start, r.end, r.cn) for r in windows.adaptive_windows(bases(spark, rows), size, offset, block=block).orderBy("start").collect()]
    assert got == [(s, e, pytest.approx(2 * d / (2.0 * size))) for s, e, d in adaptive_walk(mask, depth, size, offset)]


def test_fixed_and_sliding(spark):
    rows = [("c", p, 3, 1.0, 1.5) for p in range(30) if p % 3]
    c = spark.createDataFrame([("c", 30)], "contig string, length int")
    fixed = windows.fixed_windows(bases(spark, rows), c, 10, 10, 0.25).orderBy("start").collect()
    assert [(r.start, r.end, r.mappable) for r in fixed] == [(0, 10, 6), (10, 20, 7)]  # the one that ends at the contig's end is dropped
    assert fixed[0].cn == pytest.approx(4.0) and fixed[0].counts == pytest.approx(18 * 10 / 6)
    slid = windows.fixed_windows(bases(spark, rows), c, 10, 4, 0.7).collect()
    assert {r.start for r in slid} == {s for s in range(0, 20, 4) if sum(p % 3 > 0 for p in range(s, s + 10)) >= 7}


def test_bed(spark):
    rows = [("c", p, 1, 1.0, 1.0) for p in range(5, 25)]
    c = spark.createDataFrame([("c", 30)], "contig string, length int")
    bed = spark.createDataFrame([("c", 0, 4), ("c", 5, 10), ("c", 7, 30), ("c", 20, 31), ("c", 9, 9), ("c", 5, 10)], "contig string, start int, end int")
    got = {(r.start, r.end): (r.mappable, r.cn) for r in windows.bed_windows(bases(spark, rows), bed, c, 0.25, bucket=8).collect()}
    assert got == {(0, 4): (0, None), (5, 10): (5, 2.0), (7, 30): (18, 2.0)}
    apart = spark.createDataFrame([("c", 5, 9), ("c", 15, 21)], "contig string, start int, end int")
    walk = windows.bed_adaptive_windows(bases(spark, rows), apart, c, 4, 4, bucket=8, block=6).orderBy("start").collect()
    assert [(r.start, r.end) for r in walk] == [(5, 9), (15, 19)]


def test_interval_union_touching(spark):
    rows = [("c", 1, 5), ("c", 5, 8), ("c", 2, 3), ("c", 10, 12), ("c", 10, 12), ("d", 1, 2)]
    df = spark.createDataFrame(rows, "contig string, start int, end int")
    one = intervals.union_intervals(df)
    want = {("c", 1, 8), ("c", 10, 12), ("d", 1, 2)}
    assert {tuple(r) for r in one.select("contig", "start", "end").collect()} == want
    assert {tuple(r) for r in intervals.union_intervals(one).select("contig", "start", "end").collect()} == want


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join_any_bucket(spark, width):
    rng = random.Random(1)
    p, i = [("c", rng.randint(0, 200)) for _ in range(80)], [("c", s, s + rng.randint(0, 40)) for s in range(0, 200, 9)]
    got = intervals.interval_join(spark.createDataFrame(p, "contig string, pos int"), spark.createDataFrame(i, "contig string, start int, end int"), width)
    assert sorted((r.pos, r.start, r.end) for r in got.collect()) == sorted((q, s, e) for _, q in p for _, s, e in i if s <= q < e)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [3, 10, 10_000])
def test_centred_sums_and_ranks(spark, block):
    rng = random.Random(4)
    x = [rng.randint(0, 1) for _ in range(40)]
    df = spark.createDataFrame([("c", p, 40, v) for p, v in enumerate(x)], "contig string, pos int, length int, x int")
    got = [r.x_sum for r in prefix.centred_sums(df, ["x"], 2, block=block).orderBy("pos").collect()]
    assert got == [sum(x[p - 2 : p + 3]) if 2 <= p < 38 else 0 for p in range(40)]
    ones = df.filter("x = 1")
    assert [r["rank"] for r in prefix.rank_rows(ones, block=block).orderBy("pos").collect()] == list(range(sum(x)))
    run = prefix.running_sum(df, "x", "s", block=block).orderBy("pos").collect()
    assert [r.s for r in run] == [sum(x[: p + 1]) for p in range(40)]


def test_content_cases_and_edges(spark):
    ref, mark = "ACGTacgtNNCCGGTTAACGCGCGATATATGGGCCCAATT", "CCCCCCCCccccNNNNCCCCCCCCCCCCCCCCCCCCCCCC"
    seq = lambda s: spark.createDataFrame([("c", 0, s[:15]), ("c", 15, s[15:])], "contig string, block_start int, bases string")
    c = spark.createDataFrame([("c", 40)], "contig string, length int")
    got = content.content(seq(ref), seq(mark), c, 5).orderBy("pos").collect()
    for r in got:
        inside = 2 <= r.pos < 38
        assert r.gc == (sum(b in "CcGg" for b in ref[r.pos - 2 : r.pos + 3]) if inside else 0)
        assert r.uniq == (mark[r.pos - 2 : r.pos + 3].count("C") if inside else 0)
    # Single precision: 0.96 * 25 is not over 24.
    assert spark.range(1).select(F.lit(24).alias("uniq")).filter(content.unique_enough(0.96, 25)).count() == 1


def test_median(spark):
    for values, want in (([1, 2, 3, 4], 3), ([1, 2, 3, 4, 5], 3), ([7], 7), ([], None)):
        df = spark.createDataFrame([(v,) for v in values], "x int")
        assert df.agg(stats.upper_median("x")).first()[0] == want
    assert tuple(stats.median_mad(spark.createDataFrame([(1,), (2,), (10,), (11,)], "x int"), "x").first()) == (10, 8)
    assert tuple(stats.median_mad(spark.createDataFrame([], "x int"), "x").first()) == (None, None)


def test_curve(spark):
    rows = [(1, 4), (1, 6), (2, 10), (4, 0)]
    c = bias.curve(spark.createDataFrame(rows, "gc int, depth long"), 6)
    got = {r.gc: r for r in c.collect()}
    assert got[1].coverage == 5.0 and got[0].coverage == 0.0 and got[1].frac_r == 0.5 and got[2].pct_s == 1.0 and got[3].obsexp == 1.0
    assert tuple(bias.bounds(c, 0.05).first()) == (0, 2)
    inner = {r.gc: r for r in bias.renormalised(c, 0, 2).collect()}
    assert inner[1].frac_s == 1.0 and inner[2].frac_s == 0.0 and inner[2].obsexp == 1.0 and inner[2].coverage == 10.0
    empty = bias.curve(spark.createDataFrame([], "gc int, depth long"), 3)
    low, high = bias.bounds(empty, 0.05).first()
    assert low == 2 and high == 3


def test_scan_selection(spark):
    rows = [("c", i * 10, i * 10 + 10, cov, u) for i, (cov, u) in enumerate([(10, 10), (12, 12), (11, 11), (50, 50), (11, 2), (0, 0)])]
    b = spark.createDataFrame(rows, "contig string, start int, end int, cov long, uniqcov long")
    chosen = {r.start for r in scan.select_windows(b, 0.8).filter("selected").collect()}
    # Medians over unique windows 10, 11, 12, 50: 12, MAD 2; strictly between 10 and 14.
    assert chosen == {10, 20}
    assert scan.select_windows(b, 0.8, keep_all=True).filter("selected").count() == 6
    assert scan.select_windows(b.limit(0), 0.8).count() == 0
    assert {r.start for r in scan.select_windows(b, 2.0).filter("selected").collect()} == set()


def test_small_contigs_after_enough_coverage(spark):
    c = spark.createDataFrame([(0, "small0", 5), (1, "big", 100), (2, "chrX", 100), (3, "small1", 5)], "tid int, contig string, length int")
    cov = spark.createDataFrame([("small0", 3), ("big", 20), ("small1", 3)], "contig string, cov long")
    assert {r.contig for r in scan.scanned_contigs(c, cov, 50, ("chrX",), 10).collect()} == {"small0", "big"}


def test_scale_variance(spark):
    rng = random.Random(9)
    depth = [rng.randint(5, 15) for _ in range(100)]
    c = spark.createDataFrame([("c", 100)], "contig string, length int")
    got = {r.ws: (r.dev, r.n) for r in windows.scale_variance(bases(spark, [("c", p, d, 1.0, 10.0) for p, d in enumerate(depth)]), c, 8, most=40).collect()}
    for ws in (8, 16, 32):
        x = [2 * sum(depth[s : s + ws]) / (10 * ws) - 2 for s in range(0, 100, ws) if s + ws < 100]
        assert got[ws] == (pytest.approx(sum(v * v for v in x)), len(x))


def test_small_functions(spark):
    assert stats.render(0.5) == "0.5" and stats.render(None) == "NA" and stats.render(123456789.0) == "1.23457e+08" and stats.render(3.0) == "3"
    assert stats.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0) and stats.binomial_two_sided(0, 10, 0.5) == pytest.approx(2 / 1024)
    assert stats.percent_identity("ACGT", [("M", 4)], "ACGA", 0) == 0.75
    row = spark.createDataFrame([("AACC",)], "s string").select(stats.entropy(F.col("s")).alias("e"), stats.holds_n(F.col("s")).alias("n")).first()
    assert row.e == pytest.approx(1.0) and not row.n
