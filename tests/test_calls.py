import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import calls, genotype, merge, segment, variants


def test_genotype_quality(spark):
    rows = [(2.0, 0.5), (1.02, 0.5), (1.02, 0.2), (1.02, 0.12), (1.02, 0.1), (2.0, 1e-6)]
    df = spark.createDataFrame(rows, "cn double, sd double").withColumn("l", genotype.likelihoods(F.col("cn"), F.col("sd")))
    got = [r[0] for r in df.select(genotype.quality(F.col("l.pl"))).collect()]
    assert got[1:5] == [7, 51, 145, 0]  # 0: the others' chances vanish beside 1
    fixed = [r[0] for r in df.select(genotype.quality(F.col("l.pl"), False)).collect()]
    assert fixed[4] >= 145 and fixed[1] == 7 and all(x is not None for x in fixed)
    best = [int(np.argmax(r[0])) for r in df.select("l.gl").collect()]
    assert best == [2, 1, 1, 1, 1, 2]


def test_sd_lookup(spark):
    v = spark.createDataFrame([(500, 0.3, 4), (1000, 9.0, 4), (2000, 0.1, 1)], "ws int, dev double, n long")
    levels = genotype.level_sd(v)
    c = spark.createDataFrame([(900,), (1000,), (1999,), (3000,), (9000,)], "size int")
    got = [r.sd for r in genotype.with_sd(c, levels).orderBy("size").collect()]
    assert got == [pytest.approx(0.1), 0.5, 0.5, 0.5, 0.5]  # 3.0 and single windows stop at 0.5


def test_split_peaks():
    pos = np.array([10, 12, 500, 700, 900, 905])
    left, right = np.array([5, 6, 3, 4, 8, 0]), np.array([0, 0, 0, 0, 0, 9])
    p, v = calls.peak_positions(pos, left, right, 100)
    assert p.tolist() == [12, 700] and v.tolist() == [6, 4]  # 3 is too few; left and right at 900 are one small indel


def planted(seed=1):
    rng = np.random.default_rng(seed)
    d = rng.poisson(30, 60_000).astype(float)
    d[20_000:25_000], d[40_000:45_000] = rng.poisson(15, 5_000), rng.poisson(60, 5_000)
    return d


def test_planted_calls(spark):
    d = planted()
    rows = [("c", i, float(x), 30.0) for i, x in enumerate(d)] + [("flat", i, 30.0, 30.0) for i in range(20_000)]
    import pandas as pd

    got = calls.cnv_calls(spark.createDataFrame(pd.DataFrame(rows, columns=["contig", "pos", "depth", "expected"])), 500).orderBy("start").collect()
    assert [r.contig for r in got] == ["c", "c"]
    for r, (s, e, cn) in zip(got, ((20_000, 25_000, 1), (40_000, 45_000, 4))):
        assert abs(r.start - s) < 100 and abs(r.end - e) < 100 and round(r.cn) == cn
        assert r.cipos_lo <= r.start <= r.cipos_hi and r.ciend_lo <= r.end <= r.ciend_hi


def test_refine_and_sites(spark):
    c = spark.createDataFrame([("c", 100, 300, 90, 110, 290, 310)], "contig string, start int, end int, cipos_lo int, cipos_hi int, ciend_lo int, ciend_hi int")
    b = spark.createDataFrame([("c", 95, 5), ("c", 110, 5), ("c", 112, 50), ("c", 300, 1)], "contig string, pos int, support int")
    r = calls.refine(c, b).first()
    assert (r.start, r.srl, r.end, r.srr) == (95, 5, 300, 0)
    s = spark.createDataFrame([("c", 150, 6, 2), ("c", 160, 0, 0), ("c", 300, 5, 5)], "contig string, pos int, ref_n int, alt_n int")
    a = calls.annotate_sites(c, s).first()
    assert a.nsnps == 1 and a.maf == 0.25


def test_variants(spark):
    rows = [("c", 1, 0, 0), ("c", 2, 11, 0), ("c", 3, 8, 3), ("c", 4, 5, 6), ("c", 5, 6, 5), ("c", 6, 5, 5)]
    s = spark.createDataFrame(rows, "contig string, pos int, ref_n int, alt_n int")
    assert {r.pos for r in variants.het_sites(s, 10).collect()} == {3, 4, 5}
    assert {r.pos for r in variants.het_sites(s, 10, control=True).collect()} == {4, 5}
    assert variants.mean_folded(s.filter("pos in (1, 6)")).first()[0] == 0.5  # no reads, no say
    t = {r.pos: r for r in variants.baf_table(s).collect()}
    assert set(t) == {2, 3, 4, 5, 6} and t[3].baf_t == pytest.approx(3 / 11) and t[3].baf_c == 0.5
    w = spark.createDataFrame([("c", 3, 6), ("c", 50, 60)], "contig string, start int, end int")
    m = variants.maf_sums(w, s, 4)
    got = {r.start: r.maf for r in variants.maf_ratio(m, 3, 10, expected=variants.expected_table(spark, 50)).collect()}
    assert got[3] == pytest.approx((13 / 33) / variants.expected_folded(11)) and got[50] is None
    assert variants.expected_folded(1) == 0.0 and variants.expected_folded(2) == pytest.approx(0.25)
    assert {r.start: r.maf for r in variants.maf_ratio(m, 3, 10, control=m).collect()} == {3: 1.0, 50: None}


def test_merge(spark):
    cols = lambda s: f"chr string, start int, end int, {s}_mappable int, {s}_counts double, {s}_CN double, {s}_MAF double"
    a = spark.createDataFrame([("c2", 0, 10, 5, 1.0, 2.0, None), ("c1", 0, 10, 5, None, None, None)], cols("s_one"))
    b = spark.createDataFrame([("c1", 0, 10, 5, 1.0, 3.0, None), ("c3", 5, 5, 5, 1.0, 1.0, None), ("c1", 10, 20, 5, 4.0, 1.5, None)], cols("two"))
    got = [tuple(r) for r in merge.merge_tables([a, b]).collect()]
    assert got == [("c2", 0, 10, 2.0, None), ("c1", 0, 10, None, 3.0), ("c1", 10, 20, None, 1.5)]
    assert merge.merge_tables([a, b]).columns == ["contig", "start", "end", "s_one", "two"]
    assert [r.two for r in merge.merge_tables([a, b], "counts").collect()] == [None, 1.0, 4.0]


def test_segments(spark):
    rng = np.random.default_rng(0)
    y = np.r_[np.zeros(25), np.full(20, 2.0), np.full(15, -1.0)][:, None] + rng.normal(0, 0.05, (60, 2))
    cuts = segment.choose(y, segment.change_points(y, 20), 20)
    assert {24, 44} <= set(cuts)
    assert segment.segment_contig(np.arange(2), np.arange(2) + 1, np.array([[0.0], [5.0]])) == [(0, 2, 5.0)]  # too few rows for a break
    assert segment.levels(np.array([[1.0], [1.0], [1.0], [9.0]]), [3]) == [9.0]  # repeats in a row count once
    assert segment.undo_breaks(np.r_[np.zeros(20), np.ones(20)][:, None] + rng.normal(0, 0.1, (40, 1)), [9, 19], 2.0) == [19]
    rows = [("c", i, i + 1, None if i == 0 else float(2 + y[i, 0]), float(2 + y[i, 1])) for i in range(60)] + [("d", 0, 1, 3.0, 3.0)]
    out = segment.segment(spark.createDataFrame(rows, "contig string, start long, end long, a double, b double"), ["a", "b"], k=20).orderBy("contig", "start").collect()
    assert out[-1].contig == "d" and out[-1].cn == 3.0
    c = [r for r in out if r.contig == "c"]
    assert {25, 45} <= {r.start for r in c} and c[0].start == 0 and c[-1].end == 60
    assert all(a.end == b.start for a, b in zip(c, c[1:]))


def test_lars_against_design_matrix():
    """The first step by explicit centred columns."""
    rng = np.random.default_rng(3)
    y = rng.normal(0, 1, (12, 2))
    n, w = 12, segment.weights(12)
    x = np.array([[w[j] if i > j else 0.0 for j in range(n - 1)] for i in range(n)])
    x -= x.mean(axis=0)
    first = int(np.argmax(((x.T @ (y - y.mean(axis=0))) ** 2).sum(axis=1)))
    assert segment.change_points(y, 1)[0] == first


def test_expected_folded():
    """By enumeration: the mean of min(k, d - k) / d over fair coins, ties of nothing left out."""
    for d in range(2, 20):
        assert 0 < variants.expected_folded(d) <= 0.5
    assert variants.expected_folded(19) > variants.expected_folded(3)


def test_binomial_equals_enumeration(spark):
    rows = [(k, n) for n in (0, 1, 2, 7, 30) for k in range(n + 1)]
    got = {(r.k, r.n): r.p for r in variants.binomial_test(spark.createDataFrame(rows, "k long, n long"), "k", "n").collect()}
    for k, n in rows:
        want = sum(math.comb(n, i) for i in range(n + 1) if math.comb(n, i) <= math.comb(n, k)) / 2**n
        assert math.isclose(got[k, n], want, rel_tol=1e-9)


def test_contrast_scores_equal_plain_loops():
    rng = np.random.default_rng(4)
    depth, expected = rng.poisson(np.r_[np.full(300, 2.0), np.full(250, 5.0), np.full(300, 2.0)]).astype(float), rng.uniform(1.8, 2.2, 850)
    units = np.floor(expected * calls.UNIT).astype(np.int64)
    got, want = calls.score_block(0, depth.astype(np.int64), units, 0, 850, 850, calls.scales(60)), np.zeros(850)
    away = lambda x: math.copysign(math.floor(abs(x) + 0.5), x)
    for s in calls.scales(60):
        for at in range(s, 850 - s - 100):
            a, b = (2 * depth[lo : lo + s].sum() / expected[lo : lo + s].sum() for lo in (at - s + 1, at + 101))
            shift = away(abs(a - b))
            off = abs(abs(a - b) - shift) + abs(a - away(a)) + abs(b - away(b))
            want[at + 50] += shift * (shift - off) if shift >= 1 and off < 1 - 1e-6 else 0
    want[want < 1.5] = 0
    assert np.allclose(got, want, atol=1e-3) and (want > 0).sum() > 20
