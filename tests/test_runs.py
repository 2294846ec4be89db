"""Runs of contigs in a file, levels, expansion, identity over reads, the genome axis, pairing over a stream."""

import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe import cli
from helixframe.functions import stats
from helixframe.operators import axis, reads, segment, variants
from helixframe.sources import text
from helixframe.streaming.pairs import stream_seconds


def test_matrix_with_a_contig_that_comes_again(spark, tmp_path):
    path = str(tmp_path / "m.tsv")
    rows = [(c, k, k + 1, x) for c, x in (("a", 1.0), ("b", 5.0), ("a", 9.0)) for k in range(3)]
    with open(path, "w") as f:
        f.write("chr\tstart\tend\ts\n" + "".join(f"{c}\t{a}\t{b}\t{x}\n" for c, a, b, x in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("40", old):  # with 40 bytes a split, runs go over several
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            matrix, signals = text.read_matrix(spark, path)
            got = sorted(tuple(r) for r in segment.segment(matrix, signals).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert signals == ["s"] and matrix.select("run").distinct().count() == 3
        assert got == [("a", 0, 3, 1.0), ("a", 0, 3, 9.0), ("b", 0, 3, 5.0)]  # three rows are one segment


@pytest.mark.parametrize("shift", [1, 3, 33])
def test_contig_runs(spark, shift):
    rng = random.Random(shift)
    names = [c for _ in range(30) for c in [rng.choice("ab")] * rng.randint(1, 9)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(names)], "ord long, contig string").repartition(4)
    want, run = [], 0
    for k, c in enumerate(names):
        run += k > 0 and names[k - 1] != c
        want.append((k, c, run))
    assert sorted(tuple(r) for r in segment.contig_runs(df, shift=shift).collect()) == want
    assert segment.contig_runs(df.limit(0)).count() == 0


def test_levels_and_expand(spark):
    rng = random.Random(1)
    rows = [("c", k // 10, k, float(rng.randint(0, 2)), float(rng.randint(0, 2))) for k in range(60)]
    df = spark.createDataFrame(rows, "contig string, part int, at int, x double, y double")
    import numpy as np

    got = {r.part: r.level for r in segment.run_levels(df, ["contig", "part"], "at", ["x", "y"]).collect()}
    assert got == dict(enumerate(segment.levels(np.array([r[3:] for r in rows]), [9, 19, 29, 39, 49, 59])))
    s = spark.createDataFrame([("c", 0, 30, 1.0), ("c", 30, 60, 2.0), ("d", 0, 5, 3.0)], "contig string, start long, end long, cn double")
    b = spark.createDataFrame([("c", k, k + 10) for k in range(0, 70, 5)], "contig string, start long, end long")
    out = segment.expand(s, b, 16)
    assert {(r.start, r.cn) for r in out.collect()} == {(k, 1.0) for k in range(0, 25, 5)} | {(k, 2.0) for k in range(30, 55, 5)}
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_log_factorial(spark):
    import math

    ns = [0, 1, 2, 30, 31, 32, 33, 100, 5000, 131_070]
    got = {r.n: r.f for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", variants.log_factorial(F.col("n")).alias("f")).collect()}
    assert all(got[n] == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-12) for n in ns)
    t = variants.binomial_test(spark.createDataFrame([(40, 100), (0, 0)], "k long, n long"), "k", "n")
    assert len(re.findall(r"\w+Join", t._jdf.queryExecution().executedPlan().toString())) == 1
    assert {r.k: r.p for r in t.collect()} == {40: pytest.approx(stats.binomial_two_sided(40, 100, 0.5)), 0: pytest.approx(1.0)}


@pytest.mark.parametrize("tile", [5, 32, 1 << 14])
def test_identity_over_tiles(spark, tile):
    rng = random.Random(tile)
    genome = "".join(rng.choice("ACGTacgtN") for _ in range(200))
    rows, want = [], {}
    for k in range(150):
        pos, cigar = rng.randint(0, 150), [(rng.choice("MMM=XDNISH"), rng.randint(1, 9)) for _ in range(rng.randint(1, 6))]
        n = sum(x for op, x in cigar if op in "M=XIS")
        q, r, seq = 0, pos, []
        for op, x in cigar:
            if op in "M=X":
                seq += [genome[r + i].upper() if rng.random() < 0.8 and r + i < 200 else rng.choice("ACGT") for i in range(x)]
            elif op in "IS":
                seq += [rng.choice("ACGT") for _ in range(x)]
            r += x if op in "M=XDN" else 0
        rows.append((k, 0, pos, cigar, "".join(seq)))
        want[k] = stats.percent_identity("".join(seq), cigar, genome, pos)
    df = spark.createDataFrame(rows, "ord long, tid int, pos int, cigar array<struct<op:string,len:int>>, seq string")
    contigs = spark.createDataFrame([(0, "c", 200)], "tid int, contig string, length int")
    blocks = spark.createDataFrame([("c", p, genome[p : p + 7]) for p in range(0, 200, 7)], "contig string, block_start int, bases string")
    got = {r.ord: r.identity for r in variants.percent_identity(df, contigs, blocks, tile).collect()}
    assert got == pytest.approx(want) and len(got) == 150


def test_genome_axis(spark):
    w = spark.createDataFrame([("chr2", 0, 10, 2.0, 0.5), ("chr1", 0, 100, 9.0, None), ("chrX", 5, 10, 1.0, 1.6), ("chrM", 0, 5, 2.0, 0.5), ("1", 0, 7, 2.0, 0.5)], "contig string, start long, end long, cn double, maf double")
    assert axis.plotted_contigs(w) == axis.LONG and axis.plotted_contigs(w.filter("contig in ('1', 'chr2')")) == axis.SHORT
    s = spark.createDataFrame([("chr2", 0, 10, 2.5)], "contig string, start long, end long, cn double")
    got = sorted(tuple(r) for r in axis.plot_frame(w, s).select("kind", "contig", "x", "x_end", "cn", "maf").collect())
    assert got == [("segment", "chr2", 100, 110, 2.5, None), ("window", "chr1", 0, 100, None, None), ("window", "chr2", 100, 110, 2.0, 0.5), ("window", "chrX", 115, 120, 1.0, None)]
    contigs = spark.createDataFrame([("chr1", 1000), ("chr2", 500), ("chrX", 50)], "contig string, length int")
    assert {r.contig: r.offset for r in axis.contig_offsets(w, axis.LONG, contigs).collect()} == {"chr1": 0, "chr2": 1000, "chrX": 1500}
    assert {r.maf for r in axis.plot_frame(w).collect()} == {None} and axis.plot_frame(w.limit(0), s).count() == 0


def test_plot_of_a_window_file(spark, tmp_path):
    path = str(tmp_path / "w.tsv")
    with open(path, "w") as f:
        f.write("chr\tstart\tend\ts_mappable\ts_counts\ts_CN\ts_MAF\n1\t0\t10\t5\t3.5\t2.1\tNA\nX\t10\t20\t5\tNA\tNA\t0.4\n")
    got = sorted(tuple(r) for r in axis.genome_axis(text.read_plot(spark, path), axis.contig_offsets(text.read_plot(spark, path), axis.SHORT)).collect())
    assert got == [("1", 0, 10, 2.1, None, 0, 0, 10), ("X", 10, 20, None, 0.4, 22, 20, 30)]


def test_pairs_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows, k = [], 0
    for i in range(300):
        a, b = sorted((rng.randint(0, 3_000), rng.randint(0, 3_000)))
        if i % 9 == 0:
            b = a
        b = min(b, a + 400)
        kind = i % 6
        if kind == 5:
            rows.append((f"r{i}", 0, 0, a, -1, -1))
            continue
        for first, p, m in ((True, a, b), (False, b, a)):
            if kind == 4 and first == bool(i % 4):
                continue  # half a pair
            rows += [(f"r{i}", 1, 0, p, 0, m)] * (2 if kind == 3 else 1)
    rows = [(n, *r[:3], r[3], *r[4:], 50) for n, r in enumerate(sorted(rows, key=lambda r: r[3]))]
    schema = "ord long, qname string, flag int, tid int, pos int, mtid int, mpos int, alen int"
    for part in range(6):
        some = rows[part * len(rows) // 6 : (part + 1) * len(rows) // 6]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_seconds(stream, 500).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    key = lambda df: sorted((r.qname, r.pos, r.mpos) for r in df.collect())
    got, want = key(spark.read.parquet(str(tmp_path / "out"))), key(reads.second_mates(spark.createDataFrame(rows, schema)))
    assert got == want and len(want) > 200


def test_info_verbs(capsys):
    for verb in ("version", "warranty", "license"):
        assert cli.main([verb]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 3


@pytest.mark.parametrize("block", [16, 10_000])
def test_segments_by_blocks_equal_a_task(spark, block):
    """The search over blocks takes the same breakpoints as the one that holds a contig, and true steps are among them."""
    rng = random.Random(block)
    step = lambda k: 0 if k < 40 else 6 if k < 90 else -3
    rows = [("a", k, k + 1, 2.0 + step(k) + rng.randint(-1, 1), None if k % 13 == 4 else 2.0 + step(k) + rng.randint(-1, 1)) for k in range(150)]
    rows += [("b", 5 * k, 5 * k + 5, 2.0 + rng.randint(0, 9), 1.0) for k in range(37)] + [("short", k, k + 1, 3.0, 3.0) for k in range(3)] + [("one", 0, 9, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "contig string, start long, end long, x double, y double")
    got = sorted(tuple(r) for r in segment.segment_blocks(df, ["x", "y"], k=12, block=block).collect())
    want = sorted(tuple(r) for r in segment.segment(df, ["x", "y"], k=12).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert {40, 90} <= {r[2] for r in got if r[0] == "a"}


def test_segments_of_a_table_by_blocks(spark):
    from helixframe.config import SegmentConfig
    from helixframe.plans import pipeline, queries

    m = queries._hourly(spark, "/root/testdata/sf0.01").filter("contig < 'd'").withColumn("run", F.lit(1))
    cfg = SegmentConfig(kchange=25)
    got, want = (sorted(tuple(r) for r in pipeline.segment_matrix(cfg, m, ["a", "b"], rows).collect()) for rows in (100, 10**9))
    assert got == want and len(want) > 2


def test_change_points_equal_the_dense_model():
    """The search with explicit design matrices and a linear solver in each step."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n, p in ((30, 1), (41, 2), (25, 3)):
        y = rng.normal(size=(n, p)) + np.repeat(rng.normal(size=(5, p)) * 4, -(-n // 5), axis=0)[:n]
        i = np.arange(1, n)
        x = np.where(np.arange(n)[:, None] >= i, np.sqrt(n / (i * (n - i))), 0.0)
        x -= x.mean(axis=0)
        c, gram = x.T @ (y - y.mean(axis=0)), x.T @ x
        active = [int(np.argmax((c**2).sum(axis=1)))]
        for _ in range(9):
            norms = (c**2).sum(axis=1)
            q = gram[:, active] @ np.linalg.solve(gram[np.ix_(active, active)], c[active])
            top = norms[active].max()
            step = np.full(n - 1, np.inf)
            for j in set(range(n - 1)) - set(active):
                a, b, k = top - q[j] @ q[j], top - q[j] @ c[j], top - norms[j]
                found = [(b + s * np.sqrt(b * b - a * k)) / a for s in (-1, 1)] if a > 1e-9 and b * b >= a * k else [k / (2 * b)] if a <= 1e-9 < b else []
                step[j] = min([f for f in found if f > 0], default=np.inf)
            active.append(int(step.argmin()))
            c = c - step.min() * q
        assert segment.change_points(y, 10) == active


@pytest.mark.parametrize("block", [3, 40, 1 << 22])
def test_unions_and_fills_by_blocks(spark, block):
    from helixframe.operators import intervals

    rng = random.Random(block)
    rows = [(c, s, s + rng.choice([0, 1, 4, 9, 60])) for c in "ab" for s in (rng.randint(0, 300) for _ in range(60))] * 2
    covered = []
    for c in "ab":
        for s, e in sorted((s, e) for x, s, e in rows if x == c):
            if covered and covered[-1][0] == c and s <= covered[-1][2]:
                covered[-1][2] = max(covered[-1][2], e)
            else:
                covered.append([c, s, e])
    df = spark.createDataFrame(rows, "contig string, start long, end long").repartition(4)
    assert sorted([r.contig, r.start, r.end] for r in intervals.union_intervals(df, block).collect()) == covered
    values = [(c, k, rng.choice([None, None, float("nan"), 1.0, 2.0, 3.0]), "kept") for c in "ab" for k in range(80)]
    got = {(r.contig, r.start): (r.x, r.y) for r in segment.forward_fill(spark.createDataFrame(values, "contig string, start long, x double, y string").repartition(3), ["x"], initial=9.0, block=block).collect()}
    for c in "ab":
        now = 9.0
        for name, k, x, _ in values:
            if name == c:
                now = now if x is None or x != x else x
                assert got[c, k] == (now, "kept")
