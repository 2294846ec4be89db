"""The caller's block-wise steps against naive walks over whole contigs."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from helixframe.operators import calls
from helixframe.plans import queries

from . import naive_calls as naive

DATA = "/root/testdata/sf0.01"


def track(seed, n):
    """Depth of 0 to 3 copies in steps, over an expectation that now and then is nothing."""
    rng = np.random.default_rng(seed)
    depth, expected, at = np.zeros(n, np.int64), np.full(n, 4.0), 0
    while at < n:
        size = int(rng.integers(60, 500))
        depth[at : at + size] = rng.poisson(2 * rng.integers(0, 6), min(size, n - at))
        at += size
    expected[rng.random(n) < 0.05] = rng.choice([0.0, 3.3, 7.1])
    return depth, expected


def frame(spark, tracks):
    rows = [(c, 3 * p + 7, int(d), float(e)) for c, (depth, expected) in tracks.items() for p, (d, e) in enumerate(zip(depth, expected))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["contig", "pos", "depth", "expected"])).repartition(5)


@pytest.mark.parametrize(("block", "ranks"), [(1_000, 700), (97, 5_000), (10**6, 10**6)])
def test_steps_equal_walks(spark, block, ranks):
    tracks = {"a": track(1, 2_600), "b": track(2, 1_500), "tiny": track(3, 90)}
    minsize, largest = 40, 300
    ranked = calls.ranked_bases(frame(spark, tracks), block)
    score = calls.contrast_scores(ranked, minsize, 2, ranks, largest)
    peaks = calls.score_peaks(score, calls.callable_lengths(ranked), block)
    got_score, got_peaks = {(r.contig, r["rank"]): r.score for r in score.collect()}, sorted((r.contig, r.low, r.high, r.pos, r.height) for r in peaks.collect())
    got_calls = sorted(tuple(r) for r in calls.cnv_calls(frame(spark, tracks), minsize, 2, block, ranks, largest).collect())
    want_score, want_peaks, want_calls = {}, [], []
    for c, (depth, expected) in tracks.items():
        units = np.floor(expected * calls.UNIT).astype(np.int64)
        s = naive.scores(depth, units, minsize, 2, largest)
        want_score |= {(c, int(i)): s[i] for i in np.flatnonzero(s)}
        want_peaks += [(c, *x) for x in naive.peaks(s)]
        for x in naive.call_contig(3 * np.arange(len(depth)) + 7, depth, units, s, minsize):
            want_calls.append((c, *(x[k] if k in ("start", "end") or k[:2] == "ci" else float(np.float32(x[k])) for k in [y.split()[0] for y in calls.CALL.split(", ")][1:])))
    assert got_score == want_score and len(want_score) > 300
    assert got_peaks == sorted(want_peaks) and len(want_peaks) > 5
    assert got_calls == sorted(want_calls) and len(want_calls) > 1


def test_no_task_holds_a_contig(spark):
    ranked = calls.ranked_bases(frame(spark, {"a": track(1, 400)}))
    plan = calls.contrast_scores(ranked, 40, 2, 100, 50)._jdf.queryExecution().toString()
    grouped = re.findall(r"FlatMapGroupsInPandas \[([^\]]*)\]", plan)
    assert grouped and all("_block#" in g for g in grouped)


def test_calls_of_a_table_equal_the_walk(spark):
    """All contigs of a whole test table, with the query's own settings."""
    bases = queries._ok(spark, DATA).toPandas()
    want = []
    for c, g in bases.groupby("contig"):
        g = g.sort_values("pos")
        depth, units = g["depth"].to_numpy(np.int64), np.floor(g["expected"].to_numpy() * calls.UNIT).astype(np.int64)
        score = calls.score_block(0, depth, units, 0, len(g), len(g), calls.scales(queries.CALL_SIZE))
        want += [(c, x["start"], x["end"], x["cipos_lo"], x["ciend_hi"]) for x in naive.call_contig(g["pos"].to_numpy(), depth, units, score, queries.CALL_SIZE)]
    got = sorted((r.contig, r.start, r.end, r.cipos_lo, r.ciend_hi) for r in queries.cnv_calls(spark, DATA).collect())
    assert got == sorted(want) and got


def walk_peaks(rows, bandwidth):
    """Suppression on the dense track, as one walk."""
    if not rows:
        return {}
    size = max(rows) + 2 * bandwidth + 3
    tracks = []
    for side in (0, 1):
        value = [rows.get(p, (0, 0))[side] for p in range(size)]
        for order in (range(size), range(size - 1, -1, -1)):
            top, last = calls.FLOOR_SUPPORT, None
            for p in order:
                if last is not None and abs(p - last) > bandwidth:
                    top = calls.FLOOR_SUPPORT
                if value[p] > top:
                    top, last = value[p], p
                else:
                    value[p] = 0
        tracks.append(value)
    gone, phase, trigger = set(), False, None
    for i in range(bandwidth, size):
        if all(sum(t[i - bandwidth : i]) > calls.FLOOR_SUPPORT for t in tracks):
            phase, trigger = True, i
        if phase:
            gone.add(i - bandwidth)
            phase = i < trigger + bandwidth + 1
    return {p: max(tracks[0][p], tracks[1][p]) for p in range(size) if p not in gone and (tracks[0][p] or tracks[1][p])}


@pytest.mark.parametrize("block", [5, 64, 10**6])
def test_suppression_in_islands(spark, block):
    rng = random.Random(block)
    rows = {c: {p: (rng.choice([0, 0, 3, 4, 6, 9]), rng.choice([0, 0, 3, 4, 6, 9])) for p in rng.sample(range(12, 900), n)} for c, n in (("a", 90), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(c, p, a, b) for c, r in rows.items() for p, (a, b) in r.items()], "contig string, pos int, left_n int, right_n int")
    for bandwidth in (3, 12):
        got = {(r.contig, r.pos): r.support for r in calls.split_peaks(df, bandwidth, block).collect()}
        assert got == {(c, p): v for c, r in rows.items() for p, v in walk_peaks(r, bandwidth).items()}


def test_suppression_on_a_table(spark):
    z = queries._breaks(spark, DATA).collect()
    got = {(r.contig, r.pos): r.support for r in queries.nms_peaks(spark, DATA).collect()}
    want = {}
    for c in {r.contig for r in z}:
        want |= {(c, p): v for p, v in walk_peaks({r.pos: (r.left_n, r.right_n) for r in z if r.contig == c}, queries.BAND).items()}
    assert got == want and got
