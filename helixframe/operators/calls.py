"""Copy-number calls: split-read peaks, multi-scale contrast, boundary search, refinement by reads and sites.

Callable bases are ranked along their contig, with running sums in whole numbers, and
all later steps work on blocks or neighbourhoods of ranks, never on a contig: contrast scores
on blocks with a halo of the largest scale, peaks as islands of scores, pairs on the sparse peaks,
greedy choice on islands of overlapping pairs, and the boundary search on a pair's own
neighbourhood with its flanks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.work import materialize
from helixframe.operators.intervals import interval_join
from helixframe.operators.prefix import BLOCK, islands, ranked_sums

#: A track counts above this support.
FLOOR_SUPPORT = 3
#: Bases between the two sides of a contrast, the most of a flank, and the largest scale.
SPACER, FLANK, LARGEST = 100, 5_000, 100_000
EPSILON = 0.001
#: Scores below this don't count; pairs are looked for from the first threshold down to the last.
LEAST_SCORE, THRESHOLDS = 1.5, (20, 3)
#: Expected coverage and scores are summed in whole units, so that no sum depends on its order.
UNIT, GAIN = float(1 << 32), float(1 << 30)
#: Ranks that are scored together; the halo of the largest scale comes on both sides.
RANKS = 500_000


def _survivors(pos: np.ndarray, value: np.ndarray, bandwidth: int) -> np.ndarray:
    """Places that exceed the running maximum, which falls back once the last survivor is more than bandwidth behind."""
    keep, top, last = np.zeros(pos.size, bool), FLOOR_SUPPORT, None
    for i in range(pos.size):
        if last is not None and abs(int(pos[i]) - last) > bandwidth:
            top = FLOOR_SUPPORT
        if value[i] > top:
            keep[i], top, last = True, value[i], int(pos[i])
    return keep


def peak_positions(pos: np.ndarray, left: np.ndarray, right: np.ndarray, bandwidth: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-maximum suppression on sparse, sorted positions of two tracks: (positions, support)."""
    tracks = []
    for value in (left, right):
        at = np.flatnonzero(value)
        p, v = pos[at], value[at]
        ahead = _survivors(p, v, bandwidth)
        p, v = p[ahead], v[ahead]
        back = _survivors(p[::-1], v[::-1], bandwidth)[::-1]
        tracks.append(dict(zip(p[back].tolist(), v[back].tolist())))
    left_at, right_at = tracks
    every = sorted({*left_at, *right_at})
    # Left and right peaks close to each other are small indels: both go.
    events = sorted({p + 1 for p in every} | {p + bandwidth + 1 for p in every})
    place, event = np.array(every, np.int64), np.array(events, np.int64)
    sums = [np.r_[0, np.cumsum([t.get(p, 0) for p in every])] for t in (left_at, right_at)]
    at = np.maximum(event, bandwidth)
    low, high = np.searchsorted(place, at - bandwidth), np.searchsorted(place, at)
    close = np.all([s[high] - s[low] > FLOOR_SUPPORT for s in sums], axis=0)
    until = np.maximum(at, np.append(event[1:] - 1, at[-1:])) + 1
    # Of the places in order, how many stretches that go have begun and ended by each.
    change = np.zeros(place.size + 1, np.int64)
    np.add.at(change, np.searchsorted(place, (at - bandwidth)[close]), 1)
    np.add.at(change, np.searchsorted(place, until[close], side="right"), -1)
    stay = np.cumsum(change)[: place.size] == 0
    out = [(p, max(left_at.get(p, 0), right_at.get(p, 0))) for p in place[stay].tolist()]
    return np.array([p for p, _ in out], np.int64), np.array([v for _, v in out], np.int64)


def split_peaks(breakpoints: DataFrame, bandwidth: int, block: int = BLOCK) -> DataFrame:
    """(contig, pos, left_n, right_n) -> (contig, pos, support). One island of breakpoints a task: across a gap of more than bandwidth + 1 no peak suppresses another."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        p, v = peak_positions(pdf["pos"].to_numpy(np.int64), pdf["left_n"].to_numpy(np.int64), pdf["right_n"].to_numpy(np.int64), bandwidth)
        return pd.DataFrame({"contig": key[0], "pos": p.astype(np.int32), "support": v.astype(np.int32)})

    strong = breakpoints.filter((F.col("left_n") > FLOOR_SUPPORT) | (F.col("right_n") > FLOOR_SUPPORT))
    return islands(strong, bandwidth + 1, block=block).groupBy("contig", "island").applyInPandas(run, "contig string, pos int, support int")


def scales(minsize: int, largest: int = LARGEST) -> list[int]:
    out, s = [], minsize // 2
    while s <= largest:
        out.append(s)
        s = int(s * 1.3)
    return out


def _away(x):
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def ranked_bases(bases: DataFrame, block: int = BLOCK) -> DataFrame:
    """bases (contig, pos, depth, expected) of callable positions -> (contig, pos, depth, units, rank, depth_before, units_before), written once. units: the expected coverage in whole numbers of 2**-32."""
    b = bases.select("contig", "pos", F.col("depth").cast("long").alias("depth"), F.floor(F.col("expected") * UNIT).cast("long").alias("units"))
    return materialize(ranked_sums(b, ["depth", "units"], block=block), "ranked")


def callable_lengths(ranked: DataFrame) -> DataFrame:
    """(contig, n): callable bases, one row a contig."""
    return ranked.groupBy("contig").agg((F.max("rank") + 1).alias("n"))


def score_block(first: int, depth: np.ndarray, units: np.ndarray, low: int, high: int, n: int, sizes: list[int], ploidy: int = 2) -> np.ndarray:
    """Scores of the ranks [low, high) of a contig of n callable bases, from the depth and units of the ranks from first on."""
    cov, exp = np.r_[0, np.cumsum(depth, dtype=np.int64)], np.r_[0, np.cumsum(units, dtype=np.int64)]
    total = np.zeros(high - low, np.int64)
    for s in sizes:
        lo, hi = max(s, low - SPACER // 2), min(n - s - SPACER, high - SPACER // 2)
        if hi <= lo:
            continue
        at = np.arange(lo, hi) - first
        l, r = at - s + 1, at + SPACER + 1
        left, right = (exp[at + 1] - exp[l]) / UNIT, (exp[r + s] - exp[r]) / UNIT
        a = np.divide(float(ploidy) * (cov[at + 1] - cov[l]), left, out=np.zeros(at.size), where=left > 0)
        b = np.divide(float(ploidy) * (cov[r + s] - cov[r]), right, out=np.zeros(at.size), where=right > 0)
        gap = np.abs(a - b)
        shift = _away(gap)
        off = np.abs(gap - shift) + np.abs(a - _away(a)) + np.abs(b - _away(b))
        # off is 1 over a whole range of values, where only rounding would decide: those count as 1.
        gain = np.where((shift >= 1) & (off < 1 - 1e-6), shift * (shift - off), 0.0)
        total[lo + SPACER // 2 - low : hi + SPACER // 2 - low] += np.floor(gain * GAIN).astype(np.int64)
    score = total / GAIN
    score[score < LEAST_SCORE] = 0
    return score


def contrast_scores(ranked: DataFrame, minsize: int, ploidy: int = 2, ranks: int = RANKS, largest: int = LARGEST) -> DataFrame:
    """(contig, rank, score) of the ranks whose score counts: the sum over scales of how clearly the copy number steps there."""
    sizes = scales(minsize, largest)
    halo = (sizes[-1] if sizes else 0) + SPACER // 2 + 1
    r = ranked.select("contig", "rank", "depth", "units").join(callable_lengths(ranked), "contig")
    reach = F.sequence(F.expr(f"greatest(rank - {halo}, 0) div {ranks}"), F.expr(f"least(rank + {halo}, n - 1) div {ranks}"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        first, n = int(pdf["rank"].iloc[0]), int(pdf["n"].iloc[0])
        low = int(key[1]) * ranks
        score = score_block(first, pdf["depth"].to_numpy(np.int64), pdf["units"].to_numpy(np.int64), low, min(low + ranks, n), n, sizes, ploidy)
        at = np.flatnonzero(score)
        return pd.DataFrame({"contig": key[0], "rank": at + low, "score": score[at]})

    return r.withColumn("_block", F.explode(reach)).groupBy("contig", "_block").applyInPandas(run, "contig string, rank long, score double")


def score_peaks(scores: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """Islands of scores that begin and end within their contig -> (contig, low, high, pos, height, n), in ranks; low and high are the zeros beside them.

    A walk that holds its running maximum as a whole number ends at the last score above the largest such
    number, or, if there is none, at the first that equals it.
    """
    t = F.floor("score")
    level = islands(scores, 1, pos="rank", block=block).groupBy("contig", "island", t.alias("t")).agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.max_by(F.struct("rank", "score"), F.when(F.col("score") > t, F.col("rank"))).alias("over"), F.min_by(F.struct("rank", "score"), "rank").alias("equal"))
    top = F.max_by(F.struct("over", "equal"), "t")
    per = level.groupBy("contig", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), top.alias("top"))
    best = F.when(F.col("top.over.rank").isNotNull(), F.col("top.over")).otherwise(F.col("top.equal"))
    out = per.join(lengths, "contig").filter((F.col("first") > 0) & (F.col("last") < F.col("n") - 1))
    return out.select("contig", (F.col("first") - 1).alias("low"), (F.col("last") + 1).alias("high"), best["rank"].alias("pos"), best["score"].alias("height"), "n")


def peak_pairs(peaks: DataFrame, minsize: int) -> DataFrame:
    """(contig, n, a, b, threshold): peaks that are neighbours among those of at least some threshold, the first peak of a contig counting always, with the largest such threshold. Far enough apart."""
    most, least = THRESHOLDS
    first = peaks.groupBy("contig").agg(F.min("pos").alias("_first"))
    p = peaks.join(first, "contig").withColumn("_is_first", F.col("pos") == F.col("_first"))
    upto = F.when(F.col("_is_first"), F.lit(most)).otherwise(F.least(F.floor("height"), F.lit(most))).cast("int")
    one = F.struct("low", "pos", "high", "height")
    each = p.filter(upto >= least).select("contig", "n", "pos", "_is_first", one.alias("b"), F.explode(F.sequence(F.lit(least), upto)).alias("threshold"))
    pairs = each.withColumn("a", F.lag("b").over(Window.partitionBy("contig", "threshold").orderBy("pos"))).filter(~F.col("_is_first"))
    pairs = pairs.groupBy("contig", "n", "a", "b").agg(F.max("threshold").alias("threshold"))
    return pairs.filter(F.col("b.pos") - F.col("a.pos") >= minsize)


def _cn(cov: Column, units: Column, ploidy: int) -> Column:
    return F.lit(float(ploidy)) * cov / (units / F.lit(UNIT) + F.lit(EPSILON))


def clear_pairs(pairs: DataFrame, ranked: DataFrame, ploidy: int = 2) -> DataFrame:
    """The pairs whose copy number is not the ploidy and differs clearly from both flanks'. The running sums at a pair's four ranks meet it by an equi-join."""
    lo, hi = F.col("a.pos"), F.col("b.pos")
    places = F.array(F.greatest(lo - FLANK, F.lit(0).cast("long")), lo, hi, F.least(hi + FLANK, F.col("n")))
    key = ["contig", F.col("a.pos").alias("_a"), F.col("b.pos").alias("_b")]
    asked = pairs.select(*key, "n", F.posexplode(places).alias("k", "at")).withColumn("rank", F.least("at", F.col("n") - 1))
    found = asked.join(ranked.select("contig", "rank", "depth", "units", "depth_before", "units_before"), ["contig", "rank"])
    upto = lambda c: F.col(f"{c}_before") + F.when(F.col("at") > F.col("rank"), F.col(c)).otherwise(0)
    sums = found.groupBy("contig", "_a", "_b").agg(*[F.max(F.when(F.col("k") == k, F.struct(upto("depth").alias("d"), upto("units").alias("u")))).alias(f"s{k}") for k in range(4)])
    between = lambda i, j: _cn(F.col(f"s{j}.d") - F.col(f"s{i}.d"), F.col(f"s{j}.u") - F.col(f"s{i}.u"), ploidy)
    whole = lambda x: F.floor(x + 0.5)
    sums = sums.select("contig", "_a", "_b", between(1, 2).alias("_in"), between(0, 1).alias("_left"), between(2, 3).alias("_right"))
    apart = lambda c: (whole(F.col(c)) != whole(F.col("_in"))) & (F.abs(F.col(c) - F.col("_in")) > 0.5)
    clear = sums.filter((whole(F.col("_in")) != ploidy) & apart("_left") & apart("_right") & (F.col("_a") > 0)).select(F.col("contig").alias("_contig"), "_a", "_b")
    joined = pairs.join(clear, (F.col("contig") == F.col("_contig")) & (lo == F.col("_a")) & (hi == F.col("_b")))
    return joined.filter(hi < F.col("n")).drop("_contig", "_a", "_b")


def chosen_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs taken greedily: higher thresholds first, then from left to right, no peak twice. Pairs that share no peak, directly or through others, don't compete, so each island of overlapping pairs is on its own."""
    w = Window.partitionBy("contig").orderBy("a.pos", "b.pos")
    reach = F.max("b.pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = pairs.withColumn("_new", F.when(reach.isNull() | (F.col("a.pos") > reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = marked.select("contig", "n", "threshold", "_island", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("low", "pos", "high", "height")])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = set(), []
        for r in pdf.sort_values(["threshold", "b_pos"], ascending=[False, True]).itertuples():
            if r.a_pos not in used and r.b_pos not in used:
                used |= {r.a_pos, r.b_pos}
                keep.append(r.Index)
        return pdf.loc[keep].drop(columns="_island")

    out = "contig string, n long, threshold int, a_low long, a_pos long, a_high long, a_height double, b_low long, b_pos long, b_high long, b_height double"
    return flat.groupBy("contig", "_island").applyInPandas(run, out)


class _Sums:
    """Running sums at the ranks at hand, which are sorted; a place is the number of callable bases before it."""

    def __init__(self, rank, depth, units, depth_before, units_before, ploidy):
        self.rank, self.depth, self.units, self.cov, self.exp, self.ploidy = rank, depth, units, depth_before, units_before, ploidy

    def upto(self, place: int) -> tuple[int, int]:
        i = int(np.searchsorted(self.rank, place))
        if i < self.rank.size and self.rank[i] == place:
            return int(self.cov[i]), int(self.exp[i])
        return int(self.cov[i - 1] + self.depth[i - 1]), int(self.exp[i - 1] + self.units[i - 1])

    def between(self, a: int, b: int) -> tuple[int, float]:
        (c, e), (d, f) = self.upto(a), self.upto(b)
        return d - c, (f - e) / UNIT

    def cn(self, a: int, b: int) -> float:
        cov, exp = self.between(a, b)
        return float(self.ploidy) * cov / (exp + EPSILON)


def _offset(u: float, v: float) -> float:
    s = abs(u - v)
    return float(abs(_away(s) - s) + abs(_away(u) - u) + abs(_away(v) - v))


def _climb(s: _Sums, edge: int, stop: int, step: int, inner: tuple[int, int], outer: tuple[int, int], side: str, best: float, fixed: bool):
    """Move a boundary base by base; (best place, best offset, where it stopped)."""
    at, place = edge, edge
    while (at < stop) if step > 0 else (at > stop):
        nxt = at + step
        i, o = ((nxt, inner[1]), (outer[0], nxt)) if side == "left" else ((inner[0], nxt), (nxt, outer[1]))
        if i[1] <= i[0] or o[1] <= o[0]:
            break
        off = _offset(s.cn(*i), s.cn(*o))
        if not off < best + 0.1:
            break
        at = nxt
        if off < best and not fixed:
            best, place = off, at
    return place, best, at


def refined_call(s: _Sums, pos_of, a: list, b: list, n: int, minsize: int) -> dict | None:
    """The call of a pair of peaks, each [low, pos, high, height] in ranks. s: sums at the peaks' ranks and their flanks; pos_of: the position of a rank."""
    penalty = {}
    # Each boundary is searched towards and away from the other one, then its interval with the offset held.
    for fixed in (False, True):
        for peak, side, order in ((a, "left", (1, -1)), (b, "right", (-1, 1))):
            for step in order:
                lo, hi = a[1], b[1]
                outer = (max(0, lo - FLANK), lo) if side == "left" else (hi, min(n, hi + FLANK))
                best = _offset(s.cn(lo, hi), s.cn(*outer))
                place, best, at = _climb(s, peak[1], peak[2] if step > 0 else peak[0], step, (lo, hi), outer, side, best, fixed)
                if fixed:
                    peak[2 if step > 0 else 0] = at
                else:
                    peak[1], penalty[side] = place, best
    lo, hi = a[1], b[1]
    cov, exp = s.between(lo, hi) if hi > lo else (0, 0.0)
    if exp == 0:
        return None
    start, end = pos_of(lo), pos_of(min(hi, n - 1))
    share = (hi - lo) / max(end - start, 1)
    if end - start < minsize or share <= 0.1:
        return None
    at = lambda k: pos_of(min(max(k, 0), n - 1))
    return {
        "start": start, "end": end, "cipos_lo": at(a[0]), "cipos_hi": at(a[2]), "ciend_lo": at(b[0]), "ciend_hi": at(b[2]),
        "cn": float(s.ploidy) * cov / exp, "rds": min(a[3], b[3]), "pty": max(penalty.values()), "mpb": share,
    }


CALL = "contig string, start int, end int, cipos_lo int, cipos_hi int, ciend_lo int, ciend_hi int, cn float, rds float, pty float, mpb float"


def boundary_search(pairs: DataFrame, ranked: DataFrame, minsize: int, ploidy: int = 2, bucket: int = 1 << 14) -> DataFrame:
    """chosen_pairs() -> calls. The ranks within a pair's peaks and their flanks meet it by a bucketed interval join; a pair's neighbourhood is one group."""
    key = ["contig", "a_pos", "b_pos"]
    spans = F.array(F.struct((F.greatest(F.col("a_low") - FLANK, F.lit(0).cast("long"))).alias("start"), (F.col("a_high") + 1).alias("end")), F.struct(F.col("b_low").alias("start"), F.least(F.col("b_high") + FLANK + 1, F.col("n")).alias("end")))
    near = pairs.withColumn("_s", F.explode(spans)).select("*", "_s.start", "_s.end").drop("_s", "threshold")
    met = interval_join(ranked, near, bucket, pos="rank").dropDuplicates([*key, "rank"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        r, rank = pdf.iloc[0], pdf["rank"].to_numpy(np.int64)
        s = _Sums(rank, *[pdf[c].to_numpy(np.int64) for c in ("depth", "units", "depth_before", "units_before")], ploidy)
        position = pdf["pos"].to_numpy(np.int64)
        pos_of = lambda k: int(position[min(int(np.searchsorted(rank, k)), rank.size - 1)])
        peak = lambda x: [int(r[f"{x}_low"]), int(r[f"{x}_pos"]), int(r[f"{x}_high"]), float(r[f"{x}_height"])]
        call = refined_call(s, pos_of, peak("a"), peak("b"), int(r["n"]), minsize)
        return pd.DataFrame([{"contig": key[0], **call}] if call else [], columns=[x.split()[0] for x in CALL.split(", ")])

    return met.groupBy(*key).applyInPandas(run, CALL)


def cnv_calls(bases: DataFrame, minsize: int, ploidy: int = 2, block: int = BLOCK, ranks: int = RANKS, largest: int = LARGEST) -> DataFrame:
    """bases (contig, pos, depth, expected) of callable positions -> calls. No task holds a contig's bases."""
    ranked = ranked_bases(bases, block)
    scores = materialize(contrast_scores(ranked, minsize, ploidy, ranks, largest), "scores")
    peaks = materialize(score_peaks(scores, callable_lengths(ranked), block), "peaks")
    pairs = clear_pairs(materialize(peak_pairs(peaks, minsize), "pairs"), ranked, ploidy)
    return boundary_search(materialize(chosen_pairs(pairs), "chosen"), ranked, minsize, ploidy)


def best_breakpoint(intervals: DataFrame, breakpoints: DataFrame, low: str, high: str, least: int = 2, bucket: int = 1 << 14) -> DataFrame:
    """intervals (id, contig, low, high; closed) with the best supported breakpoint in each: id, best_pos, best_support. Of equals the first."""
    i = intervals.select("id", "contig", F.col(low).alias("start"), (F.col(high) + 1).alias("end"))
    hit = interval_join(breakpoints.filter(F.col("support") >= least), i, bucket)
    best = hit.groupBy("id").agg(F.max_by(F.struct("pos", "support"), F.struct("support", -F.col("pos"))).alias("b"))
    return best.select("id", F.col("b.pos").alias("best_pos"), F.col("b.support").alias("best_support"))


def refine(calls: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """calls with start and end moved to the best breakpoint within their intervals; srl and srr are its reads."""
    c = calls.withColumn("id", F.xxhash64("contig", "start", "end", "cipos_lo", "ciend_hi"))
    l = best_breakpoint(c, breakpoints, "cipos_lo", "cipos_hi").select("id", F.col("best_pos").alias("_l"), F.col("best_support").alias("srl"))
    r = best_breakpoint(c, breakpoints, "ciend_lo", "ciend_hi").select("id", F.col("best_pos").alias("_r"), F.col("best_support").alias("srr"))
    out = c.join(l, "id", "left").join(r, "id", "left").fillna(0, ["srl", "srr"])
    return out.withColumn("start", F.coalesce("_l", "start")).withColumn("end", F.coalesce("_r", "end")).drop("id", "_l", "_r")


def annotate_sites(calls: DataFrame, support: DataFrame, bucket: int = 1 << 14) -> DataFrame:
    """calls with nsnps and maf: the number of supported sites within and the sum of their folded fractions."""
    v = F.col("alt_n") / (F.col("ref_n") + F.col("alt_n"))
    sites = support.filter(F.col("ref_n") + F.col("alt_n") > 0).select("contig", "pos", F.least(v, 1 - v).alias("f"))
    keys = calls.select("contig", "start", "end").distinct()
    s = interval_join(sites, keys, bucket).groupBy("contig", "start", "end").agg(F.count(F.lit(1)).cast("int").alias("nsnps"), F.sum("f").alias("maf"))
    return calls.join(s, ["contig", "start", "end"], "left").fillna(0, ["nsnps"]).fillna(0.0, ["maf"])
