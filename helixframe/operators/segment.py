"""Segmentation of a signal matrix: change points of all columns together by group fused least angle regression, chosen by dynamic programming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.stats import upper_median
from helixframe.functions.work import materialize
from helixframe.operators.intervals import interval_join
from helixframe.operators.prefix import rank_rows

SEGMENT = "contig string, start bigint, end bigint, cn double"


def contig_runs(rows: DataFrame, order: str = "ord", shift: int = 33) -> DataFrame:
    """rows with run: which stretch of one contig in file order a row is in, from 0. A contig that comes again begins another run.

    Splits of the file (the leading bits of the order) count their own changes; one row a split tells where each split's count begins and whether its
    first row continues the split before.
    """
    cut = rows.withColumn("_split", F.shiftright(F.col(order), shift))
    within = Window.partitionBy("_split").orderBy(order)
    cut = cut.withColumn("_change", F.coalesce((~F.lag("contig").over(within).eqNullSafe(F.col("contig")) & (F.row_number().over(within) > 1)).cast("int"), F.lit(0)))
    per = cut.groupBy("_split").agg(F.sum("_change").alias("n"), F.min_by(F.struct("contig"), order).alias("first"), F.max_by(F.struct("contig"), order).alias("last"))
    by = Window.orderBy("_split")  # a row a split
    seam = F.coalesce((F.lag("last").over(by) != F.col("first")).cast("int"), F.lit(0))
    base = per.withColumn("_seam", seam).select(F.col("_split").alias("_s"), (F.sum("_seam").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    so_far = F.sum("_change").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_so_far", so_far).join(base, F.col("_split") == F.col("_s")).select(*rows.columns, (F.col("_base") + F.col("_so_far")).cast("long").alias("run"))


def forward_fill(df: DataFrame, columns: list[str], key: str | list[str] = "contig", order: str | list[str] = "start", initial: float = 0.0, block: int = 1 << 22) -> DataFrame:
    """Missing values take the last one before them along the key, or the initial value. Blocks of the first order column are filled on their own; what stands before a block is the last value of the blocks before it, one row a block."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    cut = df.withColumn("_block", F.expr(f"`{orders[0]}` div {block}"))
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    place = F.struct(*orders)
    last = cut.groupBy(*keys, "_block").agg(*[F.max_by(known[c], F.when(known[c].isNotNull(), place)).alias(f"_last_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_last_{c}") for c in columns])
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*keys, "_block").orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumns({f"_own_{c}": F.last(known[c], ignorenulls=True).over(w) for c in columns})
    filled = within.join(carried, on)
    return filled.select(*[F.coalesce(f"_own_{c}", f"_last_{c}", F.lit(initial)).alias(c) if c in columns else F.col(c) for c in df.columns])


def weights(n: int) -> np.ndarray:
    i = np.arange(1, n)
    return np.sqrt(n / (i * (n - i)))


def change_points(y: np.ndarray, k: int, epsilon: float = 1e-9) -> list[int]:
    """y: rows x columns -> up to k candidate breakpoints, in the order found; each the last row of its segment."""
    n = y.shape[0]
    if n < 2:
        return []
    w = weights(n)[:, None]
    i = np.arange(1, n)[:, None]
    s = np.cumsum(y, axis=0)
    c = w * (i * s[-1] / n - s[:-1])
    norms = (c**2).sum(axis=1)
    active = [int(np.argmax(norms))]
    for _ in range(min(k, n - 1) - 1):
        norms = (c**2).sum(axis=1)
        top = norms[active].max() if active else norms.max()
        a = np.sort(np.array(active))  # row a is position a + 1
        at, wa = a + 1, w[a, 0]
        gap = np.diff(np.r_[0, at, n])
        u = c[a] / wa[:, None]
        delta = np.vstack([u[:1] / gap[0], np.diff(u, axis=0) / gap[1:-1, None], -u[-1:] / gap[-1]])
        r = (delta[:-1] - delta[1:]) / wa[:, None]
        t = np.zeros((n - 1, y.shape[1]))
        t[a] = r * wa[:, None]
        tail = np.cumsum(t[::-1], axis=0)[::-1] - (t[a] * at[:, None]).sum(axis=0) / n
        q = w * np.cumsum(tail, axis=0)
        alpha, beta, kappa = top - (q**2).sum(axis=1), top - (q * c).sum(axis=1), top - norms
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(beta**2 - alpha * kappa)
            steps = np.where(alpha > epsilon, np.stack([(beta - root) / alpha, (beta + root) / alpha]), np.where(beta > epsilon, kappa / (2 * beta), np.inf))
        steps = np.where(np.isnan(steps) | (steps <= 0), np.inf, steps)
        steps[:, a] = np.inf
        least = steps.min(axis=0)
        new = int(np.argmin(least))
        if not np.isfinite(least[new]):
            break
        c = c - least[new] * q
        active.append(new)
    return active


def choose(y: np.ndarray, jumps: list[int], k: int, threshold: float = 0.5) -> list[int]:
    """The best subset of the candidate breakpoints: sorted."""
    b = np.unique(np.r_[[j for j in jumps if 0 <= j < len(y) - 1], -1, len(y) - 1])
    total, square = np.vstack([np.zeros(y.shape[1]), np.cumsum(y, axis=0)])[b + 1], np.r_[0.0, np.cumsum((y**2).sum(axis=1))][b + 1]
    return choose_from(b, total, square, k, threshold)


def choose_from(b: np.ndarray, total: np.ndarray, square: np.ndarray, k: int, threshold: float = 0.5) -> list[int]:
    """choose() from what it needs of the rows alone: the last row of each elementary block, -1 before them, and the sums and sums of squares up to each."""
    n, m = int(b[-1]) + 1, b.size - 1
    most = min(k, n // 4, m - 1)
    if n < 4 or most < 1:
        return []
    size = np.maximum((b[None, 1:] - b[:-1, None]), 1).astype(float)
    gap = total[None, 1:] - total[:-1, None]
    cost = square[None, 1:] - square[:-1, None] - (gap**2).sum(axis=2) / size  # cost[i, j]: elementary blocks i..j
    cost = np.where(np.triu(np.ones((m, m), bool)), np.maximum(cost, 0), np.inf)
    best, back = [cost[0]], []
    for level in range(most):
        # best[level][i] + cost[i + 1, j]
        step = np.full((m, m), np.inf)
        step[:-1] = best[level][:-1, None] + cost[1:]
        step[:level] = np.inf
        back.append(step.argmin(axis=0))
        best.append(step.min(axis=0))
    tiny = np.finfo(float).tiny
    loss = np.log(np.maximum([x[m - 1] for x in best], tiny))
    spread = loss[-1] - loss[0]
    pick = 0
    if abs(spread) > 1e-12:
        t = (loss[-1] - loss) / spread * most + 1
        bend = np.diff(t, 2)
        over = np.flatnonzero(bend > threshold)
        pick = int(over[-1]) + 1 if over.size else 0
    out, j = [], m - 1
    for level in range(pick, -1, -1):
        j = int(back[level][j])
        out.append(int(b[j + 1]))
    return sorted(set(out))


def levels(y: np.ndarray, ends: list[int]) -> list[float]:
    """Per segment the mean over columns of the upper median, repeats in a row counted once. ends: last rows of all segments."""
    out, lo = [], 0
    for e in ends:
        part = y[lo : e + 1]
        cols = []
        for x in part.T:
            x = x[np.r_[True, x[1:] != x[:-1]]]
            cols.append(np.sort(x)[x.size // 2])
        out.append(float(np.mean(cols)))
        lo = e + 1
    return out


def segment_contig(start: np.ndarray, end: np.ndarray, y: np.ndarray, k: int = 300, threshold: float = 0.5, epsilon: float = 1e-9) -> list[tuple[int, int, float]]:
    """y: signals with ploidy taken off -> (start, end, level)."""
    cuts = choose(y, change_points(y, k, epsilon), k, threshold) if len(y) >= 4 else []
    ends = [*cuts, len(y) - 1]
    return [(int(start[lo]), int(end[hi]), v) for lo, hi, v in zip([0, *[c + 1 for c in cuts]], ends, levels(y, ends))]


class _Search:
    """The state of one group's search, which is small: the active points in order, and the correlations' change as a piecewise linear function with knots at them."""

    def __init__(self, n: int, total: np.ndarray):
        self.n, self.total, self.found, self.rows, self.done = n, total, [], {}, n < 2
        self.knots, self.change = np.array([0, n], np.int64), np.zeros((2, total.size))

    def add(self, row: int, held: np.ndarray) -> None:
        """A new active row, with its first correlations, running sums and sum of squares."""
        self.found.append(row)
        self.rows[row] = held
        at = row + 1
        k = int(np.searchsorted(self.knots, at))
        if self.knots[k] != at:
            value = [np.interp(at, self.knots, c) for c in self.change.T]
            self.knots, self.change = np.insert(self.knots, k, at), np.insert(self.change, k, value, axis=0)

    def direction(self) -> dict:
        """What a pass over the rows needs: the knots, the correlations' change and its direction at them, the largest squared correlation."""
        p = self.total.size
        at = self.knots[1:-1]
        w = np.sqrt(self.n / (at * (self.n - at)))[:, None]
        c = np.array([self.rows[int(k) - 1][:p] for k in at]) - w * self.change[1:-1]
        gap, u = np.diff(self.knots)[:, None], c / w
        delta = np.vstack([u[:1] / gap[0], np.diff(u, axis=0) / gap[1:-1], -u[-1:] / gap[-1]])
        t = delta[:-1] - delta[1:]
        slope = np.vstack([np.cumsum(t[::-1], axis=0)[::-1], np.zeros((1, p))]) - (t * at[:, None]).sum(axis=0) / self.n
        turn = np.vstack([np.zeros((1, p)), np.cumsum(slope * gap, axis=0)])
        return {"knots": self.knots, "change": self.change, "turn": turn, "top": float((c**2).sum(axis=1).max())}


def _passes(n: int, first: int, c0: np.ndarray, said: dict | None, epsilon: float) -> tuple[float, int]:
    """(step, row) of a block's best next point: the smallest step, or without a search so far the largest correlation, negated."""
    i = np.arange(first + 1, first + 1 + len(c0))
    if said is None:
        norms = (c0**2).sum(axis=1)
        return -float(norms.max()), first + int(norms.argmax())
    w = np.sqrt(n / (i * (n - i)))[:, None]
    line = lambda y: np.stack([np.interp(i, said["knots"], v) for v in y.T], axis=1)
    c, q = c0 - w * line(said["change"]), w * line(said["turn"])
    norms, top = (c**2).sum(axis=1), said["top"]
    alpha, beta, kappa = top - (q**2).sum(axis=1), top - (q * c).sum(axis=1), top - norms
    with np.errstate(divide="ignore", invalid="ignore"):
        root = np.sqrt(beta**2 - alpha * kappa)
        steps = np.where(alpha > epsilon, np.stack([(beta - root) / alpha, (beta + root) / alpha]), np.where(beta > epsilon, kappa / (2 * beta), np.inf))
    steps = np.where(np.isnan(steps) | (steps <= 0), np.inf, steps).min(axis=0)
    steps[np.isin(i, said["knots"])] = np.inf
    return float(steps.min()), first + int(steps.argmin())


def segment_blocks(matrix: DataFrame, signal_cols: list[str], ploidy: float = 2, k: int = 300, threshold: float = 0.5, epsilon: float = 1e-9, block: int = 1 << 16) -> DataFrame:
    """segment() for contigs whose bins don't fit a task: rows are written once in blocks with their running sums, and each step of the search is a
    pass over the blocks and a minimum per contig. What comes to the driver is one row a contig and step.
    """
    p = len(signal_cols)
    ready = matrix.select("contig", "start", "end", *[(F.col(c).cast("double") - ploidy).alias(c) for c in signal_cols])
    ready = forward_fill(ready, signal_cols)
    ranked = materialize(rank_rows(ready, pos="start", block=max(block, 1)), "segment-rows")
    held = [*signal_cols, "_square"]
    cut = ranked.withColumn("_square", sum((F.col(c) * F.col(c) for c in signal_cols), F.lit(0.0))).withColumn("_block", F.expr(f"rank div {block}"))
    per = cut.groupBy("contig", "_block").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"{c}_sum") for c in held])
    before = Window.partitionBy("contig").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("contig")
    base = per.select("contig", "_block", F.sum("_n").over(whole).alias("n"), *[F.coalesce(F.sum(f"{c}_sum").over(before), F.lit(0.0)).alias(f"{c}_base") for c in held], *[F.sum(f"{c}_sum").over(whole).alias(f"{c}_all") for c in held])
    packed = cut.groupBy("contig", "_block").agg(F.array_sort(F.collect_list(F.struct("rank", *held))).alias("rows")).join(base, ["contig", "_block"])

    def prepare(batches):
        for b in batches:
            for r in b.to_dict("records"):
                y = np.array([[x[c] for c in held] for x in r["rows"]], np.float64)
                sums = np.cumsum(y, axis=0) + np.array([r[f"{c}_base"] for c in held])
                first, n, every = int(r["rows"][0]["rank"]), int(r["n"]), np.array([r[f"{c}_all"] for c in held])
                i = np.arange(first + 1, first + 1 + len(y))[:, None]
                inner = i[:, 0] < n
                c0 = np.sqrt(n / (i[inner] * (n - i[inner]))) * (i[inner] * every[:p] / n - sums[inner, :p])
                yield pd.DataFrame({"contig": [r["contig"]], "n": [n], "first": [first], "c0": [c0.tobytes()], "sums": [sums[inner].tobytes()], "every": [every.tobytes()]})

    blocks = materialize(packed.mapInPandas(prepare, "contig string, n long, first long, c0 binary, sums binary, every binary"), "segment-blocks")
    searches = {r["contig"]: _Search(r["n"], np.frombuffer(r["every"])[:p]) for r in blocks.groupBy("contig").agg(F.first("n").alias("n"), F.first("every").alias("every")).collect()}  # one row a contig
    everything = {r["contig"]: np.frombuffer(r["every"]) for r in blocks.groupBy("contig").agg(F.first("every").alias("every")).collect()}
    for step in range(k):
        open_ = {c: (s.direction() if s.found else None) for c, s in searches.items() if not s.done and len(s.found) < min(k, s.n - 1)}
        if not open_:
            break

        def one_pass(batches, said=open_):
            for b in batches:
                for r in b.itertuples():
                    if r.contig in said and r.c0:
                        c0 = np.frombuffer(r.c0).reshape(-1, p)
                        size, row = _passes(r.n, r.first, c0, said[r.contig], epsilon)
                        at = row - r.first
                        yield pd.DataFrame({"contig": [r.contig], "step": [size], "row": [row], "held": [np.r_[c0[at], np.frombuffer(r.sums).reshape(-1, p + 1)[at]].tobytes()]})

        best = blocks.mapInPandas(one_pass, "contig string, step double, row long, held binary").groupBy("contig").agg(F.min_by(F.struct("step", "row", "held"), F.struct("step", "row")).alias("x"))
        for r in best.select("contig", "x.*").collect():  # one row a contig
            s = searches[r["contig"]]
            if not np.isfinite(r["step"]):
                s.done = True
                continue
            if s.found:
                s.change = s.change + r["step"] * open_[r["contig"]]["turn"]
            s.add(r["row"], np.frombuffer(r["held"]))
    cuts = []
    for c, s in searches.items():
        b = np.array([-1, *sorted(s.found), s.n - 1])
        sums = np.vstack([np.zeros(p + 1), *[s.rows[j][p:] for j in sorted(s.found)], everything[c]])
        ends = [*(choose_from(b, sums[:, :p], sums[:, p], k, threshold) if s.n >= 4 else []), s.n - 1]
        cuts += [(c, lo, hi + 1) for lo, hi in zip([0, *[e + 1 for e in ends[:-1]]], ends)]
    parts = matrix.sparkSession.createDataFrame(cuts, "contig string, start long, end long") if cuts else matrix.sparkSession.createDataFrame([], "contig string, start long, end long")
    placed = interval_join(ranked.withColumnsRenamed({"start": "_start", "end": "_end"}), parts.withColumn("part", F.col("start")), block, pos="rank")
    level = run_levels(placed, ["contig", "part"], "rank", signal_cols, "cn")
    span = placed.groupBy("contig", "part").agg(F.min_by("_start", "rank").cast("long").alias("start"), F.max_by("_end", "rank").cast("long").alias("end"))
    return span.join(level, ["contig", "part"]).select("contig", "start", "end", (F.col("cn") + ploidy).alias("cn"))


def segment(matrix: DataFrame, signal_cols: list[str], ploidy: float = 2, k: int = 300, threshold: float = 0.5, epsilon: float = 1e-9) -> DataFrame:
    """matrix (contig, start, end, signals) -> piecewise constant levels. One contig's bins a task. With a column run (contig_runs()) each run is segmented on its own, in the order of ord."""
    runs = [c for c in ("run",) if c in matrix.columns]
    order = ["ord"] if runs and "ord" in matrix.columns else ["start", "end"]
    extra = [c for c in order if c not in ("start", "end")]
    ready = matrix.select("contig", *runs, *extra, "start", "end", *[(F.col(c).cast("double") - ploidy).alias(c) for c in signal_cols])
    ready = forward_fill(ready, signal_cols, ["contig", *runs], order)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = segment_contig(pdf["start"].to_numpy(), pdf["end"].to_numpy(), pdf[signal_cols].to_numpy(np.float64), k, threshold, epsilon)
        return pd.DataFrame([(key[0], a, b, v + ploidy) for a, b, v in rows], columns=["contig", "start", "end", "cn"])

    return ready.groupBy("contig", *runs).applyInPandas(run, SEGMENT)


def run_levels(df: DataFrame, keys: list[str], order: str, columns: list[str], name: str = "level") -> DataFrame:
    """Per key the mean over columns of the upper median of the values in order, repeats in a row counted once: levels() as window and aggregation."""
    w = Window.partitionBy(*keys).orderBy(order)
    kept = df.withColumns({f"_{c}": F.when(F.lag(c).over(w).isNull() | (F.lag(c).over(w) != F.col(c)), F.col(c)) for c in columns})
    per = kept.groupBy(*keys).agg(*[upper_median(f"_{c}").cast("double").alias(f"_{c}") for c in columns])
    return per.select(*keys, (sum((F.col(f"_{c}") for c in columns), F.lit(0.0)) / len(columns)).alias(name))


def expand(segments: DataFrame, bins: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Every bin (contig, start, end) with the level of its segment, by a bucketed join of bins' starts with segments."""
    points = bins.select("contig", F.col("start").alias("pos"), F.col("end").alias("_end"))
    met = interval_join(points, segments.select("contig", "start", "end", "cn"), bucket)
    return met.filter(F.col("_end") <= F.col("end")).select("contig", F.col("pos").alias("start"), F.col("_end").alias("end"), "cn")


def undo_breaks(y: np.ndarray, cuts: list[int], scale: float = 1.0) -> list[int]:
    """Breakpoints whose neighbouring segments' means differ by no more than `scale` of their pooled deviation are taken back, weakest first."""
    cuts = list(cuts)
    while cuts:
        edges = [0, *[c + 1 for c in cuts], len(y)]
        parts = [y[a:b] for a, b in zip(edges, edges[1:])]
        strength = [float(np.mean(np.abs(p.mean(axis=0) - q.mean(axis=0)) / np.maximum(np.sqrt((p.var(axis=0) + q.var(axis=0)) / 2), 1e-12))) for p, q in zip(parts, parts[1:])]
        weakest = int(np.argmin(strength))
        if strength[weakest] > scale:
            break
        del cuts[weakest]
    return cuts
