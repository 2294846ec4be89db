"""Document fingerprints by prefix polynomial hashes.

A text of code points c has, for each of two primes p with base B, the prefix
array Q with Q[k] = sum over j < k of (c[j] + 1) * B**j mod p. The array answers
whether two spans are equal, wherever they stand, in constant time (their differences of Q, each multiplied by
the power of the other's place), and so finds the longest common extension of
two places, forwards or backwards, by binary search. The printed fingerprint is
the array's last entry under both primes, with the length before it.

Likeness of two fingerprints is read off their arrays: what two texts have in
common is found by extensions from their starts, from their ends, and from places
in between whose ``WINDOW`` code points have the same hash, the place being one where that hash is
divisible by ``STEP``; the k-th such place of one text meets the k-th of the
other. Likeness is twice the smaller number of code points covered, by X

An edited text's array needs its neighbour, so documents are cut by id into
blocks of about ``BLOCK_BYTES`` (edges from a sample of the ids alone, kept on the driver: one id a
block, at most ``MOST_BLOCKS``), each with a copy of the next block's first document,
and a block streams through a task in order of id. Arrays of many texts are
computed together, up to ``BUFFER`` code points; a longer text is on its own
and takes some 150 bytes a code point.

Nulls: a null text is empty. Null ids come first. Rows that repeat an id follow each
other in order of their texts, and each is the other's neighbour; an id that many rows repeat makes one
block. A single document is its own neighbour. An empty table gives an empty result. Two empty texts have
likeness 1, an empty and another 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
WINDOW, STEP = 32, 32
BUFFER = 1 << 20
BLOCK_BYTES, MOST_BLOCKS = 16_000_000, 100_000


class Powers:
    """Powers of the bases and of their inverses, grown as needed."""

    def __init__(self):
        self.size, self.up, self.down = 0, [], []

    def reach(self, size: int) -> None:
        if size <= self.size:
            return
        self.size = 1 << max(size - 1, 1).bit_length()
        self.up = [self._powers(b, p) for b, p in zip(BASES, PRIMES)]
        self.down = [self._powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES)]

    def _powers(self, base: int, p: int) -> np.ndarray:
        out = np.ones(self.size, np.uint32)
        done, factor = 1, base
        while done < self.size:
            out[done : 2 * done] = out[:done].astype(np.uint64) * np.uint64(factor) % np.uint64(p)
            done, factor = 2 * done, factor * factor % p
        return out


class Prefixes:
    """The prefix arrays of several texts in one buffer, and what they answer."""

    def __init__(self, texts: list[np.ndarray], powers: Powers):
        self.length = np.array([t.size for t in texts], np.int64)
        self.start = np.r_[0, np.cumsum(self.length)][:-1]
        points = np.concatenate([*texts, np.zeros(0, np.uint32)])
        powers.reach(points.size + 1)
        self.powers, self.sums = powers, []
        for up, p in zip(powers.up, PRIMES):
            q = np.zeros(points.size + 1, np.uint32)
            q[1:] = np.cumsum((points + np.uint64(1)) * up[: points.size] % np.uint64(p), dtype=np.uint64) % np.uint64(p)
            self.sums.append(q)

    def _span(self, k: int, at: np.ndarray, length) -> np.ndarray:
        p, q = np.uint64(PRIMES[k]), self.sums[k]
        return (q[at + length] + (p - q[at])) % p

    def value(self, at: np.ndarray, length) -> list[np.ndarray]:
        """Hashes of spans, the same wherever they stand."""
        return [self._span(k, at, length) * self.powers.down[k][at] % np.uint64(PRIMES[k]) for k in range(2)]

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        same = np.ones(i.size, bool)
        for k, p in enumerate(PRIMES):
            up = self.powers.up[k]
            same &= self._span(k, i, length) * up[j] % np.uint64(p) == self._span(k, j, length) * up[i] % np.uint64(p)
        return same

    def forwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common extension to the right of places i and j, at most so many code points."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same to the left: spans that end before i and j."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(i - mid, j - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def fingerprints(self) -> list[str]:
        one, two = self.value(self.start, self.length)
        return [f"{n:x}-{a:08x}{b:08x}" for n, a, b in zip(self.length.tolist(), one.tolist(), two.tolist())]

    def _anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, hash) of the places to align at, by text and place."""
        n = int(self.length.sum())
        if n < WINDOW:
            return (np.zeros(0, np.int64),) * 3
        at = np.arange(n - WINDOW + 1)
        one = self._span(0, at, WINDOW) * self.powers.down[0][at] % np.uint64(PRIMES[0])
        at = at[one % np.uint64(STEP) == 0]
        text = np.searchsorted(self.start, at, side="right") - 1
        at, text = (x[at + WINDOW <= self.start[text] + self.length[text]] for x in (at, text))
        one, two = self.value(at, WINDOW)
        return text, at, (one << np.uint64(32) | two).astype(np.int64)

    def likeness(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs of texts, given by their numbers."""
        nx, ny, sx, sy = self.length[x], self.length[y], self.start[x], self.start[y]
        less, pair = np.minimum(nx, ny), np.arange(x.size)
        head = self.forwards(sx, sy, less)
        tail = self.backwards(sx + nx, sy + ny, less - head)
        spans = [(pair, np.zeros_like(head), np.zeros_like(head), head), (pair, nx - tail, ny - tail, tail)]
        text, at, mark = self._anchors()
        first, last = np.searchsorted(text, np.arange(self.length.size)), np.searchsorted(text, np.arange(self.length.size), side="right")

        def between(t, start, n):
            """Anchors of a pair's text that its head and tail don't cover: (pair, place, hash, how often the hash came before)."""
            count = last[t] - first[t]
            p = np.repeat(pair, count)
            k = np.repeat(first[t] - np.r_[0, np.cumsum(count)][:-1], count) + np.arange(p.size)
            a, m = at[k] - start[p], mark[k]
            kept = (a >= head[p]) & (a + WINDOW <= n[p] - tail[p])
            p, a, m = p[kept], a[kept], m[kept]
            order = np.lexsort((a, m, p))
            p, a, m = p[order], a[order], m[order]
            new = np.r_[True, (p[1:] != p[:-1]) | (m[1:] != m[:-1])][: p.size]
            nth = np.arange(p.size) - np.maximum.accumulate(np.where(new, np.arange(p.size), 0)) if p.size else p
            return p, a, m, nth

        (p1, a1, m1, k1), (p2, a2, m2, k2) = between(x, sx, nx), between(y, sy, ny)
        p, a, m, k = (np.concatenate(c) for c in ((p1, p2), (a1, a2), (m1, m2), (k1, k2)))
        side = np.repeat([0, 1], [p1.size, p2.size])
        order = np.lexsort((side, k, m, p))
        p, a, m, k, side = p[order], a[order], m[order], k[order], side[order]
        met = np.flatnonzero((p[1:] == p[:-1]) & (m[1:] == m[:-1]) & (k[1:] == k[:-1]) & (side[1:] != side[:-1]))
        p, i, j = p[met], a[met], a[met + 1]
        if p.size:
            right = self.forwards(sx[p] + i, sy[p] + j, np.minimum(nx[p] - i, ny[p] - j))
            left = self.backwards(sx[p] + i, sy[p] + j, np.minimum(i, j))
            spans.append((p, i - left, j - left, left + right))
        p, i, j, length = (np.concatenate(c) for c in zip(*spans))
        covered = np.minimum(self._covered(p, i, length, nx), self._covered(p, j, length, ny))
        both = np.maximum(nx + ny, 1)
        return np.where((head == nx) & (head == ny), 1.0, np.minimum(2 * covered, both - 1) / both)

    @staticmethod
    def _covered(pair: np.ndarray, at: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Code points of each pair's text that lie in one of its spans."""
        base = np.r_[0, np.cumsum(n + 1)]
        place = base[pair] + at
        change = np.bincount(place, minlength=base[-1]) - np.bincount(place + length, minlength=base[-1])
        inside = np.r_[0, np.cumsum(np.cumsum(change) > 0)]
        return inside[base[1:]] - inside[base[:-1]]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def describe(texts: list[str], powers: Powers) -> list[tuple]:
    """For all texts but the last, whose neighbour is the next one: n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    edited = []
    for one, following in zip(texts[:-1], texts[1:]):
        cut = len(one) // 4
        edited.append(one[: len(one) - cut] + following[:cut])
    k = len(edited)
    held = Prefixes([points_of(t) for t in texts + edited], powers)
    prints = held.fingerprints()
    near = held.likeness(np.r_[np.arange(k), np.arange(k)], np.r_[k + 1 + np.arange(k), 1 + np.arange(k)])
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    return [(len(texts[d]), sha[d], prints[d], prints[k + 1 + d], float(near[d]), float(near[k + d])) for d in range(k)]


def _cut(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs (doc_id, text) with block and ahead, ahead for the copy of the following block's first document; in order within a block."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = int(min(max(1, -(-total // block_bytes)), MOST_BLOCKS))
    ids = docs.select("doc_id").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    edges = ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    has_null = any(r["nulls"] for r in edges)
    first = sorted({r["first"] for r in edges if r["first"] is not None})
    # Block 0 holds what lies before the second range's first id, null ids too.
    begin = np.array(first[1:], np.int64 if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else object)
    blocks = begin.size + 1

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series, is_null: pd.Series) -> pd.Series:
        """The row's block, and the one before where the row is its block's first. Nulls come apart from the ids, which stay whole numbers so."""
        null = is_null.to_numpy(bool)
        known = doc_id[~null].to_numpy().astype(begin.dtype)
        block, opens = np.zeros(len(doc_id), np.int64), null & has_null
        block[~null] = np.searchsorted(begin, known, side="right")
        opens[~null] = np.isin(known, begin)
        if first and not has_null:
            opens[~null] |= known == first[0]
        return pd.Series([[b, (b - 1) % blocks] if o else [b] for b, o in zip(block.tolist(), opens.tolist())])

    placed = docs.select("doc_id", "text", F.posexplode(places(F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)), F.col("doc_id").isNull())).alias("ahead", "block"))
    return placed.repartition(n, "block").sortWithinPartitions("block", "ahead", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_report(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buffer: int = BUFFER) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema["doc_id"].dataType
    types = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, t) for c, t in zip(NAMES, types)]])
    id_type = T.StructType([schema[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, ids, texts, held = Powers(), [], [], 0
        block, ended = None, False

        def flush():
            if len(texts) < 2:
                return
            cols = [ids[:-1], *map(list, zip(*describe(texts, powers)))]
            arrow = [b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow)], ["doc_id", *NAMES])

        for b in batches:
            for doc_id, text, ahead, of in zip(*[b.column(c) for c in range(4)]):
                if of.as_py() != block:
                    block, ended, ids, texts, held = of.as_py(), False, [], [], 0
                if ended:
                    continue
                said = (text.as_py() or b"").decode("utf-8", "replace")
                ids.append(doc_id.as_py())
                texts.append(said)
                held += len(said)
                ended = bool(ahead.as_py())
                if ended or held > buffer:
                    yield from flush()
                    ids, texts, held = ids[-1:], texts[-1:], len(said)

    cut = _cut(docs.select("doc_id", "text"), block_bytes)
    out = cut.select("doc_id", F.col("text").cast("binary").alias("text"), "ahead", "block").mapInArrow(run, schema)
    return out.select(*id_type.fieldNames(), *NAMES)


def fingerprints(texts: list[str]) -> list[str]:
    """Of texts at hand."""
    return Prefixes([points_of(t) for t in texts], Powers()).fingerprints()


def likeness(one: str, other: str) -> float:
    """Of two texts at hand."""
    return float(Prefixes([points_of(one), points_of(other)], Powers()).likeness(np.array([0]), np.array([1]))[0])
