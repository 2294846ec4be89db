"""Removal of repeated passages: every byte covered by a string of ``length`` bytes that also starts earlier.

Each window of ``length`` bytes has an anchor, its k-gram with the least hash (the
leftmost of equals), so equal windows have equal anchors at equal places. Anchors are the
sampled positions of the suffix arrays; an anchor with all windows that it owns is a sampled suffix
with its left and right context.

1. One scan counts the anchors; those found once can't be in a repeated window.
2. A second scan sorts the others: equal contexts form classes, and a class's
   occurrences beyond its first document are removed whole.
3. Where one anchor has several contexts, at the edges of repeats, a third scan emits the bytes of
   each class's first document. They go, batch by batch of documents, through a ``Family`` of suffix
   arrays: a new batch is sorted and merge-scanned against the levels there are, neighbours' common
   prefixes bound what can match, and matches of ``length`` bytes are compared byte by byte.
   Levels of equal rank merge before the next batch.

Matches of step 3 are compared by their bytes. The classes of step 2 are not: contexts with one
anchor are told apart by 64 bits of a polynomial hash, beside the anchor's own 64.

Which anchors a scan emits is told to the tasks by a bitmap of ``MAP_BITS`` bits, whatever the
input's size: a false mark costs a few rows, never a wrong result.

Nulls: a null text is empty. A null doc_id comes after all others. Rows that
share an id are separate documents, neither earlier than the other. Texts shorter than
``length`` lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, text_key

LENGTH, GRAM = 100, 32
#: The documents come to the family of suffix arrays in so many batches.
BATCHES = 4
MAP_BITS = 1 << 29
#: Texts are hashed together up to so many bytes.
TOGETHER = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up.size < n:
            n = max(n, 2 * cls.up.size, TOGETHER + LENGTH)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


class Scan:
    """Anchors of a run of texts. start[i]..end[i] are a text's bytes in the run."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        sizes = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        b = np.frombuffer(b"".join(texts), np.uint8)
        n = b.size
        up, self.down = Powers.to(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[:n], out=self.sums[1:])
        # Windows that lie within one text.
        window = np.ones(n, bool)
        for e, s in zip(self.end.tolist(), self.start.tolist()):
            window[max(e - length + 1, s) : e] = False
        self.windows = np.flatnonzero(window)
        if not self.windows.size:
            self.anchor = self.low = self.high = np.zeros(0, np.int64)
            return
        m = n - gram + 1
        self.grams = mix((self.sums[gram:] - self.sums[:m]) * self.down[:m])
        best = (self.grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        span, wide = 1, length - gram + 1
        while 2 * span <= wide:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < wide:
            best = np.minimum(best[: best.size - (wide - span)], best[wide - span :])
        owner = (best[self.windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Owners never decrease, so a run of equal ones is an anchor's windows.
        edge = np.flatnonzero(owner[1:] != owner[:-1])
        first, last = np.r_[0, edge + 1], np.r_[edge, owner.size - 1]
        self.anchor, self.low, self.high = owner[first], self.windows[first], self.windows[last]

    def hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.down[low])

    def fingerprints(self) -> np.ndarray:
        return self.grams[self.anchor] if self.anchor.size else np.zeros(0, np.uint64)

    def contexts(self, at: np.ndarray) -> np.ndarray:
        a, lo, hi = self.anchor[at], self.low[at], self.high[at]
        return mix(self.hash(lo, hi + self.length) ^ ((a - lo) * 4096 + (hi - a)).astype(np.uint64))

    def texts_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, pos, side="right")


def _runs(batch: pa.RecordBatch, text_at: int):
    """(rows, Scan) over stretches of a batch of about TOGETHER bytes."""
    texts, at, size = [], 0, 0
    column = batch.column(text_at)
    for i in range(batch.num_rows):
        t = column[i].as_py() or b""
        texts.append(t)
        size += len(t)
        if size >= TOGETHER or i == batch.num_rows - 1:
            yield np.arange(at, i + 1), texts
            texts, at, size = [], i + 1, 0


def _docs(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text_key(F.col("text")).alias("_key"), F.xxhash64("doc_id").alias("_mark"), text.cast("binary").alias("text"))


def bitmap(spark: SparkSession, keys: DataFrame, n: int):
    """keys (h bigint, any 64 bits) -> broadcast (bits, bytes): 32 bits a key, MAP_BITS at most, gathered as blocks."""
    bits = min(MAP_BITS, 1 << max(20, (32 * n).bit_length() - 1))
    shift, block = 64 - bits.bit_length() + 1, 1 << 20
    place = F.shiftrightunsigned("h", shift)

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(p // block):
                found.setdefault(int(k), np.zeros(block // 8, np.uint8))
                q = np.unique(p[p // block == k] % block)
                np.bitwise_or.at(found[int(k)], q >> 3, (1 << (q & 7)).astype(np.uint8))
        for k, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["k", "v"])

    parts = keys.select(place.alias("p")).repartition(max(1, min(bits // block, 64)), F.expr(f"p div {block}")).mapInArrow(run, "k bigint, v binary").toLocalIterator()
    whole = bytearray(bits // 8)
    for r in parts:
        whole[r["k"] * block // 8 : (r["k"] + 1) * block // 8] = r["v"]
    return spark.sparkContext.broadcast((shift, bytes(whole)))


def marked(found, h: np.ndarray) -> np.ndarray:
    shift, data = found
    p = h >> np.uint64(shift)
    return (np.frombuffer(data, np.uint8)[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _half(fp: np.ndarray) -> np.ndarray:
    """32 bits of a fingerprint, mixed anew: anchors are least hashes, so their own upper bits crowd at the low end."""
    return mix(fp) >> np.uint64(32)


def _again(text: np.ndarray, fp: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """True for anchors with the same context as an earlier one of their text."""
    order = np.lexsort((np.arange(fp.size), ctx, fp, text))
    t, f, c = text[order], fp[order], ctx[order]
    out = np.zeros(fp.size, bool)
    out[order[1:]] = (t[1:] == t[:-1]) & (f[1:] == f[:-1]) & (c[1:] == c[:-1])
    return out


def _counts(docs: DataFrame) -> DataFrame:
    """(h): 32 bits, in the upper half, of each anchor's fingerprint that occurs more than once."""

    def run(batches):
        for b in batches:
            for _, texts in _runs(b, 0):
                f = _half(Scan(texts).fingerprints()).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(f)], ["h"])

    return docs.select("text").mapInArrow(run, "h int").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select((F.col("h").cast("bigint") * F.lit(1 << 32)).alias("h"))


def _anchors(docs: DataFrame, repeated) -> DataFrame:
    """The anchors that may be repeated: doc_id, _key, fp, ctx, low, high (first byte of the first window, end of the last), copy and deal.

    copy: an equal context stands earlier in the same Arrow batch of documents, so the range goes whatever else
    there is. Such rows need no company: deal spreads them, where others are dealt by their anchor.
    """
    names = ["doc_id", "_key", "fp", "ctx", "low", "high"]

    def run(batches):
        for b in batches:
            found = []
            for rows, texts in _runs(b, 2):
                s = Scan(texts)
                fp = s.fingerprints()
                at = np.flatnonzero(marked(repeated.value, _half(fp) << np.uint64(32)))
                if at.size:
                    t = s.texts_of(s.anchor[at])
                    found.append((rows[t], fp[at], s.contexts(at), s.low[at] - s.start[t], s.high[at] - s.start[t] + s.length))
            if not found:
                continue
            row, fp, ctx, low, high = (np.concatenate(c) for c in zip(*found))
            doc, key = _ranks(b.column(0))[row], b.column(1).to_numpy()[row]
            order = np.lexsort((low, key, doc, ctx, fp))
            d, k, p = doc[order], key[order], low[order]
            start, n = _changes(fp[order], ctx[order]), np.arange(order.size)
            first = np.maximum.accumulate(np.where(start, n, 0))
            own = np.maximum.accumulate(np.where(start | _changes(d, k), n, 0))
            copy = np.empty(order.size, bool)
            copy[order] = (d != d[first]) | (p > p[own])
            deal = np.where(copy, mix(key.view(np.uint64) ^ low.astype(np.uint64)), fp).view(np.int64)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(low), pa.array(high), pa.array(copy), pa.array(deal)], [*names, "copy", "deal"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_key", "text").mapInArrow(run, f"doc_id {kind}, _key bigint, fp bigint, ctx bigint, low bigint, high bigint, copy boolean, deal bigint")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column, and for the first."""
    out = np.ones(columns[0].size, bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values get equal numbers; null is -1."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _classes(rows: DataFrame) -> DataFrame:
    """Anchors -> tables told apart by kind: "gone" holds the ranges that go whole, "edge" one row (its first) of each class whose anchor has several contexts.

    The rows of a class pass in order, so what is kept from one Arrow batch to the next is two rows: the class's first and the first of its current document.
    """
    names = ["doc_id", "_key", "fp", "ctx", "low", "high"]

    def run(batches):
        kept, before = None, False  # before: the kept class's anchor had another class already

        def told(t: pa.RecordBatch, at: np.ndarray, kind: str):
            c = t.take(pa.array(at))
            return pa.RecordBatch.from_arrays([*c.columns, pa.array([kind] * at.size, pa.string())], [*names, "kind"])

        for b in batches:
            copy = b.column("copy")
            yield told(b.select(names), np.flatnonzero(copy.to_numpy(zero_copy_only=False)), "gone")
            b = b.select(names).filter(pc.invert(copy))
            if not b.num_rows:
                continue
            old = 0 if kept is None else kept.num_rows
            t = b if kept is None else pa.Table.from_batches([kept, b.cast(kept.schema)]).combine_chunks().to_batches()[0]
            fp, ctx, key, low = (t.column(c).to_numpy() for c in ("fp", "ctx", "_key", "low"))
            doc, n = _codes(t.column("doc_id")), np.arange(t.num_rows)
            start = _changes(fp, ctx)
            first = np.maximum.accumulate(np.where(start, n, 0))
            own = np.maximum.accumulate(np.where(start | _changes(doc, key), n, 0))
            gone = (doc != doc[first]) | (low > low[own])
            yield told(t, n[gone & (n >= old)], "gone")
            at = np.flatnonzero(start)
            same = np.r_[before, fp[at[1:]] == fp[at[:-1]]]
            yield told(t, at[:-1][same[:-1] | same[1:]], "edge")
            kept, before = t.take(pa.array([at[-1], own[-1]])), bool(same[-1])
        if kept is not None and before:
            yield told(kept, np.array([0]), "edge")

    ordered = rows.repartition("deal").drop("deal").sortWithinPartitions("copy", "fp", "ctx", F.col("doc_id").asc_nulls_last(), "_key", "low")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {kind}, _key bigint, fp bigint, ctx bigint, low bigint, high bigint, kind string")


def _class_mark(fp: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(fp ^ (ctx * np.uint64(_BASE)) ^ (doc * np.uint64(0xC2B2AE3D27D4EB4F)))


def _edges(docs: DataFrame, wanted) -> DataFrame:
    """The marked classes' first anchors in the marked documents with their bytes: doc_id, _key, fp, low, head (the bytes before the anchor), suffix (those from it on)."""

    def run(batches):
        for b in batches:
            marks = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for rows, texts in _runs(b, 3):
                s = Scan(texts)
                if not s.anchor.size:
                    continue
                fp, t, ctx = s.fingerprints(), s.texts_of(s.anchor), s.contexts(np.arange(s.anchor.size))
                at = np.flatnonzero(marked(wanted.value, _class_mark(fp, ctx, marks[rows[t]])))
                at = at[~_again(t[at], fp[at], ctx[at])]  # what is there again goes whole
                if not at.size:
                    continue
                t, pick = t[at], pa.array(rows[t[at]])
                low, mid, high, whole = s.low[at], s.anchor[at], s.high[at] + s.length, b"".join(texts)
                head = [whole[x:y] for x, y in zip(low.tolist(), mid.tolist())]
                suffix = [whole[x:y] for x, y in zip(mid.tolist(), high.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(fp[at].view(np.int64)), pa.array(low - s.start[t]), pa.array(head, pa.binary()), pa.array(suffix, pa.binary())], ["doc_id", "_key", "fp", "low", "head", "suffix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, _key bigint, fp bigint, low bigint, head binary, suffix binary")


def _windows(t: pa.RecordBatch, most: np.ndarray | None = None):
    """Windows of these entries, those alone that reach ``most`` bytes at most from the anchor on: (row, w1, w2, pos, the bytes, start of each window in them)."""
    fp, low = t.column("fp").to_numpy().view(np.uint64), t.column("low").to_numpy()
    heads, suffixes = t.column("head").to_pylist(), t.column("suffix").to_pylist()
    place = np.array([len(x) for x in heads], np.int64)
    sizes = place + np.array([len(x) for x in suffixes], np.int64)
    start = np.cumsum(sizes) - sizes
    b = np.frombuffer(b"".join([x for pair in zip(heads, suffixes) for x in pair]), np.uint8)
    up, down = Powers.to(b.size + 1)
    sums = np.zeros(b.size + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: b.size], out=sums[1:])
    n = sizes - LENGTH + 1
    if most is not None:
        n = np.clip(place + most - LENGTH + 1, 0, n)
    row = np.repeat(np.arange(sizes.size), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s = start[row] + k
    w2 = mix((sums[s + LENGTH] - sums[s]) * down[s])
    return row, mix(fp[row] ^ ((place[row] - k).astype(np.uint64) * np.uint64(_BASE))), w2, low[row] + k, b, s


#: An anchor with more entries than this has its windows dealt out by Spark; others are scanned so many at a time.
HOT_EDGES = 20_000


def _ranks(doc_id: pa.Array) -> np.ndarray:
    """The order of ids among themselves; null last."""
    return pc.rank(doc_id, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def _common(t: pa.RecordBatch, start: np.ndarray) -> np.ndarray:
    """Bytes that each entry's suffix has in common with one of its neighbours' of the same anchor: no other suffix of the anchor has more."""
    suffixes = t.column("suffix").to_pylist()
    wide = max(len(x) for x in suffixes)
    size = np.array([len(x) for x in suffixes], np.int64)
    m = np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in suffixes]), np.uint8).reshape(-1, wide)
    differ = m[1:] != m[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    lcp = np.where(start[1:], 0, np.minimum(lcp, np.minimum(size[1:], size[:-1])))
    return np.maximum(np.r_[0, lcp], np.r_[lcp, 0])


def _earlier(t: pa.RecordBatch) -> pa.RecordBatch | None:
    """Entries in suffix order, whole anchors -> (doc_id, _key, low, high): runs of windows that occur earlier."""
    fp = t.column("fp").to_numpy()
    start = _changes(fp)
    most = _common(t, start)
    fresh = np.bincount(np.cumsum(start) - 1, weights=t.column("fresh").to_numpy(zero_copy_only=False))[np.cumsum(start) - 1] > 0
    at = np.flatnonzero(fresh & (most > 0))
    if not at.size:
        return None
    t, most = t.take(pa.array(at)), most[at]
    key = t.column("_key").to_numpy()
    row, w1, w2, pos, b, s = _windows(t, most)
    if not row.size:
        return None
    doc = _ranks(t.column("doc_id"))
    order = np.lexsort((pos, key[row], doc[row], w2, w1))
    r, p, s = row[order], pos[order], s[order]
    new = _changes(w1[order], w2[order])
    view, same = np.lib.stride_tricks.sliding_window_view(b, LENGTH), np.flatnonzero(~new)
    for lo in range(0, same.size, 1 << 16):
        q = same[lo : lo + (1 << 16)]
        new[q] = (view[s[q]] != view[s[q - 1]]).any(axis=1)
    first = np.maximum.accumulate(np.where(new, np.arange(r.size), 0))
    own = np.maximum.accumulate(np.where(new | _changes(doc[r], key[r]), np.arange(r.size), 0))
    later = (doc[r] > doc[r[first]]) | (p > p[own])
    r, p = r[later], p[later]
    order = np.lexsort((p, r))
    r, p = r[order], p[order]
    at = np.flatnonzero(_changes(r, p - np.arange(p.size))) if r.size else np.zeros(0, np.int64)
    end = p[np.r_[at[1:], r.size] - 1] + LENGTH if r.size else p
    pick = pa.array(r[at])
    return pa.RecordBatch.from_arrays([t.column("doc_id").take(pick), t.column("_key").take(pick), pa.array(p[at]), pa.array(end)], ["doc_id", "_key", "low", "high"])


_ENTRY = ["doc_id", "_key", "fp", "low", "head", "suffix"]


def _suffix_order(entries: DataFrame) -> DataFrame:
    """Partitions by anchor, each a suffix array: an anchor's suffixes stand in the order of their bytes."""
    return entries.repartition("fp").sortWithinPartitions("fp", "suffix", "head", F.col("doc_id").asc_nulls_last(), "_key", "low")


class Family:
    """Suffix arrays in levels. A level of rank r holds 2^r batches; levels of equal rank merge before the next batch comes."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """batch (doc_id, _key, fp, low, head, suffix) -> (doc_id, _key, low, high) tables: what occurs earlier, in the batch or in the levels, for the batch's entries and the levels'."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, materialize(_suffix_order(one.unionByName(two)), "suffix-level")))
        rows = batch.select(*_ENTRY, F.lit(True).alias("fresh"))
        for _, level in self.levels:
            rows = rows.unionByName(level.select(*_ENTRY, F.lit(False).alias("fresh")))
        scan = materialize(_merge_scan(_suffix_order(rows)), "suffix-scan")
        self.levels.append((0, scan.filter("kind = 'entry'").select(_ENTRY)))
        hot = scan.filter("kind = 'hot'").select(_ENTRY)
        return [scan.filter("kind = 'gone'").select("doc_id", "_key", "low", "high"), *([] if hot.isEmpty() else [_dealt_repeats(hot)])]


def _merge_scan(rows: DataFrame) -> DataFrame:
    """Entries in suffix order -> rows told apart by kind: "gone" (ranges), "entry" (the fresh ones, in order) and "hot" (all entries of anchors with more than HOT_EDGES)."""
    doc = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "_key", "fp", "low", "head", "suffix", "high", "kind"]

    def told(t: pa.RecordBatch, kind: str) -> pa.RecordBatch:
        n = t.num_rows
        return pa.RecordBatch.from_arrays([t.column(c) if c in t.schema.names else pa.nulls(n, {"fp": pa.int64(), "head": pa.binary(), "suffix": pa.binary(), "high": pa.int64()}[c]) for c in names[:-1]] + [pa.array([kind] * n, pa.string())], names)

    def run(batches):
        left: list[pa.RecordBatch] = []
        size, hot = 0, None
        for b in batches:
            fresh = b.filter(b.column("fresh"))
            if fresh.num_rows:
                yield told(fresh, "entry")
            if hot is not None:
                n = int((b.column("fp").to_numpy() == hot).sum())
                if n:
                    yield told(b.slice(0, n), "hot")
                b = b.slice(n)
            if not b.num_rows:
                continue
            hot = None
            left.append(b)
            size += b.num_rows
            if size <= HOT_EDGES:
                continue
            t = pa.Table.from_batches(left).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(_changes(t.column("fp").to_numpy()))[-1])
            got = _earlier(t.slice(0, cut)) if cut else None
            if got is not None:
                yield told(got, "gone")
            t = t.slice(cut)
            if t.num_rows > HOT_EDGES:
                hot = t.column("fp")[0].as_py()
                yield told(t, "hot")
                left, size = [], 0
            else:
                left, size = [t], t.num_rows
        if left:
            got = _earlier(pa.Table.from_batches(left).combine_chunks().to_batches()[0])
            if got is not None:
                yield told(got, "gone")

    return rows.mapInArrow(run, f"doc_id {doc}, _key bigint, fp bigint, low bigint, head binary, suffix binary, high bigint, kind string")


def _dealt_repeats(edges: DataFrame) -> DataFrame:
    """The same for anchors of many edges, window by window with partial sums."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                row, w1, w2, pos, *_ = _windows(c)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([c.column(0).take(pick), c.column(1).take(pick), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(pos)], ["doc_id", "_key", "w1", "w2", "pos"])

    kind = edges.schema["doc_id"].dataType.simpleString()
    w = edges.mapInArrow(run, f"doc_id {kind}, _key bigint, w1 bigint, w2 bigint, pos bigint")
    w = materialize(w, "suffix-windows")
    own = w.groupBy("w1", "w2", "doc_id", "_key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    least = w.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = w.join(least, ["w1", "w2"])
    inside = own.filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ("w1", "w2", "doc_id", "_key", "first")])
    later = later.join(inside, (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("__key")), "left")
    return later.filter(_after("least") | (F.col("pos") > F.col("_first"))).select("doc_id", "_key", F.col("pos").alias("low"), (F.col("pos") + LENGTH).alias("high"))


def _after(least: str):
    """doc_id comes after least; null comes last."""
    return F.coalesce(F.col("doc_id") > F.col(least), F.col("doc_id").isNull() & F.col(least).isNotNull())


def repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, _key, low, high): byte ranges, overlapping perhaps, that together are all to remove."""
    spark, d = docs.sparkSession, _docs(docs)
    found = materialize(_counts(d), "suffix-repeated")
    classes = materialize(_classes(_anchors(d, bitmap(spark, found, found.count()))), "suffix-classes")
    edge = classes.filter("kind = 'edge'").select("fp", "ctx", F.xxhash64("doc_id").alias("mark"))

    def marks(batches):
        for b in batches:
            fp, ctx, doc = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(_class_mark(fp, ctx, doc).view(np.int64))], ["h"])

    edges = _edges(d, bitmap(spark, edge.mapInArrow(marks, "h bigint"), edge.count()))
    edges = materialize(edges.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int")), "suffix-edges")
    # Anchors with too many contexts for one task never meet in one.
    hot = materialize(edges.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_EDGES).select("fp"), "suffix-hot")
    family, found = Family(), [classes.filter("kind = 'gone'").select("doc_id", "_key", "low", "high")]
    calm = edges
    if not hot.isEmpty():
        calm = edges.join(hot, "fp", "left_anti")
        found.append(_dealt_repeats(edges.join(hot, "fp", "left_semi").select(_ENTRY)))
    for i in range(BATCHES):
        found += family.add(calm.filter(F.col("batch") == i).select(_ENTRY))
    return reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    d = docs.select("doc_id", "text")
    spans = repeats(d).groupBy("doc_id", "_key").agg(F.collect_list(F.struct("low", "high")).alias("spans")).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "spans.low", "spans.high")
    base = _docs(d).drop("_mark")
    both = base.join(spans, base["doc_id"].eqNullSafe(spans["_id"]) & (base["_key"] == spans["_k"]), "left").select("doc_id", "text", "low", "high")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = []
                for text, low, high in zip(*[b.column(i) for i in (1, 2, 3)]):
                    t = text.as_py()
                    if low.as_py() is None:
                        out.append((len(t), 0, 0, t))
                        continue
                    n = len(t)
                    over = np.bincount(np.asarray(low.as_py()), minlength=n + 1) - np.bincount(np.asarray(high.as_py()), minlength=n + 1)
                    gone = np.cumsum(over[:n]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((n, int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
                n, removed, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
