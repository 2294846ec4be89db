"""SimHash near-duplicate detection with a binary trie self-join.

Fingerprints: words of the ASCII-lower-cased text, 3-word shingles with
repeats, XXH64 with seed 42, majority of each bit.

Join: two fingerprints that differ in at most 3 bits agree in one of four
16-bit blocks, so each distinct fingerprint goes to four tries, rotated so that
the shared block leads. Sorted fingerprints are a binary trie, a node being a
range of them. Pairs of nodes that share the leading block are traversed together
level by level down to single fingerprints, adding up the differing bits and
dropping a pair once they exceed the budget. A pair of nodes whose fingerprints are
all connected by links already found is dropped too, so a large cluster of near
copies doesn't cost all its pairs, and no connection is lost. A crowded node is
split: each task takes one pair of its descendants of some levels below that can still meet
the budget.

Components: label propagation with pointer jumping over distinct fingerprints,
each round written to the shared folder. Only fingerprints with a link take part.

Nulls: a null or wordless text has fingerprint zero, which links like any
other. A null doc_id takes part but never names a component unless all of
the component's ids are null. Rows that repeat an id keep their own fingerprints and
each a row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import free_name, materialize, text_key

BUDGET, BLOCKS, BLOCK_BITS = 3, 4, 16
#: Node pairs held at once.
CHUNK = 1 << 15
#: Fingerprints of one leading block beyond which its node is split among tasks.
CROWD = 50_000
#: Turned fingerprints that a task of the trie join takes; it holds some four copies of their 33 bytes.
ROWS = 4_000_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(p, 42) for p in parts), np.uint64))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingles' hashes: bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, h.size, 1 << 14):
        part = h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > h.size).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, _key, fp): fp is the fingerprint as a signed long, _key tells apart rows that repeat an id."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t or b"", shingle) for t in (x.as_py() for x in b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("_key"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, _key bigint, fp bigint")


class Forest:
    """Components of 0..n-1 and the edges that made them; reach[i] ends the run of i's component that starts at i."""

    def __init__(self, n: int):
        self.root, self.edges, self.steps = np.arange(n), [], 0
        self.reach = np.arange(1, n + 1)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p, q = self.root[a], self.root[b]
        _, one = np.unique(np.minimum(p, q) * self.root.size + np.maximum(p, q), return_index=True)
        one = one[p[one] != q[one]]
        if not one.size:
            return
        self.edges.append(np.stack([a[one], b[one]]))
        a, b = a[one], b[one]
        while True:
            p, q = self.root[a], self.root[b]
            apart = p != q
            if not apart.any():
                break
            up = np.arange(self.root.size)
            np.minimum.at(up, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while True:
                higher = up[up]
                if (higher == up).all():
                    break
                up = higher
            self.root = up[self.root]
        n = self.root.size
        ends = np.flatnonzero(np.r_[self.root[1:] != self.root[:-1], True]) + 1
        self.reach = ends[np.searchsorted(ends, np.arange(n), side="right")]

    def connected(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        return (self.root[lo1] == self.root[lo2]) & (self.reach[lo1] >= hi1) & (self.reach[lo2] >= hi2)


def trie_links(values: np.ndarray, budget: int = BUDGET, shared_bits: int = BLOCK_BITS, between: tuple[int, int] | None = None) -> Forest:
    """Connects all of sorted distinct uint64 values that differ in at most budget bits.

    Pairs share the first shared_bits; with between, two prefixes of shared_bits bits, one is below each of these nodes.
    """
    n = values.size
    forest = Forest(n)
    if n < 2:
        return forest
    lead = values >> np.uint64(64 - shared_bits) if shared_bits else np.zeros(n, np.uint64)
    if between is None:
        starts = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
        ends = np.r_[starts[1:], n]
        keep = ends - starts > 1
        lo1, hi1 = starts[keep], ends[keep]
        lo2, hi2, bits = lo1, hi1, np.zeros(lo1.size, np.int64)
    else:
        (lo1, hi1), (lo2, hi2) = (np.searchsorted(lead, [np.uint64(x), np.uint64(x + 1)]).reshape(2, 1) for x in between)
        bits = np.array([(between[0] ^ between[1]).bit_count()])
        bits, lo1, hi1, lo2, hi2 = (x[(lo1 < hi1) & (lo2 < hi2) & (bits <= budget)] for x in (bits, lo1, hi1, lo2, hi2))
    # A stack of frontiers: (depth, lo1, hi1, lo2, hi2, differing bits so far). A node is a range of the sorted values.
    stack = [(shared_bits, lo1, hi1, lo2, hi2, bits)]
    while stack:
        depth, *pairs = stack.pop()
        if pairs[0].size > CHUNK:
            half = pairs[0].size // 2
            stack += [(depth, *[x[cut] for x in pairs]) for cut in (slice(half), slice(half, None))]
            continue
        rest = ~forest.connected(*pairs[:4])
        lo1, hi1, lo2, hi2, bits = (x[rest] for x in pairs)
        forest.steps += lo1.size
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        a, b = lo1[single], lo2[single]
        near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
        forest.join(a[near], b[near])
        lo1, hi1, lo2, hi2, bits = (x[~single] for x in (lo1, hi1, lo2, hi2, bits))
        if not lo1.size:
            continue
        # Each node's first value with this bit set; below that depth all its values share a prefix.
        step = np.uint64(1) << np.uint64(63 - depth)
        head = ~((step << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        mid1 = np.searchsorted(values, (values[lo1] & head) | step)
        mid2 = np.searchsorted(values, (values[lo2] & head) | step)
        same = lo1 == lo2
        parts = []
        for x, (l1, h1) in enumerate(((lo1, mid1), (mid1, hi1))):
            for y, (l2, h2) in enumerate(((lo2, mid2), (mid2, hi2))):
                spent = bits + (x != y)
                ok = (l1 < h1) & (l2 < h2) & (spent <= budget)
                if x > y:
                    ok &= ~same  # of a node with itself, one order will do
                if x == y:
                    ok &= ~same | (h1 - l1 > 1)
                parts.append([z[ok] for z in (l1, h1, l2, h2, spent)])
        joined = [np.concatenate(z) for z in zip(*parts)]
        if joined[0].size:
            stack.append((depth + 1, *joined))
    return forest


def links(fps: DataFrame) -> DataFrame:
    """Distinct fp -> edges (a, b) that connect all fingerprints within the budget of each other."""
    turn = lambda by: F.expr(f"(fp << {by}) | shiftrightunsigned(fp, {64 - by})") if by else F.col("fp")
    spread = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("block"), turn(BLOCK_BITS * i).alias("turned")) for i in range(BLOCKS)])).alias("x")).select("x.*")
    spread = spread.withColumn("lead", F.shiftrightunsigned("turned", 64 - BLOCK_BITS).cast("int"))
    # A crowded node's rows go, for each pair of its descendants `deeper` levels below within the budget, to that pair's task.
    crowds = spread.groupBy("block", "lead").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD)
    crowds = crowds.select("block", "lead", F.least(F.lit(12), F.ceil(F.log2(F.col("_n") / CROWD)) + 1).cast("int").alias("deeper"))
    spread = spread.join(crowds, ["block", "lead"], "left").withColumn("deeper", F.coalesce("deeper", F.lit(0)))
    own = F.when(F.col("deeper") > 0, F.expr(f"cast(shiftrightunsigned(turned << {BLOCK_BITS}, 64 - deeper) as int)")).otherwise(0)
    spread = spread.withColumn("own", own)
    others = F.expr(f"filter(sequence(0, shiftleft(1, deeper) - 1), x -> bit_count(x ^ own) <= {BUDGET})")
    spread = spread.withColumn("other", F.explode(F.when(F.col("deeper") > 0, others).otherwise(F.array(F.lit(0)))))
    spread = spread.select("block", "turned", "lead", "deeper", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches):
        parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(6)] for b in batches if b.num_rows]
        if not parts:
            return
        block, turned, lead, deeper, i, j = (np.concatenate(x) for x in zip(*parts))
        jobs = [((block == k) & (deeper == 0), k, BLOCK_BITS, None) for k in range(BLOCKS)]
        for k, at, d, x, y in np.unique(np.stack([block, lead, deeper, i, j])[:, deeper > 0], axis=1).T.tolist():
            mine = (block == k) & (lead == at) & (deeper == d) & (i == x) & (j == y)
            jobs.append((mine, k, BLOCK_BITS + d, None if x == y else ((at << d) | x, (at << d) | y)))
        for mine, k, bits, between in jobs:
            values = np.unique(turned[mine].view(np.uint64))
            edges = trie_links(values, BUDGET, bits, between).edges
            if edges:
                e = values[np.concatenate(edges, axis=1)]
                by = np.uint64(BLOCK_BITS * k)
                back = (e >> by) | (e << (np.uint64(64) - by)) if k else e
                yield pa.RecordBatch.from_arrays([pa.array(back[0].view(np.int64)), pa.array(back[1].view(np.int64))], ["a", "b"])

    # As many tasks as the session asks for, or as keep a task's rows near ROWS; a crowded node's rows come on top, up to CROWD a job.
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-BLOCKS * fps.count() // ROWS))
    return spread.repartition(n, "block", "lead", "i", "j").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): the smallest node reachable, by alternating large and small stars."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "links")
    mark = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: each larger neighbour points at the smallest node next to u.
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours point at the smallest of them.
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), "stars")
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (n, total)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, _key, fp, fingerprint, component_id, root): root is the component's own fingerprint."""
    fps = materialize(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = materialize(ids, "classes")
    roots = components(links(ids.select("fp")))
    named = ids.join(roots, ids["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per = named.join(best, "root").select("fp", "component_id", "root")
    # One row a fingerprint: rows of one fingerprint may be a third of all, and a skewed join splits them.
    out = fps.join(per, "fp")
    return out.select("doc_id", "_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with one row of each component: that with the smallest id (null last); of rows that repeat it, one."""
    found = near_duplicates(docs, shingle)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("_id"), F.col("x._key").alias("_k"))
    name = free_name(docs, "_simhash_key")
    keyed = docs.withColumn(name, text_key(F.col("text")))
    kept = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep["_id"]) & (keyed[name] == keep["_k"]), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).drop(name)
