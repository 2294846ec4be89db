"""Near copies by 5-word shingles and Jaccard similarity of at least 0.8.

Shingles: words of the ASCII-lower-cased text, as in simhash; a text of no more
words than a shingle is one shingle, and texts without words are alike. A text's
set is its distinct shingles by XXH64; texts of equal sets are one class.

Candidates: each set has a SimHash fingerprint, and the trie self-join of simhash links
those within its budget of 3 bits; a component of fingerprints is a group. Sets at the
similarity differ in some 10 bits, beyond what a trie can prune, so that links farther
apart are found by min-hashes in BANDS bands of ROWS as well: classes that agree in a band
are a group too. A pair at Jaccard 0.8 agrees in no band with probability
(1 - 0.8^5)^20 = 0.04 %, and with less above; it is lost only if its fingerprints
aren't in one component either.

Verification: every link is a pair whose exact Jaccard similarity was computed
from both sets. Each group's members are held against one pivot, its smallest
class in the first round and its largest in the second. What groups are still in
several components then goes through an exact prefix filter (rarest shingles
first, with size and place bounds), which pairs members of different components
only: first one pair for two components, then all that are left. So a large group of near copies costs a few pairs a member, a large group of texts
that share a common part but not enough of it costs none, and no link of a group is left out:
a pair that isn't compared is connected already or can't reach the similarity.

Nulls: a null or wordless text is in the class of the empty set. A null doc_id is
kept only in a component whose ids are all null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm import simhash
from helixframe.llm.common import free_name, materialize, text_key
from helixframe.llm.simhash import components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Shingles whose min-hashes are computed at once.
CHUNK = 1 << 12
#: Sizes are dealt into buckets whose bounds grow by this factor.
SIZE_STEP = 1.02
#: The filter of texts that have candidates: bits a text, and at most 32 MB.
HOT_PAIRS, SALTS = 5_000, 64
FILTER_BITS, FILTER_MOST = 16, 28

_random = np.random.default_rng(42)
_XOR = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, 42) for p in parts), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of its min-hashes and its number."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, hashes.size, CHUNK):
        least = np.minimum(least, ((hashes[at : at + CHUNK] ^ _XOR) * _ODD).min(axis=1))
    return np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _key, node, n, fp, bands): node is the class of the text's set, n the set's size, fp its fingerprint."""

    def run(batches):
        for b in batches:
            node, n, bands = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
            fp = np.zeros(b.num_rows, np.uint64)
            for i, t in enumerate(b.column(2)):
                h = shingle_set(t.as_py() or b"", shingle)
                node[i], n[i] = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).view(np.int64), h.size
                fp[i] = simhash.majority(h)
                bands.append(band_keys(h).view(np.int64) if h.size else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(n), pa.array(fp.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "_key", "node", "n", "fp", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("_key"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, _key bigint, node bigint, n bigint, fp bigint, bands array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """wanted (_key, node): one text of each class -> (node, hashes). A bitmap spares all other texts the shuffle."""
    spark = docs.sparkSession
    bits = min(FILTER_MOST, max(10, int(FILTER_BITS * wanted.count()).bit_length()))
    place = F.col("_key").bitwiseAND(F.lit((1 << bits) - 1))
    marks = wanted.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(_key & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[marks.column("w").to_numpy()] = marks.column("b").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches):
        held, mask = shared.value, np.int64((1 << bits) - 1)
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            at = key & mask
            hit = np.flatnonzero((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            if hit.size:
                found = [shingle_set(b.column(1)[i].as_py() or b"", shingle).view(np.int64) for i in hit.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(found, pa.list_(pa.int64()))], ["_key", "hashes"])

    texts = docs.select(text_key(F.col("text")).alias("_key"), F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(run, "_key bigint, hashes array<bigint>")
    return found.join(wanted, "_key").dropDuplicates(["node"]).select("node", "hashes")


def _with_first(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with x, the hashes of a. The pairs of a node that has many of them, a pivot, are dealt out over SALTS tasks, each with a copy of its set."""
    hot = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_PAIRS).select("a", F.lit(SALTS).alias("_salts")), "pivots")
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_salts", F.lit(1))).alias("_salt"))
    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(hot, "a", "left")
    copies = first.select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1)).alias("_salt"))
    return dealt.join(copies, ["a", "_salt"]).drop("_salt")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) whose sets' Jaccard similarity reaches the bound."""

    def run(batches):
        for b in batches:
            x, y = (b.column(i) for i in (2, 3))
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                p, q = (np.asarray(z[i].values.to_numpy()) for z in (x, y))
                both = np.intersect1d(p, q, assume_unique=True).size
                keep[i] = both >= similarity * (p.size + q.size - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    x = _with_first(pairs, sets)
    both = x.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _bucket(size: Column) -> Column:
    return F.floor(F.log(size + 1e-9) / F.lit(float(np.log(SIZE_STEP)))).cast("int")


def prefixes(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """open_ (node, n, root), distinct -> (node, n, root, h, place, reach): the shingles that can be the first in common.

    Shingles are in order of rarity. If the one at `place` is the first that two sets share, they share
    n - place at most, so the other's size is bounded: that is `reach`, and a shingle whose reach is below
    what the similarity asks of any partner is left out.
    """
    token = open_.join(sets, "node").select("node", F.explode("hashes").alias("h"))
    counts = token.groupBy("h").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    # Shingles of one set alone come first in the order and find nobody: only their number matters.
    ranked = token.join(counts, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("x"))
    ranked = open_.join(ranked, "node").withColumn("alone", F.col("n") - F.size("x"))
    first = ranked.select("node", "n", "root", "alone", F.posexplode("x").alias("at", "t")).select("node", "n", "root", F.col("t.h").alias("h"), (F.col("alone") + F.col("at")).alias("place"))
    reach = F.floor((F.col("n") - F.col("place")) * F.lit((1 + similarity) / similarity) - F.col("n") + 1e-9)
    return first.withColumn("reach", reach).filter(F.col("reach") >= similarity * F.col("n") - 1e-9)


def prefix_pairs(first: DataFrame, similarity: float, one: bool = False) -> DataFrame:
    """prefixes() -> pairs (a, b) of nodes of different roots that may reach the similarity, or one such pair for two roots.

    Besides the shingle the join's key holds both sizes' buckets, each side entering those that its reach allows.
    Roots meet before nodes do, so nodes of one root are never paired.
    """
    below = F.sequence(_bucket(F.ceil(similarity * F.col("n") - 1e-9)), _bucket(F.least("n", "reach")))
    above = F.sequence(_bucket(F.col("n")), _bucket(F.least(F.floor(F.col("n") / similarity + 1e-9), F.col("reach"))))
    large = first.select("node", "n", "root", "h", "place", _bucket(F.col("n")).alias("gn"), F.explode(below).alias("gm"))
    small = first.filter(F.col("reach") >= F.col("n")).select(F.col("node").alias("with"), F.col("n").alias("m"), F.col("root").alias("other"), "h", F.col("place").alias("spot"), _bucket(F.col("n")).alias("gm"), F.explode(above).alias("gn"))
    key = ["h", "gn", "gm"]
    if one:
        # A root's node of the most room at a key stands for it there.
        large = large.groupBy(*key, "root").agg(F.max_by(F.struct("node", "n", "place"), F.struct(F.col("n") - F.col("place"), "node")).alias("x")).select(*key, "root", "x.*")
        small = small.groupBy(*key, "other").agg(F.max_by(F.struct("with", "m", "spot"), F.struct(F.col("m") - F.col("spot"), "with")).alias("x")).select(*key, "other", "x.*")
        pairs = large.join(small, key).filter("root <> other")
    else:
        meet = large.select(*key, "root").distinct().join(small.select(*key, "other").distinct(), key).filter("root <> other")
        pairs = large.join(meet, [*key, "root"]).join(small, [*key, "other"])
    common = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("spot"))
    fits = (common >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-9) & (F.col("m") >= similarity * F.col("n") - 1e-9) & (F.col("m") <= F.col("n"))
    pairs = pairs.filter(fits).select(F.least("root", "other").alias("r"), F.greatest("root", "other").alias("s"), F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b"))
    if one:
        shared = pairs.groupBy("r", "s", "a", "b").agg(F.count(F.lit(1)).alias("k"))
        return shared.groupBy("r", "s").agg(F.max_by(F.struct("a", "b"), F.struct("k", "a", "b")).alias("x")).select("x.*").distinct()
    return pairs.select("a", "b").distinct()


def trie_groups(one: DataFrame) -> DataFrame:
    """one (node, n, fp), distinct -> (node, n, band): band is the component that the trie self-join gives the node's fingerprint. The empty set has none."""
    some = one.filter("n > 0").select("node", "n", "fp")
    roots = components(simhash.links(some.select("fp").distinct()))
    named = some.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return named.select("node", "n", F.coalesce("root", "fp").alias("band"))


def links(docs: DataFrame, found: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """found: classes() of docs -> (node, root), components of the pairs that share a trie's component or a band and reach the similarity; nodes without a link are left out."""
    one = materialize(found.groupBy("node").agg(F.min_by(F.struct("_key", "n", "fp", "bands"), "_key").alias("x")).select("node", "x.*"), "sets")
    spread = one.select("node", "n", F.explode("bands").alias("band")).unionByName(trie_groups(one))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("band")
    groups = materialize(spread.join(shared, "band").select("band", "node", "n"), "groups")
    wanted = one.join(groups.select("node").distinct(), "node", "left_semi").select("_key", "node")
    sets = materialize(sets_of(docs, materialize(wanted, "wanted"), shingle), "hashes")
    # A pair of too different sizes can't reach the similarity.
    sized = F.least("n", "m") >= similarity * F.greatest("n", "m")
    state, edges = groups.withColumn("root", F.col("node")), None
    for turn in (F.min, F.max, "one", "all"):
        open_ = state.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
        left = state.join(open_, "band")
        if turn in ("one", "all"):
            nodes = materialize(left.select("node", "n", "root").distinct(), "open")
            pairs = prefix_pairs(materialize(prefixes(nodes, sets, similarity), "prefixes"), similarity, turn == "one")
        else:
            pivot = left.groupBy("band").agg(turn(F.struct("node", "n", "root")).alias("p")).select("band", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.root").alias("with"))
            pairs = left.join(pivot, "band").filter((F.col("root") != F.col("with")) & sized)
            pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        new = materialize(verified(materialize(pairs, "pairs"), sets, similarity), "verified")
        if edges is not None and new.isEmpty():
            continue
        edges = new if edges is None else edges.unionAll(new)
        roots = components(edges)
        state = materialize(groups.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root")), "state")
    return roots


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, _key, root): root names the component of near copies."""
    found = materialize(classes(docs.select("doc_id", "text"), shingle), "classes")
    roots = links(docs, found, shingle, similarity)
    return found.select("doc_id", "_key", "node").join(roots, "node", "left").select("doc_id", "_key", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component: that with the smallest id (null last); of rows that repeat it, one."""
    found = near_copies(docs, shingle, similarity)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("_id"), F.col("x._key").alias("_k"))
    name = free_name(docs, "_copies_key")
    keyed = docs.withColumn(name, text_key(F.col("text")))
    kept = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep["_id"]) & (keyed[name] == keep["_k"]), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).drop(name)
