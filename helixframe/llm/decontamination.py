"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` words (an item of fewer
is one window). A document contains a window only if it contains all shingles
of it, so one of them is a sufficient prefix. A first pass over the documents
counts the benchmark's shingles, which orders them by rarity; each window's rarest
one becomes its prefix, and a window whose prefix occurs nowhere is dropped. A
second pass joins the documents' positions with the prefixes alone, drops those
where the window would begin before the document or end behind it, and compares
the rest word by word. The documents' words are written once for both passes.

Shingles are broadcast up to ``BROADCAST_ROWS``; beyond, both passes join them by
shuffle, and a bitmap of the shingles (``MAP_BITS`` bits each, one row of at most
2**``MOST_BITS`` bits) keeps almost all other positions out of it. A fuller bitmap keeps out fewer, which costs shuffle, not results.

Nulls: a null or empty text has no words and no hits. Rows that repeat an id
are told apart by their text; identical rows get identical results. Benchmark
rows with a null item_id mark words as hit but are not listed as items. Empty
tables: without documents an empty result, without items no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower, materialize, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
MAP_BITS, MOST_BITS = 16, 29


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, win, wlen, wtext): distinct windows of each item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_w")).withColumn("_n", F.size("_w")).filter("_n > 0")
    items = items.withColumn("wlen", F.least(F.lit(window), F.col("_n")))
    cut = items.select("item_id", "wlen", "_w", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("wlen"))).alias("_s"))
    cut = cut.select("item_id", "wlen", F.slice("_w", F.col("_s") + 1, F.col("wlen")).alias("win"))
    return cut.withColumn("wtext", F.array_join("win", " ")).dropDuplicates(["item_id", "wtext"])


def doc_words(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, n_words, words), written once."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_key"), words(F.col("text")).alias("words"))
    return materialize(rows.select("doc_id", "_key", F.size("words").cast("long").alias("n_words"), "words"), "bench-words")


def _shingle(words: str, start: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), F.slice(words, start, F.lit(k)))


def _positions(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """texts' rows at every position pos with the hash h of the shingle that starts there, for each size."""
    at = texts.select("doc_id", "_key", "n_words", "words", F.posexplode("words").alias("pos", "_word"))
    hashes = [_shingle("words", F.col("pos") + 1, k) for k in sizes]
    return at.select("doc_id", "_key", "n_words", "words", "pos", (hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes))).alias("h"))


def _bitmap(shingles: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(one row: bits, an array of 64-bit words in which each shingle's bit is set; the number of bits' logarithm). shingles: n rows of h."""
    bits = min(MOST_BITS, max(10, (MAP_BITS * n).bit_length()))
    place = F.shiftright(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), 6)
    held = shingles.groupBy(place.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    every = shingles.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "w").join(held, "w", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("bits")), bits


def _may_hold(rows: DataFrame, shingles: DataFrame, n: int) -> DataFrame:
    """rows without most of those whose h is no shingle; the bitmap is a scalar that each task has."""
    bitmap, bits = _bitmap(shingles, n)
    word = F.element_at(materialize(bitmap, "bench-bitmap").scalar(), F.shiftright(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int") + 1)
    return rows.filter(F.getbit(word, F.col("h").bitwiseAND(63).cast("int")) == 1)


def find_windows(texts: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(hits: doc_id, _key, start, wlen, wtext; windows: item_id, wtext). texts: doc_words()."""
    windows = materialize(item_windows(benchmark, window), "bench-windows")
    one = windows.dropDuplicates(["wtext"]).select("win", "wlen", "wtext", F.least(F.lit(shingle), F.col("wlen")).alias("k"))
    cut = one.select("*", F.explode(F.sequence(F.lit(0), F.col("wlen") - F.col("k"))).alias("offset"))
    hashed = F.element_at(F.array(*[_shingle("win", F.col("offset") + 1, k) for k in range(1, shingle + 1)]), F.col("k"))
    cut = materialize(cut.withColumn("h", hashed), "bench-shingles")
    sizes = sorted(r["k"] for r in cut.select("k").distinct().collect())  # at most `shingle` rows
    distinct = cut.select("h").distinct()
    if not sizes:
        none = texts.select("doc_id", "_key", F.lit(0).alias("start"), F.lit(0).alias("wlen"), F.lit("").alias("wtext")).filter(F.lit(False))
        return none, windows.select("item_id", "wtext")
    n_distinct = distinct.count()
    small = n_distinct <= most
    every = _positions(texts, sizes).select("h")
    counts = (every.join(F.broadcast(distinct), "h").groupBy("h") if small else _may_hold(every, distinct, n_distinct).groupBy("h")).agg(F.count(F.lit(1)).alias("n_found"))
    first = cut.join(counts if small else counts.join(distinct, "h"), "h", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    first = first.groupBy("wtext").agg(F.min_by(F.struct("win", "wlen", "offset", "h", "n_found"), F.struct("n_found", "offset")).alias("p")).select("wtext", "p.*").filter("n_found > 0").drop("n_found")
    first = materialize(first, "bench-prefixes")
    prefixes = first.select("h").distinct()
    begin = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    near = [begin.alias("from"), F.slice("words", begin + 1, F.lit(2 * window - 1)).alias("near")]
    n_prefixes, at = prefixes.count(), _positions(texts, sizes)
    found = at.join(F.broadcast(prefixes), "h") if n_prefixes <= most else _may_hold(at, prefixes, n_prefixes)
    found = found.select("doc_id", "_key", "n_words", "pos", "h", *near)
    found = found if n_prefixes <= most else found.join(prefixes, "h")
    start = F.col("pos") - F.col("offset")
    pairs = found.join(first, "h").filter((start >= 0) & (start + F.col("wlen") <= F.col("n_words")))
    hits = pairs.filter(F.slice("near", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.col("wlen")) == F.col("win")).select("doc_id", "_key", start.alias("start"), "wlen", "wtext")
    return hits, windows.select("item_id", "wtext")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the list of items."""
    texts = doc_words(docs)
    hits, windows = find_windows(texts, benchmark.select("item_id", "text"), window, shingle)
    hits = materialize(hits.dropDuplicates(), "bench-hits")
    key = ["doc_id", "_key"]
    spans = hits.groupBy(*key, "start").agg(F.max("wlen").alias("wlen"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("wlen")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    n_hit = spans.withColumn("_new", new).groupBy(*key).agg(F.sum("_new").alias("n_hit"))
    items = hits.join(windows, "wtext").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    per = n_hit.join(items, [n_hit["doc_id"].eqNullSafe(items["doc_id"]), n_hit["_key"] == items["_key"]], "left").select(n_hit["doc_id"].alias("_id"), n_hit["_key"].alias("_k"), "n_hit", "items")
    base = texts.select("doc_id", "_key", "n_words")
    out = base.join(per, base["doc_id"].eqNullSafe(per["_id"]) & (base["_key"] == per["_k"]), "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """docs without those that hold a benchmark window."""
    hits, _ = find_windows(doc_words(docs), benchmark.select("item_id", "text"), window, shingle)
    hit = hits.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]) & (text_key(docs["text"]) == hit["_k"]), "left_anti")
