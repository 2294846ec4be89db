"""Mixing, decontamination and sharding against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import decontamination, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def water_fill(sizes, weights):
    left, out, budget = dict(sizes), {}, float(sum(sizes.values()))
    while True:
        level = budget / sum(weights[s] for s in left) if left else 0
        over = [s for s in left if level * weights[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weights[s] for s in left}
        for s in over:
            out[s] = 3.0 * sizes[s]
            budget -= out[s]
            del left[s]


def test_targets(spark):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 3, "e": 900, "z": 0}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())] + [(99, "one two", None), (100, None, "a")]
    got = {r.source: r.target for r in mixing.mixing_report(docs(spark, rows)).collect()}
    order = [*sorted(sizes), None]
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    want = water_fill(sizes | {None: 2}, weights)
    assert got == {s: pytest.approx(t) for s, t in want.items()}


def test_mix_emits_copies(spark):
    rows = [(i % 90, f"word {i} " * (i % 7), f"s{i % 3}") for i in range(300)]
    d = docs(spark, rows).withColumn("size", F.lit("own")).withColumn("copies", F.lit("own"))
    plan = {(r.doc_id, r.size, r.source): r.copies for r in mixing.mixing_report(d).collect()}
    mixed = mixing.mix_sources(d)
    assert mixed.columns == d.columns
    n = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for i, t, s in rows:
        want[i] += plan[i, len(t.split()), s]
    assert n == +want and all(c <= 3 for c in plan.values())
    assert Counter(r.doc_id for r in mixing.mix_sources(d.repartition(7)).collect()) == n
    assert mixing.mix_sources(d.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1) if w else ():
            wins[tuple(w[s : s + k])].add(i)
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for s in range(len(w)):
            for k in range(1, 11):
                if tuple(w[s : s + k]) in wins and s + k <= len(w):
                    hit |= set(range(s, s + k))
                    found |= wins[tuple(w[s : s + k])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination(spark):
    long = " ".join(f"w{i}" for i in range(25))
    items = [(1, long), (2, "Two words"), (10, long.upper()), (3, None), (4, "..."), (5, "é à ü"), (6, "same same same same same same same same same same same"), (None, "null item")]
    rows = [
        (1, long), (2, "x " + " ".join(long.split()[3:13]) + " y"), (3, " ".join(long.split()[3:12])), (4, "TWO-words two"), (5, None), (6, ""), (7, "É à ü"), (8, "é à ü"), (9, "same " * 15), (9, "another text"), (9, "same " * 15),
        (None, "two words"), (11, "filler " * 3000 + long), (12, "a null item"), (13, "w0 w1 w2"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("start", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r)[:6] for r in decontamination.contamination(d, b).collect())
    assert got == brute(rows, items)
    keep = decontamination.drop_contaminated(d, b)
    assert keep.columns == d.columns
    clean = Counter(t for (i, t), r in zip(rows, [next(iter(brute([r], items))) for r in rows]) if not r[5])
    assert Counter(r.text for r in keep.collect()) == clean
    assert decontamination.contamination(d.limit(0), b).count() == 0
    assert decontamination.contamination(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontamination.drop_contaminated(d, b.limit(0)).count() == len(rows)


@pytest.mark.parametrize("most", [0, 10])
def test_benchmark_beyond_broadcast(spark, most):
    items = [(i, " ".join(f"t{i}x{k}" for k in range(12))) for i in range(6)]
    rows = [(i, "a b " + t + " c") for i, t in items]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    texts = decontamination.doc_words(d)
    one, _ = decontamination.find_windows(texts, b)
    many, _ = decontamination.find_windows(texts, b, most=most)
    key = lambda x: sorted((r.doc_id, r.start, r.wtext) for r in x.collect())
    assert key(one) == key(many) and len(key(one)) == 18


def test_bitmap_keeps_positions_out(spark):
    """Of a corpus' shingles those of the benchmark stay, and few others."""
    h = spark.range(40_000).select(F.xxhash64("id").alias("h"))
    wanted = spark.range(500).select(F.xxhash64("id").alias("h"))
    left = decontamination._may_hold(h, wanted, 500)
    assert left.join(wanted, "h").count() == 500 and left.count() < 500 + 40_000 // 8
    assert decontamination._may_hold(h, wanted.limit(0), 0).count() == 0


def test_sharding(spark):
    rows = [(i, "é" * (i % 5) if i % 11 else None, "s") for i in range(500)] + [(7, "again", "s")] * 3 + [(None, "no id", "s")]
    d = docs(spark, rows).withColumn("shard", F.lit("own")).withColumn("bucket", F.lit("own"))
    got = sharding.shard_rows(d, d.columns, bucket_bytes=64).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        text = (r.text or "").encode()
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text) and r.law == "key"
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.bucket == "own"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(x) == 1 for x in by_id.values())
    again = {(r.doc_id, r.text, r.slot) for r in sharding.shard_rows(d, d.columns, bucket_bytes=64).collect()}
    assert again == {(r.doc_id, r.text, r.slot) for r in got}
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.shard == 3 and r.doc_id is not None]
    assert order != sorted(order)
    assert sharding.shard_rows(d.limit(0), d.columns).count() == 0


def place(key, shards):
    """The shard with the largest hash of id and shard number: XXH64 by Spark's rule, column by column."""
    seed = 42
    marks = []
    for j in range(shards):
        h = xxhash.xxh64_intdigest((29).to_bytes(4, "little"), seed)
        h = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), h)
        h = h if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
        marks.append(h - (1 << 64) if h >> 63 else h)
    return marks.index(max(marks))


def test_written_shards(spark, tmp_path):
    """The report comes from the written files; every row is there once, in its shard, as it was."""
    rows = [(i, f"text {i} " * (i % 9), "s" + str(i % 2)) for i in range(300)] + [(5, None, "s"), (None, "no id", None), (5, None, "s"), (6, "long " * 50_000, "s")]
    d = docs(spark, rows).withColumn("slot", F.lit("own"))
    path = str(tmp_path / "shards")
    got = sharding.sharding_report(d, path, bucket_bytes=4096).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert all((r.shard, r.grown_shard) == (place(r.doc_id, 16), place(r.doc_id, 17)) for r in got)
    back = spark.read.parquet(path)
    assert {r.input_file_name.split("shard=")[1].split("/")[0] for r in back.select(F.input_file_name().alias("input_file_name")).distinct().collect()} == {str(r.shard) for r in got}
    whole = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in back.collect())
    assert whole == Counter((i, t, "en", s, 0) for i, t, s in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharding_report(d.limit(0), str(tmp_path / "none")).count() == 0


def test_native_plans(spark):
    d = docs(spark, [(1, "a b c d e f g h i j", "s")])
    b = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    beyond, _ = decontamination.find_windows(decontamination.doc_words(d), b, most=0)
    for df in (mixing.mixing_report(d), decontamination.contamination(d, b), beyond, sharding.shard_rows(d, ["doc_id"])):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_shard_files_are_in_slot_order(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    d = docs(spark, [(i, f"text {i} " * (i % 50), "s") for i in range(3000)]).repartition(7)
    sharding.write_shards(d, str(tmp_path / "out"), n_shards=3, bucket_bytes=20_000)
    files = glob.glob(str(tmp_path / "out/shard=*/*.parquet"))
    slots = [pq.ParquetFile(f).read(columns=["slot"]).column(0).to_pylist() for f in files]
    assert len(files) >= 3 and all(s == sorted(s) for s in slots) and sum(map(len, slots)) == 3000
