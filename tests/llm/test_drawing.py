"""Importance resampling, prefix-hash fingerprints and hard negatives against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import hard_negatives, prefix_hash, queries, resampling
from helixframe.llm.common import table
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(ASCII))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_draw(docs, target, least=20, percent=5):
    source, wanted = Counter(), Counter()
    read = [(i, *features(t)) for i, t in docs]
    for _, _, f in read:
        source.update(f)
    for t in target:
        wanted.update(features(t)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))
    rows = []
    for i, n, f in read:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranks = Counter((r[0], *r[2:], k + 1) for k, r in enumerate(drawn))
    left = Counter((r[0], *r[2:]) for r in rows) - Counter((r[0], *r[2:]) for r in drawn)
    return ranks + Counter({(*r, None): n for r, n in left.items()})


def test_draw_of_a_whole_table(spark):
    d, b = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    want = brute_draw([(r.doc_id, r.text) for r in d.collect()], [r.text for r in b.collect()])
    got = queries.op11_resampling(spark, DATA).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r["rank"] is not None for r in got) > 5


def test_draw_of_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["Alpha", "beta", "γάμμα", "x1"]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [(7, rows[7][1])] * 3 + [(None, "word " * 30), (200, None), (201, ""), (202, " -- "), (203, "a" * 50000), (204, "Long, text; " * 30000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("own")).withColumn("score", F.lit(1)).repartition(5)
    t = spark.createDataFrame([(1, "alpha beta"), (2, None)], "item_id long, text string")
    for least, percent in ((20, 5), (20, 50), (1, 100)):
        got = resampling.resampling_report(d, t, least_words=least, percent=percent).collect()
        assert Counter(map(tuple, got)) == brute_draw(rows, ["alpha beta", None], least, percent)
    kept = resampling.resample(d, t, percent=50)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {x["doc_id"] for x in resampling.resampling_report(d, t, percent=50).collect() if x["rank"]}


def test_draw_of_empty_tables(spark):
    d = spark.createDataFrame([(i, "one two three") for i in range(40)], "doc_id long, text string")
    assert resampling.resampling_report(d.limit(0), d.select("text")).collect() == []
    assert {r["rank"] for r in resampling.resampling_report(d, d.select("text").limit(0)).collect()} == {None}
    assert resampling.resampling_report(d, d.select("text").limit(0), least_words=1).filter("rank > 0").count() == 2


def test_features_of_pieces():
    text = ("Ab, c1 déjà-vu " * 50).encode()
    whole = sorted(features(text.decode())[1])
    for piece in (1, 7, 100, 10**6):
        got = list(resampling.feature_buckets(text, piece=piece))
        assert sorted(np.concatenate([f for _, f in got]).tolist()) == whole and sum(n for n, _ in got) == 200


def naive_extension(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_extensions():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(30)] + ["", "é漢😀" * 5]
    held = prefix_hash.Prefixes([prefix_hash.points_of(t) for t in texts], prefix_hash.Powers())
    for _ in range(400):
        x, y = r.randrange(len(texts)), r.randrange(len(texts))
        i, j = r.randint(0, len(texts[x])), r.randint(0, len(texts[y]))
        at = lambda t, k: np.array([held.start[t] + k])
        ahead, behind = min(len(texts[x]) - i, len(texts[y]) - j), min(i, j)
        assert held.forwards(at(x, i), at(y, j), np.array([ahead]))[0] == naive_extension(texts[x][i:], texts[y][j:])
        assert held.backwards(at(x, i), at(y, j), np.array([behind]))[0] == naive_extension(texts[x][:i][::-1], texts[y][:j][::-1])
        n = r.randint(0, ahead)
        assert held.equal(at(x, i), at(y, j), np.array([n]))[0] == (texts[x][i : i + n] == texts[y][j : j + n])


def test_likeness():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    t, u = say(400), say(300)
    assert prefix_hash.likeness(t, t) == 1 and prefix_hash.likeness("", "") == 1 and prefix_hash.likeness("", "x") == 0
    assert prefix_hash.likeness(t, u) < 0.05
    assert prefix_hash.likeness(t, t[:700] + "zz" + t[705:1500] + t[1540:]) > 0.9
    assert 0.9 < prefix_hash.likeness(t + u, u + t) < 1
    assert prefix_hash.likeness("aaa", "aaaaa") == 0.75 and prefix_hash.likeness("a" * 500, "a" * 499) < 1
    assert prefix_hash.likeness(t, u) == pytest.approx(prefix_hash.likeness(u, t), abs=0.02)


def neighbours(rows):
    """(id, text, edited text, neighbour's text) in order of id and text, null ids first."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    texts = [t or "" for _, t in order]
    out = []
    for (i, _), t, n in zip(order, texts, texts[1:] + texts[:1]):
        cut = len(t) // 4
        out.append((i, t, t[: len(t) - cut] + n[:cut], n))
    return out


def expected(rows):
    out = []
    for i, t, e, n in neighbours(rows):
        f, g = prefix_hash.fingerprints([t, e])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, prefix_hash.likeness(t, e), prefix_hash.likeness(t, n)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes, buffer", [(prefix_hash.BLOCK_BYTES, prefix_hash.BUFFER), (40_000, 5_000)])
def test_fingerprints_of_a_whole_table(spark, block_bytes, buffer):
    d = table(spark, DATA, "documents")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    got = prefix_hash.fingerprint_report(d.repartition(3), block_bytes, buffer).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    print_of = {}
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        assert print_of.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_edited >= 0.7 and 0 <= r.near_next <= 1
    assert len(set(print_of.values())) == len(print_of)


def test_fingerprints_of_odd_rows(spark):
    r = random.Random(3)
    rows = [(i * 7 % 101 - 20, " ".join(r.choice(["eins", "zwei", "drei", "漢字", "😀"]) for _ in range(r.randint(0, 40)))) for i in range(101)]
    rows += [(5, "same id"), (5, "same id"), (5, None), (None, "no id"), (None, None), (300, ""), (301, "abc"), (302, "abcd" * 9000), (303, "abcd" * 9000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("own")).withColumn("block", F.lit(0)).repartition(4)
    for block_bytes in (10**7, 1500):
        assert sorted(map(tuple, prefix_hash.fingerprint_report(d, block_bytes, 700).collect()), key=repr) == expected(rows)
    large = [((1 << 60) + k, f"{k} " * 40) for k in range(60)] + [(None, "no id"), (0, "zero")]
    assert sorted(map(tuple, prefix_hash.fingerprint_report(spark.createDataFrame(large, "doc_id long, text string").repartition(3), 1500).collect()), key=repr) == expected(large)
    one = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    assert [tuple(x) for x in prefix_hash.fingerprint_report(one).collect()] == expected([(3, "abcdefgh")])
    assert prefix_hash.fingerprint_report(one.limit(0)).collect() == []


def brute_negatives(rows, every=100):
    e = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v], k))
    out = []
    for a in (x for x in e if x[0] % every == 0):
        scored = sorted(((sum(x * y for x, y in zip(a[2], b[2])), b) for b in e if b[3] != a[3]), key=lambda s: (-s[0], s[1][0]))
        for p, b in [s for s in scored if s[1][1] == a[1]][:5]:
            ok = [(s, n) for s, n in scored if n[1] != a[1] and 30 * p <= 100 * s <= 90 * p]
            out += [(a[0], b[0], k + 1, n[0], p, s) for k, (s, n) in enumerate(ok[:10])]
    return sorted(out)


def test_negatives(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, 0.3, 0.9, 1.0]) for _ in range(6)], r.randrange(4)) for i in range(600)]
    rows += [(700, None, 1), (701, [0.5, None], 1), (702, [float("nan")] * 6, 1), (703, [float("inf")] * 6, 1), (704, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    rows += [(705, [1.0, 1.0], 2), (706, [], 2), (800, [-0.25] * 6, 1), (900, [0.0] * 6, 3), (1000, [1.0] * 9, 9), (707, [0.7] * 6, 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("mark", F.lit("own")).withColumn("q", F.lit(1))
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], x) for i, v, x in rows]
    want = brute_negatives(as_float)
    assert len(want) > 100
    for a, b in ((1024, 8192), (2, 37)):
        assert sorted(map(tuple, hard_negatives.negatives_report(e, anchor_block=a, row_block=b).collect())) == want
    assert hard_negatives.negatives_report(e.limit(0)).collect() == []


def test_negatives_of_repeated_rows(spark):
    rows = [(100, [1.0, 0.5], 1)] * 3 + [(1, [1.0, 0.25], 1)] * 4 + [(2, [0.5, 0.5], 2)] * 5 + [(3, [0.25, 0.5], 2)]
    got = hard_negatives.negatives_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), row_block=3).collect()
    # Each of three anchors has the other two and three of the four rows 1 as positives; six rows 2 and 3 follow each of these 15.
    assert len(got) == 90 and Counter(r.negative_id for r in got) == {2: 75, 3: 15}
    assert Counter(r.positive_id for r in got) == {100: 36, 1: 54}


def test_products_are_exact():
    a = np.array([[2**30, 3], [-(2**30), 1]])
    assert (hard_negatives.products(a, a) == a @ a.T).all()
    with pytest.raises(ArithmeticError):
        hard_negatives.products(a * 4, a * 4)
