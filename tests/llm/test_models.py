"""Toxicity, quality and SimHash: held-out accuracy and brute force."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import quality, queries, simhash, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")]


def test_gram_buckets():
    a, b = toxicity.gram_buckets("You FOOL!"), toxicity.gram_buckets("you,fool")
    assert a.tolist() == b.tolist() and toxicity.gram_buckets("").size == 0
    assert toxicity.gram_buckets("x").size == 0 and toxicity.gram_buckets("xy").size == 1
    assert toxicity.gram_buckets("éß").size == 1 and toxicity.gram_buckets("\U0001f600é").size == 1


def test_toxicity_learns():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    make = lambda bad: " ".join([word() for _ in range(60)] + ["zorkish"] * bad)
    y = np.array([i % 4 == 0 for i in range(400)], float)
    texts = [make(int(b)) for b in y]
    m = toxicity.fit(texts[:300], y[:300])
    w = m.dense()
    p = np.array([1 / (1 + np.exp(-(m.bias + w[toxicity.held(t, w != 0)].sum()))) for t in texts[300:]])
    assert ((p >= 0.7) == y[300:]).mean() > 0.98
    assert toxicity.fit(texts[:2], np.zeros(2)).buckets.size == 0


def test_balanced_cut():
    z, y = np.array([3.0, 2.5, 2.0, 1.0, 0.0, -1.0]), np.array([1, 1, 0, 1, 0, 0])
    assert toxicity.balanced_cut(z, y) == 0.5  # three of four right, all found
    assert toxicity.balanced_cut(np.array([5.0, 4.0, 0.0, -1.0]), np.array([1, 1, 0, 0])) == 2.0
    assert toxicity.balanced_cut(np.ones(4), np.array([1, 0, 0, 1])) == 1.0


def test_toxicity_held_out(spark):
    """Of all held-out rows of the largest table at least nine in ten toxic ones are found, and nine in ten found ones are toxic."""
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    d = spark.read.parquet(f"{big}/documents.parquet").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    got = toxicity.toxicity_report(d, labels).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").toPandas()
    assert len(got) > 1_000
    assert got.toxic[got.predicted == 1].mean() >= 0.9 and got.predicted[got.toxic == 1].mean() >= 0.9


def test_toxicity_report(spark, tables):
    d, labels = tables
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "x " * 60_000), (None, "no id")], "doc_id long, text string")
    both = d.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("clash"))
    got = toxicity.toxicity_report(both, labels).toPandas()
    assert len(got) == 1004 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out & got.doc_id.notna()]
    assert all(zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in held.doc_id)
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert m.toxic[m.predicted == 1].mean() > 0.9 and m.predicted[m.toxic == 1].mean() > 0.6  # 674 rows to learn from
    twice = toxicity.toxicity_report(d.unionAll(d), labels)
    assert twice.count() == 2 * d.count() and twice.groupBy("doc_id").agg(F.count_distinct("score").alias("n")).filter("n > 1").count() == 0
    assert toxicity.toxicity_report(d, labels.filter("toxic = 0")).filter("predicted = 1").count() == 0
    kept = toxicity.drop_toxic(d, labels)
    clash = toxicity.drop_toxic(d.withColumn("_toxic_score", F.lit("mine")), labels)
    assert clash.columns == [*d.columns, "_toxic_score"] and clash.filter("_toxic_score = 'mine'").count() == kept.count()
    assert kept.columns == d.columns and 0.8 < kept.count() / d.count() < 0.98
    assert toxicity.toxicity_report(d.limit(0), labels).count() == 0
    assert toxicity.toxicity_report(d, labels.limit(0)).filter("predicted = 1").count() == 0


def test_quality_report(spark, tables):
    d, labels = tables
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "x " * 60_000), (None, "no id")], "doc_id long, text string")
    got = quality.quality_report(d.select("doc_id", "text").unionByName(odd), labels).toPandas()
    assert len(got) == 1004 and got.score.between(0, 1).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    held = m[m.held_out]
    assert held.quality[held.predicted == 1].mean() > 0.95 and held.predicted[held.quality == 1].mean() > 0.95
    one_kind = labels.filter("quality = 1")
    assert quality.quality_report(d, one_kind).select("score").distinct().first().score == 1
    assert quality.quality_report(d.limit(0), labels).count() == 0
    assert quality.quality_report(d, labels.limit(0)).select("score").distinct().count() == 1


def test_normal_equations_many_partitions(spark, tables):
    """The sums that reach the driver don't depend on the partitions, and equal those of all rows at once."""
    d, labels = tables
    few = quality.train(d, labels)
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        many = quality.train(d.repartition(211), labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(few.weights, many.weights, atol=1e-6) and few.weights.size == quality.FEATURES + 1
    x = quality._statistics_of(quality.training_rows(d, labels, "quality", 4, 2, quality.MAX_ROWS, 43))
    fit = x.filter(F.pmod(F.xxhash64(F.lit(quality.SEED), "doc_id"), F.lit(4)) != 0).toPandas()
    f = quality.fourier((np.stack(fit.x.to_list()) - few.mean) / few.scale)
    a = f.T @ f + quality.RIDGE * len(fit) / f.shape[1] * np.eye(f.shape[1])
    assert np.allclose(np.linalg.solve(a, f.T @ fit.label.to_numpy(float)), few.weights, atol=1e-6)


def test_quality_repeated_ids(spark, tables):
    d, labels = tables
    twice = d.select("doc_id", "text").unionAll(d.select("doc_id", "text"))
    one = {r.doc_id: r.score for r in quality.quality_report(d, labels).collect()}
    got = quality.quality_report(twice, labels).collect()
    assert len(got) == 2 * len(one) and all(abs(one[r.doc_id] - r.score) < 1e-9 for r in got)


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all() and 0 <= y.min() and y.max() <= 1


def test_fourier_approximates_kernel(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 20_000)
    z = np.random.default_rng(0).normal(0, 1, (6, len(quality.NAMES)))
    f = quality.fourier(z)[:, :20_000]
    exact = np.exp(-quality.GAMMA * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    assert np.abs(f @ f.T - exact).max() < 0.05


def fingerprint(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ("", " \n", "one", "one two", "A b C", "a b c d", "é x y z", "same " * 50, "a\x0bb\x0cc d", "É ÀB c"):
        assert simhash.fingerprint(t.encode()) == fingerprint(t)


def parts(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    least = {}
    for x in range(n):
        least.setdefault(find(x), x)
    return [least[find(x)] for x in range(n)]


def near_pairs(v):
    return [(i, j) for i in range(v.size) for j in (np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3) + i + 1).tolist()]


def fingerprints_near(seed, bases, copies):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, bases, dtype=np.uint64)
    flips = [b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for b in base for _ in range(copies)]
    return np.unique(np.r_[base, np.array(flips, np.uint64)])


@pytest.mark.parametrize(("bases", "copies"), [(300, 4), (2, 900)])
def test_trie_finds_every_link(monkeypatch, bases, copies):
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    v = np.unique(np.r_[fingerprints_near(5, bases, copies), np.arange(200, dtype=np.uint64)])
    found = simhash.trie_links(v, shared_bits=0)
    edges = np.concatenate(found.edges, axis=1).T.tolist()
    assert all(int(v[a] ^ v[b]).bit_count() <= 3 for a, b in edges)
    assert parts(v.size, edges) == parts(v.size, near_pairs(v))


def test_large_cluster_is_cheap():
    """10,000 near copies: far fewer steps than their 50 million pairs, all connected; random values die within some levels."""
    rng = np.random.default_rng(8)
    v = np.unique(np.array([sum(1 << int(x) for x in rng.choice(48, 2, False)) for _ in range(5000)] + [sum(1 << int(x) for x in rng.choice(48, 3, False)) for _ in range(20_000)], np.uint64))[:10_000]
    assert v.size == 10_000
    found = simhash.trie_links(v)
    assert len(set(found.root.tolist())) == 1 and found.steps < 300 * v.size
    random_values = np.unique(rng.integers(0, 1 << 48, 10_000, dtype=np.uint64))
    assert 0 < simhash.trie_links(random_values).steps < 2000 * random_values.size


def test_trie_is_walked_on_the_tables(spark):
    """The trie's traversal, not a comparison of all pairs of a block, finds the links: its steps are counted."""
    fps = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("fp").distinct().toPandas().fp.to_numpy()
    v = np.unique(fps.view(np.uint64))
    steps = 0
    for k in range(4):
        by = np.uint64(16 * k)
        steps += simhash.trie_links(np.unique((v << by) | (v >> (np.uint64(64) - by))) if k else v).steps
    assert 10_000 < steps < 100 * v.size


@pytest.mark.parametrize("crowd", [50_000, 20, 5])
def test_links_of_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    v = np.unique(np.r_[fingerprints_near(6, 40, 6), fingerprints_near(7, 1, 150)])
    at = {int(x): i for i, x in enumerate(v.view(np.int64))}
    got = simhash.links(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")).collect()
    assert parts(v.size, [(at[r.a], at[r.b]) for r in got]) == parts(v.size, near_pairs(v))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(-5, 300)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        return x if up[x] == x else find(up[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


def test_near_duplicates(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text + " more"), (1, "quite another text of a few words"), (2, None), (4, ""), (None, text), (1, "quite another text of a few words"), (1, "third"), (None, "only null"), (20, "x " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(d).collect()}
    fps = [(i, fingerprint(t)) for i, t in rows]
    for i, f in fps:
        group, todo = {f}, [f]
        while todo:
            x = todo.pop()
            new = {g for _, g in fps if (g ^ x).bit_count() <= 3} - group
            group |= new
            todo += new
        ids = [j for j, g in fps if g in group and j is not None]
        assert got[i, f"{f:016x}"] == (min(ids) if ids else None)
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == sorted([(0, "only "), (1, "quite"), (1, "third"), (2, ""), (3, "word0"), (20, "x x x")])
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "mixing", "sharding"]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = d
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "/root/testdata/sf0.001")
        if name != "sharding":
            assert out.columns == d.columns
            df = spark.createDataFrame(out.collect(), out.schema)
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert whole.count() == df.count() > 100
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), "/root/testdata/sf0.001").count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_toxicity_fit_holds_few_buckets_a_text():
    """The rows of a fit and of its folds hold only what these fits keep, and the fits are those on every bucket of the texts."""
    r = np.random.default_rng(8)
    word = lambda: "".join(chr(c) for c in r.integers(97, 123, 6))
    common, bad = [word() for _ in range(3000)], [word() for _ in range(5)]
    y = (r.random(400) < 0.2).astype(float)
    texts = [" ".join([*r.choice(common, 200), *(r.choice(bad, 2) if k else [])]) for k in y]
    fold = np.arange(400) % 4
    found, every = toxicity.useful_buckets(texts, y, fold), [toxicity.held(t, np.ones(1 << toxicity.BITS, bool)) for t in texts]
    assert sum(x.size for x in found) * 5 < sum(x.size for x in every)
    for rows in (fold >= 0, *(fold != k for k in range(4))):
        a, b = (toxicity.fit_buckets([x for x, k in zip(f, rows) if k], y[rows]) for f in (found, every))
        assert a.bias == b.bias and (a.buckets == b.buckets).all() and (a.weights == b.weights).all() and a.buckets.size
