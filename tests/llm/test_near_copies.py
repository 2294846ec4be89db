import random

from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import near_copies, simhash


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) <= n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows):
    """Rows kept: the smallest id of each component of pairs at Jaccard 0.8 or more."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted(least.values())


def planted(seed, groups=12):
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    for _ in range(groups):
        base = [word() for _ in range(r.choice((60, 200, 400)))]
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3, 6, 20))):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate([*rows, "", "   ", None, "one two", "One  two", "one two three"])]


def test_stage_drops_what_brute_force_drops(spark):
    for seed in (1, 2):
        rows = planted(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(x.doc_id for x in corpus_pipeline.deduplicate(spark, docs, "").collect())
        assert got == brute(rows)
        assert len(got) < simhash.drop_near_duplicates(docs).count()


def test_stage_on_a_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(x.doc_id for x in near_copies.drop_near_copies(docs).collect())
    assert got == brute([tuple(x) for x in docs.collect()])


def test_texts_that_share_a_part(spark):
    """300 texts with a common part below the similarity, and a cluster of 40 near copies within them: no pair for each two of them."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    part = [word() for _ in range(90)]
    rows = [" ".join([*part, *(word() for _ in range(30))]) for _ in range(300)]
    base = [*part, *(word() for _ in range(30))]
    for _ in range(40):
        copy = list(base)
        copy[r.randrange(95, 120)] = word()
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in near_copies.drop_near_copies(docs).collect()) == brute(rows)
    found = near_copies.classes(docs)
    sets = near_copies.sets_of(docs, found.select("_key", "node"))
    open_ = found.selectExpr("node", "n", "node as root")
    pairs = near_copies.prefix_pairs(near_copies.prefixes(open_, sets, 0.8), 0.8)
    assert 40 * 39 // 2 <= pairs.count() < 2000  # of 57,630 pairs


def test_a_large_cluster(spark):
    """10,000 near copies of one text of 200 words stay one; its pairs with the pivot are dealt out over tasks."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(10_000):
        copy = list(base)
        copy[r.randrange(200)] = f"x{k}"
        texts.append((k, " ".join(copy)))
    alone = [(10_000 + k, " ".join(f"y{k}-{i}" for i in range(30))) for k in range(20)]
    docs = spark.createDataFrame(texts + alone, "doc_id long, text string").repartition(8)
    assert sorted(x.doc_id for x in near_copies.drop_near_copies(docs).collect()) == [0, *range(10_000, 10_020)]


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "a b c", "x", "y")], "doc_id long, text string, _copies_key string, _SIMHASH_KEY string")
    for drop in (near_copies.drop_near_copies, simhash.drop_near_duplicates):
        assert [tuple(x) for x in drop(docs).collect()] == [(1, "a b c", "x", "y")]


def linked(docs, found):
    """Classes of ids that links() makes of the rows of found."""
    roots = near_copies.links(docs, found)
    out = {}
    for x in found.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")).collect():
        out.setdefault(x.root, set()).add(x.doc_id)
    return sorted(map(sorted, out.values()))


def test_trie_join_links_without_bands(spark):
    """Near copies within the trie's budget are one class without any band; what is linked there also reaches the similarity."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for k in range(30):
        base = [word() for _ in range(600)]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join([*base, word()])), (3 * k + 2, " ".join([word() for _ in range(600)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.classes(docs).localCheckpoint()
    bits = {x.doc_id: x.fp for x in found.collect()}
    assert all(bits[i] == (f - 2**64 if f >= 2**63 else f) for i, t in rows for f in [simhash.fingerprint(t.encode(), 5)])
    near = {3 * k for k in range(30) if ((bits[3 * k] ^ bits[3 * k + 1]) & (2**64 - 1)).bit_count() <= simhash.BUDGET}
    got = linked(docs, found.withColumn("bands", F.array().cast("array<bigint>")))
    assert near and got == sorted([[i, i + 1] for i in near] + [[i] for i in range(90) if i not in near and i - 1 not in near])


def test_trie_component_below_the_similarity_stays_apart(spark):
    """Texts in one component of fingerprints are held against each other exactly."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join([*base, *(f"y{i}" for i in range(30))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.classes(docs).withColumn("fp", F.lit(7).cast("long")).withColumn("bands", F.array().cast("array<bigint>")).localCheckpoint()
    assert linked(docs, found) == [[0, 1], [2]]
