"""The pipeline's rows on a whole small table against brute force of each stage's decisions."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from helixframe.llm import toxicity

from . import test_native, test_near_copies

DATA = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    toxic = {r.doc_id for r in toxicity.toxicity_report(docs, labels).collect() if r.predicted}
    kept = [(i, r.text) for i, r in sorted(rows.items()) if i not in toxic]
    one = set(test_near_copies.brute(kept))
    kept = [(i, t) for i, t in kept if i in one]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    hit = {i for (i, *_, bad) in test_native.brute(kept, items) if bad}
    kept = [(i, t) for i, t in kept if i not in hit]
    size, source = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in kept}, {i: rows[i].source for i, _ in kept}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    order = sorted(totals, key=lambda s: (s is None, s))
    targets = test_native.water_fill(totals, {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)})
    want = Counter()
    for i in size:
        rate = targets[source[i]] / totals[source[i]] if totals[source[i]] else 0.0
        u = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i] += math.floor(rate) + (u < rate - math.floor(rate))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r.doc_id for r in got) == +want and len(toxic) > 0 and len(hit) > 0
    assert all((r.text, r.source, r.lang) == (rows[r.doc_id].text, rows[r.doc_id].source, rows[r.doc_id].lang) and r.shard == test_native.place(r.doc_id, 16) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
