"""WARC, media, HTML and repeated passages: round trips, hand-made cases and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import html_text, media, suffix, warc

PAGES = "page_id long, url string, html string"


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a", "WARC/1.0\r\n"), (2, "u", None), (3, None, ""), (4, "u\r\nX-Page-ID: 7", "é" * 500), (5, "u", fake), (6, "u", "é" * 500), (7, "u", "end\r\n\r\n"), (8, "u", "z" * 30_000 + "WARC/1.0\r\n" + "y" * 20_000), (9, "u", "é" * 500)]
    d = spark.createDataFrame(rows, PAGES).withColumn("value", F.lit("clash"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # records span splits
    try:
        path = str(tmp_path / compression)
        warc.write_warc(d, path, compression)
        got = {int(r.page_id): r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == list(range(1, 10))
    for i, _, html in rows:
        want = (html or "").encode()
        assert got[i].said_digest == b32(want)
        if got[i].record_type == "response":
            assert bytes(got[i].payload) == want and got[i].payload_digest == b32(want)
    assert {i: int(r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {3: 2, 6: 4, 9: 4}


@pytest.mark.parametrize("most", [200_000, 0])
def test_warc_report(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    rows = [(5, "u", "x"), (3, "u", "x"), (None, "u", "x"), (4, None, None), (6, "u", "y"), (6, "u", "y")]
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_report(spark.createDataFrame(rows, PAGES)).collect())
    x, y = b32(b"x"), b32(b"y")
    assert got == [(0, 1, x, "revisit", 3), (3, 1, x, "response", None), (4, 0, b32(b""), "response", None), (5, 1, x, "revisit", 3), (6, 1, y, "response", None), (6, 1, y, "response", None)]
    assert warc.archive_report(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("cores", [(4, 6), (8, 4), (4, 40)])
@pytest.mark.parametrize("keep", [True, False])
def test_warc_when_cores_come_and_go(spark, tmp_path, cores, keep):
    rows = [(i, f"http://{i}", f"page {i} " * (i % 90) + ("WARC/1.0\r\n" if i % 7 == 0 else "")) for i in range(250)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(12), path)
    name = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(name, str(cores[0]))
        r = warc.read_warc(spark, path, keep)
        spark.conf.set(name, str(cores[1]))
        assert sorted(int(x.page_id) for x in r.collect()) == list(range(250))
    finally:
        spark.conf.unset(name)


def test_warc_missing_piece_raises(spark, tmp_path, monkeypatch):
    path, chains = str(tmp_path / "w"), warc._chains
    warc.write_warc(spark.createDataFrame([(1, "u", "x"), (2, "u", "y")], PAGES), path)
    monkeypatch.setattr(warc, "_chains", lambda c: chains(c).withColumn("seq", F.col("seq") + 1))
    with pytest.raises(RuntimeError, match="pieces"):
        warc.read_warc(spark, path)


def test_chain():
    off, size = np.array([0, 10, 15, 30, 40]), np.array([10, 20, 25, 10, 5])
    assert warc.mark_chain(off, size).tolist() == [True, True, False, True, True]
    assert warc.mark_chain(off, np.array([10, 19, 25, 10, 5])).tolist() == [True, True, False, False, False]
    assert warc.mark_chain(off + 1, size).tolist() == [False] * 5
    n = 1000
    assert warc.mark_chain(np.arange(n) * 7, np.full(n, 7)).all()


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png_round_trip(kind, samples):
    x = np.random.default_rng(kind).integers(0, 256, (9, 7, samples), dtype=np.uint8)
    data = media.encode_png(x, kind)
    assert (media.decode_png(data) == x).all()
    for at in (3, 20, 45, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="."):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError, match="."):
        media.decode_png(data[:-5])


def test_png_all_filters():
    """Rows filtered by hand with each filter, Average and Paeth too."""
    x = np.random.default_rng(1).integers(0, 256, (5, 6, 3), dtype=np.uint8)
    raw, flat = b"", x.reshape(5, 18).astype(int)
    for y in range(5):
        up = flat[y - 1] if y else np.zeros(18, int)
        row = [y]
        for i in range(18):
            a, b, c = (flat[y][i - 3] if i > 2 else 0), up[i], (up[i - 3] if i > 2 else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((flat[y][i] - (0, a, b, (a + b) // 2, paeth)[y]) % 256)
        raw += bytes(row)
    data = media.SIGNATURE + media._chunk(b"IHDR", bytes([0, 0, 0, 6, 0, 0, 0, 5, 8, 2, 0, 0, 0])) + media._chunk(b"IDAT", zlib.compress(raw)) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == x).all()


def test_media_report(spark):
    texts = [None, "", "short", "é" * 1000, "a" * 192, "a" * 193, "short", "line\n" * 30_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit(1))
    got = {r.doc_id: r for r in media.read_media(media.store_texts(d)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), None)
        assert len(r.feature) == 16
    assert got[2].feature == got[6].feature and got[2].media_sha256 == got[6].media_sha256 and got[0].feature == got[1].feature
    broken = media.store_texts(d).withColumn("media", F.lit(b"junk"))
    assert broken.transform(media.read_media).filter("error is not null and feature is null").count() == len(texts)
    assert media.read_media(media.store_texts(d.limit(0))).count() == 0


def test_dct_hash_is_robust():
    base = np.kron(np.random.default_rng(7).integers(0, 256, (12, 9)), np.ones((10, 10)))
    pic = lambda a: np.repeat(a.astype(np.uint8)[..., None], 3, axis=2)
    bits = lambda h: int(h, 16)
    noise = np.random.default_rng(0).normal(0, 4, base.shape)
    near = bits(media.dct_hash(pic(base))) ^ bits(media.dct_hash(pic((base + noise).clip(0, 255))))
    far = bits(media.dct_hash(pic(base))) ^ bits(media.dct_hash(pic(np.random.default_rng(2).integers(0, 256, base.shape))))
    assert near.bit_count() <= 10 < far.bit_count()


HTML = [
    ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
    ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>z", "- x\n- y\n  3. q\n  4. r\n\nz"),
    ("<table><caption>Cap<tr><td>1<td>two<br>lines<tr><th>three<td>4</table>after", "Cap\n1     | two\n      | lines\nthree | 4\n\nafter"),
    ("<head><title>no</title><style>x</style></head><body>yes<script>var a='</p>'</script>", "yes"),
    ("a<div style='color:red;display: none'>no</div><span hidden>no</span><div>b</div>", "a\nb"),
    ("x&amp;y &lt;z&gt;", "x&y <z>"),
    ("<pre>a  b\n c</pre>d   e", "a  b\n c\n\nd e"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("</b></div>stray</p>end", "stray\n\nend"),
    ("<table><tr><td>長い<td>b<tr><td>abcde<td>c</table>", "長い  | b\nabcde | c"),
    ("<p>unclosed <i>it", "unclosed it"),
    ("", ""), (None, ""), ("<", "<"), ("plain", "plain"),
]


@pytest.mark.parametrize(("html", "text"), HTML)
def test_html(html, text):
    assert html_text.extract_text(html) == text


def test_html_deep_and_frame(spark):
    deep = "<div>" * 5000 + "in" + "</div>" * 5000 + "out"
    assert html_text.extract_text(deep).split() == ["in", "out"]
    d = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(HTML)], PAGES).withColumn("text", F.lit("clash"))
    assert {r.page_id: r.text for r in html_text.extract(d).collect()} == {i: t for i, (_, t) in enumerate(HTML)}
    assert html_text.extract(d.limit(0)).count() == 0


def brute(rows, length=100):
    order = sorted({i for i, _ in rows if i is not None}) + [None]
    seen, out = set(), []
    for i in order:
        here = [t for j, t in rows if j == i]
        new = set()
        for t in here:
            b, own = (t or "").encode(), set()
            gone = bytearray(len(b))
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                if w in seen or w in own:
                    gone[s : s + length] = b"\x01" * length
                own.add(w)
            new |= own
            runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
            out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
        seen |= new
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_EDGES", hot)
    rng = random.Random(3)
    base = "".join(rng.choice("abcde ") for _ in range(700))
    rows = [(1, base[:300]), (2, base[50:151]), (3, "x" * 350), (4, base[:99]), (5, None), (6, ""), (7, "ab" * 200 + base[200:420]), (8, base), (9, base + base), (9, base[:120] + "other"), (10, "zz" + base[100:199] + "q"), (11, "é" * 300), (12, base[300:] + base[:300]), (13, "x" * 101), (None, base[:250]), (8, base)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("low", F.lit(1))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(d).collect()), key=repr)
    assert got == brute(rows)
    assert suffix.remove_repeats(d.limit(0)).count() == 0


def test_repeats_on_a_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(d).collect()), key=repr)
    want = brute([tuple(r) for r in d.collect()])
    assert got == want and sum(r[2] for r in want) > 10_000


@pytest.mark.parametrize("hot", [3, 20_000])
def test_family_of_suffix_arrays(spark, monkeypatch, hot):
    """Edges in batches: levels merge geometrically, and nothing depends on the batches' number or order."""
    ranks = []
    add = suffix.Family.add
    monkeypatch.setattr(suffix.Family, "add", lambda self, batch: (add(self, batch), ranks.append([r for r, _ in self.levels]))[0])
    monkeypatch.setattr(suffix, "BATCHES", 5)
    monkeypatch.setattr(suffix, "HOT_EDGES", hot)
    rng = random.Random(11)
    passage = ["".join(rng.choice("abcdefgh ") for _ in range(260)) for _ in range(3)]
    other = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(5, 80)))
    rows = [(i, other() + passage[i % 3][rng.randrange(60) : 260 - rng.randrange(60)] + other()) for i in range(60)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)
    assert ranks == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]]
