import random

from pyspark.sql import functions as F

from helixframe.plans import queries as own
from helixframe.sources.text import read_fasta


def test_maf_windows_reach_every_site(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, r.choice("FOP"), r.uniform(900, 400_000)) for k in range(0, 400_000, 100)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for k, c, price in rows:
        x, y = int(price) % 60, int(price // 7) % 60
        m, n, s = want.get((c, k // 500 * 500), (0, 0, 0))
        want[c, k // 500 * 500] = (m + min(x, y), n + max(x, y), s + 1)
    got = {(x.contig, x.start): (x.minor, x.major, x.n_snps) for x in own.QUERIES["maf_sums"](spark, str(tmp_path)).collect()}
    assert {k: x for k, x in got.items() if x[2]} == want
    assert own.QUERIES["maf_windows"](spark, str(tmp_path)).agg(F.max("start")).first()[0] == 399_500


def test_fasta_across_splits(spark, tmp_path):
    """Splits that begin within a contig, hold several or none of the headers."""
    r = random.Random(2)
    want, text = {}, ""
    for k, n in enumerate((700, 3, 0, 2_000, 61, 60, 5_000)):
        seq = "".join(r.choice("ACGT") for _ in range(n))
        want[f"c{k}"] = seq
        text += f">c{k} about\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, n, 60))
    (tmp_path / "x.fa").write_text(text)
    for size in ("400", "1000", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_fasta(spark, str(tmp_path / "x.fa")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got = {}
        for x in sorted(rows, key=lambda x: (x.contig, x.block_start)):
            assert len(got.get(x.contig, "")) == x.block_start
            got[x.contig] = got.get(x.contig, "") + x.bases
        assert got == {k: s for k, s in want.items() if s}
