"""Queries over the shared test tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.functions.work import materialize
from helixframe.operators import axis, bias, calls, content, genotype, intervals, merge, prefix, reads, scan, segment, variants, windows
from helixframe.plans import views as v

QUERIES = {}
SQL = {}
SCAN, RATIO, PERCENTILE, SIZE, FRACTION = 720, 0.8, 0.05, 1440, 0.25


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(name: str, to: str | None = None):
    return F.round(F.col(name), 6).alias(to or name)


# Reads -----------------------------------------------------------------------------------------------------------


@query(f"WITH {v.ALIGN} SELECT qname, tid, pos, flag FROM v_align WHERE flag & 5 = 0")
def flag_filter(spark, d):
    return reads.drop_flagged(v.align(spark, d), 5).select("qname", "tid", "pos", "flag")


@query(f"WITH {v.ALIGN} SELECT tid, count(*) AS n, CAST(sum(alen) AS BIGINT) AS bases FROM v_align WHERE mapq >= 10 GROUP BY tid")
def mapq_filter(spark, d):
    return reads.min_quality(v.align(spark, d), 10).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum("alen").alias("bases"))


@query(f"""WITH {v.ALIGN}, x AS (SELECT qname, flag AS line, flag * 16 AS f, pos, pos + mapq - 25 AS mpos FROM v_align)
SELECT qname, line, CASE WHEN f & 16 = 0 AND f & 32 = 0 THEN 0 WHEN f & 16 <> 0 AND f & 32 <> 0 THEN 1 WHEN f & 16 = 0 THEN CASE WHEN pos < mpos THEN 2 ELSE 3 END ELSE CASE WHEN pos > mpos THEN 2 ELSE 3 END END AS layout FROM x""")
def layout_class(spark, d):
    x = v.align(spark, d).select("qname", F.col("flag").alias("line"), (F.col("flag") * 16).alias("flag"), "pos", (F.col("pos") + F.col("mapq") - 25).alias("mpos"))
    return x.select("qname", "line", reads.layout().alias("layout"))


_READS = f"""{v.RECORDS}, r AS (SELECT * FROM v_records WHERE flag & 1796 = 0 AND mapq >= 10 AND NOT (mate AND tid <> mtid)),
seconds AS (SELECT r.* FROM r LEFT JOIN r m ON m.mate AND m.qname = r.qname AND m.ord <> r.ord WHERE NOT r.mate OR (m.ord IS NOT NULL AND (r.pos > r.mpos OR (r.pos = r.mpos AND r.ord > m.ord))))"""


def _seconds(spark, d) -> DataFrame:
    return reads.second_mates(reads.mates_here(reads.min_quality(reads.drop_flagged(v.records(spark, d)), 10)))


@query(f"WITH {_READS} SELECT qname, tid, pos, mpos, line FROM seconds")
def mate_pairs(spark, d):
    """Unpaired reads and second mates of all lines of all orders."""
    return _seconds(spark, d).select("qname", "tid", "pos", "mpos", "line")


@query(f"""WITH {_READS}, x AS (SELECT *, pos + alen - mpos AS size FROM seconds)
SELECT qname, tid, CAST(CASE WHEN mate AND size > 100 AND size < 900 THEN mpos + size // 2 ELSE pos + alen // 2 END AS INTEGER) AS mid FROM x""")
def fragment_midpoints(spark, d):
    return reads.fragment_midpoints(_seconds(spark, d), 100, 900).select("qname", "tid", "mid")


@query(f"""WITH {_READS}, p AS (SELECT pos + alen - mpos AS isize FROM seconds WHERE mate), m AS (SELECT count(*) AS n, list_sort(list(isize))[count(*) // 2 + 1] AS median FROM p),
dev AS (SELECT list_sort(list(abs(isize - median)))[count(*) // 2 + 1] AS mad FROM p, m)
SELECT n, CAST(median AS INTEGER) AS median, CAST(mad AS INTEGER) AS mad, CAST(median // 2 * 2 + 1 AS INTEGER) AS meanisize, CAST(greatest(0, median - 3 * mad) AS INTEGER) AS low, CAST(median + 3 * mad AS INTEGER) AS high FROM m, dev""")
def isize_stats(spark, d):
    x = _seconds(spark, d).filter(reads.has(reads.PAIRED)).select((F.col("pos") + F.col("alen") - F.col("mpos")).alias("isize"))
    m = stats.median_mad(x, "isize").crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("n"))))
    c = F.col
    return m.select("n", c("median").cast("int"), c("mad").cast("int"), (F.floor(c("median") / 2) * 2 + 1).cast("int").alias("meanisize"), F.greatest(F.lit(0), c("median") - 3 * c("mad")).cast("int").alias("low"), (c("median") + 3 * c("mad")).cast("int").alias("high"))


_POINTS = f"""{_READS}, x AS (SELECT *, pos + alen - mpos AS size FROM seconds), y AS (SELECT *, mate AND size > 100 AND size < 900 AS normal FROM x),
p AS (SELECT 'count' AS mode, tid, CASE WHEN normal THEN mpos + size // 2 ELSE pos + alen // 2 END AS pos FROM y
    UNION ALL SELECT 'bias', tid, CASE WHEN NOT mate THEN pos + alen // 2 WHEN normal THEN mpos + size // 2 WHEN line % 2 = 0 THEN pos + alen - 125 ELSE pos + 125 END FROM y
    UNION ALL SELECT 'scan', tid, CASE WHEN NOT mate THEN pos + alen // 2 ELSE mpos + size // 2 END FROM y WHERE NOT mate OR (normal AND line % 2 = 0 AND pos > mpos))"""


@query(f"WITH {_POINTS} SELECT mode, concat('g', tid) AS contig, CAST(pos AS INTEGER) AS pos, least(count(*), 65534) AS depth FROM p WHERE pos >= 0 AND pos < {v.DAYS} GROUP BY mode, tid, pos")
def fragment_depth(spark, d):
    """Depth by the three ways of counting, which branch from mates paired once."""
    paired = materialize(reads.paired_reads(v.records(spark, d), 10), "paired")
    out = None
    for mode in ("count", "bias", "scan"):
        one = reads.depth(reads.fragment_points(paired, v.genome_contigs(spark, d), 100, 900, mode)).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


#: Reads looked at, reads and pairs taken: the sample's bounds, which cut at every scale but the smallest.
SCREENED, TAKEN = 20_000, 10_000


@query(f"""WITH {v.RECORDS}, s AS (SELECT * FROM v_records WHERE flag & 1796 = 0 AND flag & 128 = 0 AND l_qseq < 65000 ORDER BY ord LIMIT {SCREENED + 1}),
rd AS (SELECT * FROM s ORDER BY ord LIMIT {TAKEN}), pr AS (SELECT abs(isize) AS isize, pos < mpos AS facing FROM s WHERE mate AND tid = mtid ORDER BY ord LIMIT {TAKEN}),
a AS (SELECT count(*) AS n, list_sort(list(l_qseq))[count(*) // 2 + 1] AS rs FROM rd), m AS (SELECT count(*) AS n, count_if(facing) AS facing, list_sort(list(isize))[count(*) // 2 + 1] AS median FROM pr),
dv AS (SELECT list_sort(list(abs(isize - median)))[count(*) // 2 + 1] AS mad FROM pr, m), k AS (SELECT m.*, mad, m.n >= 1000 AND median >= 50 AND median <= 100000 AS ok FROM m, dv)
SELECT CASE WHEN a.n >= 1000 THEN rs ELSE 0 END AS rs, CASE WHEN ok THEN median ELSE 250 END AS median, CASE WHEN ok THEN mad ELSE 15 END AS mad, CASE WHEN ok THEN greatest(0, median - 3 * mad) ELSE 0 END AS min_isize,
    CASE WHEN ok THEN median + 3 * mad ELSE 400 END AS max_isize, CASE WHEN ok THEN facing ELSE 0 END AS facing, CASE WHEN ok THEN k.n - facing ELSE 0 END AS not_facing, CASE WHEN ok THEN median ELSE 250 END // 2 * 2 + 1 AS meanisize FROM a, k""")
def library_stats(spark, d):
    """One row: what the library's first reads and pairs in file order say."""
    got = reads.library_stats(materialize(v.records(spark, d), "records"), screened=SCREENED, wanted=TAKEN)
    return spark.createDataFrame([tuple(map(int, got.values()))], ", ".join(f"{k} long" for k in got))


_PILEUP = f"""{v.RECORDS}, {v.GENOME}, r AS (SELECT * FROM v_records WHERE flag & 1796 = 0 AND mapq >= 10 AND NOT (mate AND tid <> mtid)),
cut AS (SELECT ord, 0 AS r, 0 AS s, alen AS n FROM r WHERE line % 3 = 0 UNION ALL SELECT ord, 0, 5, alen - 10 FROM r WHERE line % 3 = 1 UNION ALL SELECT ord, alen - 10, alen - 2, 10 FROM r WHERE line % 3 = 1
    UNION ALL SELECT ord, 0, 0, 8 FROM r WHERE line % 3 = 2 UNION ALL SELECT ord, 12, 8, alen - 18 FROM r WHERE line % 3 = 2),
aligned AS (SELECT concat('g', r.tid) AS contig, r.pos + c.r + k AS pos, substr(r.seq, CAST(c.s + k + 1 AS BIGINT), 1) AS base, 2 * (instr('{v.HEX}', substr(q, CAST(c.s + k + 1 AS BIGINT), 1)) - 1) AS bq
    FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM cut) c JOIN r USING (ord)),
sup AS (SELECT s.contig, s.pos, s.ref, s.alt, count_if(a.base = s.alt) AS alt_n, count_if(a.base = s.ref) AS ref_n FROM v_sites s JOIN v_genome g ON g.contig = s.contig AND g.pos = s.pos AND g.base = s.ref JOIN aligned a ON a.contig = s.contig AND a.pos = s.pos AND a.bq >= 10 GROUP BY ALL)"""


@query(f"WITH {_PILEUP} SELECT contig, pos, ref, alt, CAST(coalesce(ref_n, 0) AS INTEGER) AS ref_n, CAST(coalesce(alt_n, 0) AS INTEGER) AS alt_n FROM v_sites LEFT JOIN sup USING (contig, pos, ref, alt)")
def pileup(spark, d):
    """Allele support of sites on a genome made of ship days, which are counted once."""
    days = materialize(v.ship_days(spark, d), "days")
    return variants.pileup(v.records(spark, d), v.sites(spark, d, days), v.genome_contigs(spark, d), v.genome(spark, d, days), 10, 10)


@query(f"""WITH {v.RECORDS}, r AS (SELECT * FROM v_records WHERE flag & 1540 = 0 AND mapq >= 10),
m AS (SELECT concat('g', tid) AS contig, pos, 1 AS l, 0 AS r FROM r WHERE line % 3 = 1 UNION ALL SELECT concat('g', tid), pos + 8, 0, 1 FROM r WHERE line % 3 = 2 UNION ALL SELECT concat('g', tid), pos + 12, 1, 0 FROM r WHERE line % 3 = 2)
SELECT contig, CAST(pos AS INTEGER) AS pos, CAST(sum(l) AS INTEGER) AS left_n, CAST(sum(r) AS INTEGER) AS right_n FROM m WHERE pos >= 0 AND pos < {v.DAYS} GROUP BY contig, pos""")
def split_breakpoints(spark, d):
    """Clips of over 4 and deletions of over 3 bases, so that those of the made reads count."""
    return reads.split_breakpoints(v.records(spark, d), v.genome_contigs(spark, d), 10, 3, clip=4)


_IDENTITY = f"""{v.RECORDS}, {v.GENOME}, cut AS (SELECT ord, 0 AS r, 0 AS s, alen AS n FROM v_records WHERE line % 3 = 0 UNION ALL SELECT ord, 0, 5, alen - 10 FROM v_records WHERE line % 3 = 1 UNION ALL SELECT ord, alen - 10, alen - 2, 10 FROM v_records WHERE line % 3 = 1
    UNION ALL SELECT ord, 0, 0, 8 FROM v_records WHERE line % 3 = 2 UNION ALL SELECT ord, 12, 8, alen - 18 FROM v_records WHERE line % 3 = 2),
aligned AS (SELECT r.ord, concat('g', r.tid) AS contig, r.pos + c.r + k AS pos, substr(r.seq, CAST(c.s + k + 1 AS BIGINT), 1) AS base FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM cut) c JOIN v_records r USING (ord)),
hit AS (SELECT ord, count_if(a.base = g.base) AS same FROM aligned a JOIN v_genome g ON g.contig = a.contig AND g.pos = a.pos GROUP BY ord)"""


@query(f"""WITH {_IDENTITY} SELECT r.ord, CAST(coalesce(same, 0) AS INTEGER) AS same, CAST(alen + CASE WHEN line % 3 = 1 THEN 3 ELSE 0 END AS INTEGER) AS aligned, round(coalesce(same, 0)::DOUBLE / (alen + CASE WHEN line % 3 = 1 THEN 3 ELSE 0 END), 6) AS identity FROM v_records r LEFT JOIN hit USING (ord)""")
def percent_identity(spark, d):
    """Of all reads against the genome made of ship days, in tiles of 512 bases."""
    return variants.percent_identity(v.records(spark, d), v.genome_contigs(spark, d), v.genome(spark, d), 512).select("ord", "same", "aligned", r6("identity"))


@query("""WITH c AS (SELECT p_brand AS contig, CAST(sum(p_size) AS BIGINT) AS length FROM part GROUP BY p_brand),
r AS (SELECT *, sum(length) OVER (ORDER BY length DESC, contig ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER () AS total FROM c) SELECT max(length) AS n95 FROM r WHERE run > 0.95 * total""")
def n95_length(spark, d):
    c = v.table(spark, d, "part").groupBy(F.col("p_brand").alias("contig")).agg(F.sum("p_size").alias("length"))
    return spark.range(1).select(F.lit(stats.n95_length(c)).cast("long").alias("n95"))


@query(f"WITH {v.DEPTH} SELECT contig, pos, CAST(depth AS BIGINT) AS depth FROM v_depth")
def depth_track(spark, d):
    return v.depth(spark, d).withColumn("depth", F.col("depth").cast("long"))


# Sequence content ------------------------------------------------------------------------------------------------


@query(f"""WITH {v.SEQUENCE}, x AS (SELECT contig, pos, length, CAST(sum(CASE WHEN ch IN ('e', 't', 'E', 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS BIGINT) AS g FROM v_seq),
y AS (SELECT contig, CASE WHEN pos >= 25 AND pos < length - 25 THEN g ELSE 0 END AS gc FROM x) SELECT contig, gc, count(*) AS n FROM y GROUP BY contig, gc""")
def gc_window(spark, d):
    out = content.block_sums({"gc": (v.sequence(spark, d), "etET")}, 25)
    return out.groupBy("contig", F.col("gc").cast("long").alias("gc")).agg(F.count(F.lit(1)).alias("n"))


# Scan windows, curve, bounds -------------------------------------------------------------------------------------

_BINS = f"""{v.BASE}, v_tiles AS (SELECT contig, s AS start, s + {SCAN} AS "end" FROM (SELECT contig, length, unnest(generate_series(0, {v.MINUTES - SCAN - 1}, {SCAN})) AS s FROM v_contigs)),
v_bins AS (SELECT t.contig, t.start, t."end", CAST(coalesce(sum(b.depth), 0) AS BIGINT) AS cov, CAST(coalesce(sum(CASE WHEN b.uniq = 1 THEN b.depth ELSE 0 END), 0) AS BIGINT) AS uniqcov
    FROM v_tiles t LEFT JOIN v_base b ON t.contig = b.contig AND t.start = b.pos // {SCAN} * {SCAN} GROUP BY t.contig, t.start, t."end")"""
_SELECT = f"""{_BINS}, pre AS (SELECT *, cov > 0 AND uniqcov::DOUBLE / cov > {RATIO} AS ok FROM v_bins), med AS (SELECT list_sort(list(cov))[count(*) // 2 + 1] AS median FROM pre WHERE ok),
mads AS (SELECT list_sort(list(abs(cov - median)))[count(*) // 2 + 1] AS mad FROM pre, med WHERE ok),
v_sel AS (SELECT contig, start, "end", cov, uniqcov, ok AND cov > greatest(0, median - mad) AND cov < median + mad AS selected FROM pre, med, mads)"""
_SHARES = """coalesce(sample / nullif(CAST(sum(sample) OVER () AS DOUBLE), 0), 0) AS frac_s, coalesce(reference / nullif(CAST(sum(reference) OVER () AS DOUBLE), 0), 0) AS frac_r,
    coalesce(sum(sample) OVER (ORDER BY gc) / nullif(CAST(sum(sample) OVER () AS DOUBLE), 0), 0) AS pct_s, coalesce(sum(reference) OVER (ORDER BY gc) / nullif(CAST(sum(reference) OVER () AS DOUBLE), 0), 0) AS pct_r"""
_CURVE = f"""{_SELECT}, known AS (SELECT b.gc, b.depth FROM v_base b JOIN v_sel s ON b.contig = s.contig AND b.pos // {SCAN} * {SCAN} = s.start WHERE s.selected AND b.uniq = 1),
per AS (SELECT g.gc, CAST(coalesce(sum(k.depth), 0) AS BIGINT) AS sample, count(k.gc) AS reference FROM (SELECT CAST(unnest(generate_series(0, 23)) AS INTEGER) AS gc) g LEFT JOIN known k ON g.gc = k.gc GROUP BY g.gc),
v_curve0 AS (SELECT *, CASE WHEN reference > 0 THEN sample::DOUBLE / reference ELSE 0 END AS coverage, {_SHARES} FROM per),
v_curve AS (SELECT *, CASE WHEN frac_r > 0 THEN frac_s / frac_r ELSE 1 END AS obsexp FROM v_curve0)"""
_P = f"CAST(CAST({PERCENTILE} AS FLOAT) AS DOUBLE)"
_BOUNDS = f"""{_CURVE}, raw AS (SELECT coalesce(max(CASE WHEN pct_s < {_P} OR pct_r < {_P} THEN gc END), 0) AS low, coalesce(min(CASE WHEN pct_s + {_P} > 1 OR pct_r + {_P} > 1 THEN gc END), 24) AS high FROM v_curve),
v_bounds AS (SELECT low, CASE WHEN low >= high THEN low + 1 ELSE high END AS high FROM raw)"""
_RENORM = f"""{_BOUNDS}, inner0 AS (SELECT gc, {_SHARES} FROM v_curve, v_bounds WHERE gc > low AND gc < high),
v_renorm AS (SELECT c.gc, c.sample, c.reference, c.coverage, coalesce(i.frac_s, 0) AS frac_s, coalesce(i.frac_r, 0) AS frac_r, coalesce(i.pct_s, 0) AS pct_s, coalesce(i.pct_r, 0) AS pct_r,
    CASE WHEN i.frac_r > 0 THEN i.frac_s / i.frac_r ELSE 1 END AS obsexp FROM v_curve c LEFT JOIN inner0 i ON c.gc = i.gc)"""
_OK = f"{_RENORM}, v_ok AS (SELECT b.contig, b.pos, b.depth, r.obsexp, r.coverage AS expected FROM v_base b JOIN v_renorm r ON b.gc = r.gc, v_bounds WHERE b.gc > low AND b.gc < high AND b.uniq = 1)"


def _bins(spark, d):
    b = v.base(spark, d).filter("depth > 0").select("contig", "pos", F.col("depth").alias("n"), (F.col("uniq") == 1).alias("unique"))
    return materialize(scan.scan_bins(b, intervals.tiles(v.contigs(spark, d), SCAN), SCAN), "bins")  # a few hundred rows that several branches read


def _curve(spark, d):
    chosen = scan.select_windows(_bins(spark, d), RATIO).filter("selected").select("contig", "start")
    b = v.base(spark, d).filter("uniq = 1").withColumn("start", F.expr(f"pos div {SCAN} * {SCAN}"))
    return materialize(bias.curve(b.join(chosen, ["contig", "start"]).select("gc", "depth"), 24), "curve")  # 24 rows


def _ok(spark, d):
    """Callable minutes with depth, obsexp and expected. The bounds come to the driver; the curve has 24 rows."""
    c = _curve(spark, d)
    low, high = bias.bounds(c, PERCENTILE).first()
    curve = bias.renormalised(c, low, high)
    # A minute is unique or not, so a fragment of one position asks for uniqueness.
    return bias.with_expected(v.base(spark, d).filter(content.callable_base(low, high, 0.97, 1)), curve)


@query(f'WITH {_BINS} SELECT contig, start, "end", cov, uniqcov FROM v_bins')
def scan_bins(spark, d):
    return _bins(spark, d).select("contig", "start", "end", "cov", "uniqcov")


@query(f'WITH {_SELECT} SELECT contig, start, "end", cov, uniqcov, selected FROM v_sel')
def scan_select(spark, d):
    return scan.select_windows(_bins(spark, d), RATIO).select("contig", "start", "end", "cov", "uniqcov", "selected")


_ROUNDED = "round(coverage, 6) AS coverage, round(frac_s, 6) AS frac_s, round(frac_r, 6) AS frac_r, round(pct_s, 6) AS pct_s, round(pct_r, 6) AS pct_r, round(obsexp, 6) AS obsexp"


def _rounded(c):
    return c.select("gc", "sample", "reference", *[r6(x) for x in ("coverage", "frac_s", "frac_r", "pct_s", "pct_r", "obsexp")])


@query(f"WITH {_CURVE} SELECT gc, sample, reference, {_ROUNDED} FROM v_curve")
def strat_curve(spark, d):
    return _rounded(_curve(spark, d))


@query(f"WITH {_BOUNDS} SELECT CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high FROM v_bounds")
def strat_bounds(spark, d):
    return bias.bounds(_curve(spark, d), PERCENTILE)


@query(f"WITH {_RENORM} SELECT gc, sample, reference, {_ROUNDED} FROM v_renorm")
def strat_renorm(spark, d):
    c = _curve(spark, d)
    return _rounded(bias.renormalised(c, *bias.bounds(c, PERCENTILE).first()))


@query(f"""WITH {_CURVE}, x AS (SELECT gc, gc / CAST(23 AS DOUBLE) AS share, sample, reference FROM v_curve), y AS (SELECT *, sample * CAST(sum(reference) OVER () AS DOUBLE) / sum(sample) OVER () AS scaled FROM x WHERE share > 0.25 AND share < 0.75)
SELECT gc, round(share, 6) AS share, reference, round(scaled, 4) AS scaled_sample, round(scaled / reference, 6) AS bias FROM y""")
def plot_curve(spark, d):
    return bias.scaled_shares(_curve(spark, d)).select("gc", r6("share"), "reference", F.round("scaled_sample", 4).alias("scaled_sample"), r6("bias"))


@query("""WITH c AS (SELECT c_nationkey AS tid, concat('n', c_nationkey) AS contig, count(*) AS length, CAST(sum(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 0 END) AS BIGINT) AS cov FROM customer GROUP BY c_nationkey), k AS (SELECT * FROM c WHERE contig NOT IN ('n3', 'n7')),
x AS (SELECT *, coalesce(sum(cov) OVER (ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT avg(length) FROM c) AS mean, (SELECT sum(cov) / 2 FROM c) AS enough FROM k)
SELECT tid, contig, length FROM x WHERE length >= floor(mean) OR before <= floor(enough)""")
def scanned_contigs(spark, d):
    """Nations as contigs, two of them as sex chromosomes; small ones are left out once half the coverage is seen."""
    c = v.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("tid")).agg(F.count(F.lit(1)).alias("length"), F.sum(F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).otherwise(0)).cast("long").alias("cov"))
    c = materialize(c.withColumn("contig", F.concat(F.lit("n"), F.col("tid").cast("string"))), "nations")  # a row a nation
    mean, enough = c.agg(F.floor(F.avg("length")), F.floor(F.sum("cov") / 2)).first()
    return scan.scanned_contigs(c.select("tid", "contig", "length"), c.select("contig", "cov"), mean, ("n3", "n7"), enough).select("tid", "contig", "length")


@query(f"""WITH {v.ITV}, c AS (SELECT contig, max("end") AS length FROM v_itv WHERE start % 2 = 0 GROUP BY contig), i AS (SELECT contig, start, CASE WHEN start % 9 = 0 THEN start ELSE "end" END AS "end" FROM v_itv)
SELECT i.contig, i.start, i."end" FROM i JOIN c ON c.contig = i.contig WHERE i.start < i."end" AND i."end" < c.length""")
def valid_intervals(spark, d):
    """Parts as regions to scan: not empty, and before their contig's end."""
    i = v.part_intervals(spark, d)
    c = i.filter("start % 2 = 0").groupBy("contig").agg(F.max("end").alias("length"))
    return intervals.valid_windows(i.withColumn("end", F.when(F.col("start") % 9 == 0, F.col("start")).otherwise(F.col("end"))), c, strict=True).select("contig", "start", "end")


# Windows ---------------------------------------------------------------------------------------------------------


def _six(w):
    return w.select("contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("mappable").cast("long").alias("mappable"), r6("counts"), r6("cn"))


def _fixed_sql(size: int, offset: int) -> str:
    return f"""WITH {_OK}, k AS (SELECT DISTINCT s AS start FROM (SELECT unnest(generate_series(0, {v.MINUTES - size - 1}, {offset})) AS s)),
w AS (SELECT o.contig, k.start, count(*) AS mappable, sum(depth) AS cov, sum(obsexp) AS obs, sum(expected) AS ex FROM v_ok o JOIN k ON o.pos >= k.start AND o.pos < k.start + {size} GROUP BY o.contig, k.start)
SELECT contig, CAST(start AS BIGINT) AS start, CAST(start + {size} AS BIGINT) AS "end", mappable, round(cov / (obs / mappable) * ({size}.0::DOUBLE / mappable), 6) AS counts, round(2.0::DOUBLE * cov / ex, 6) AS cn FROM w WHERE mappable >= {FRACTION} * {size}"""


@query(_fixed_sql(SIZE, SIZE))
def fixed_windows(spark, d):
    return _six(windows.fixed_windows(_ok(spark, d), v.contigs(spark, d), SIZE, SIZE, FRACTION))


@query(_fixed_sql(SIZE, 360))
def sliding_windows(spark, d):
    return _six(windows.fixed_windows(_ok(spark, d), v.contigs(spark, d), SIZE, 360, FRACTION))


def _adaptive_sql(size: int, offset: int, ok: str = "v_ok") -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY pos) - 1 AS r FROM {ok}), ks AS (SELECT contig, unnest(generate_series(0, (max(r) + 1 - {size}) // {offset})) AS k FROM ranked GROUP BY contig HAVING max(r) + 1 >= {size}),
aw AS (SELECT x.contig, k, count(*) AS mappable, sum(depth) AS cov, sum(obsexp) AS obs, sum(expected) AS ex, max(pos) + 1 AS "end" FROM ranked x JOIN ks ON x.contig = ks.contig AND x.r >= k * {offset} AND x.r < k * {offset} + {size} GROUP BY x.contig, k),
av AS (SELECT aw.*, CASE WHEN k = 0 THEN 0 ELSE b.pos + 1 END AS start FROM aw LEFT JOIN ranked b ON aw.contig = b.contig AND b.r = k * {offset} - 1)"""


_AV = """SELECT contig, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", mappable, round(cov / (obs / mappable), 6) AS counts, round(2.0::DOUBLE * cov / ex, 6) AS cn FROM """


@query(f"WITH {_OK}, {_adaptive_sql(1000, 1000)} {_AV} av")
def adaptive_windows(spark, d):
    return _six(windows.adaptive_windows(_ok(spark, d), 1000, 1000, block=10_000))


@query(f"WITH {_OK}, {_adaptive_sql(1000, 300)} {_AV} av")
def adaptive_overlapping(spark, d):
    return _six(windows.adaptive_windows(_ok(spark, d), 1000, 300, block=10_000))


_BED = f"""v_bed AS (SELECT DISTINCT contig, s AS start, s + n AS "end" FROM (SELECT contig, p_partkey * 97 % 43000 AS s, 100 + p_size * 40 AS n FROM part, v_contigs) WHERE s + n <= {v.MINUTES})"""


def _bed(spark, d):
    p = v.table(spark, d, "part").select((F.col("p_partkey") * 97 % 43000).alias("start"), (F.col("p_partkey") * 97 % 43000 + 100 + F.col("p_size") * 40).alias("end"))
    return p.join(F.broadcast(v.contigs(spark, d).select("contig")))  # five contigs


@query(f"""WITH {_OK}, {_BED}, w AS (SELECT i.contig, i.start, i."end", count(o.pos) AS mappable, sum(depth) AS cov, sum(obsexp) AS obs, sum(expected) AS ex FROM v_bed i LEFT JOIN v_ok o ON o.contig = i.contig AND o.pos >= i.start AND o.pos < i."end" GROUP BY i.contig, i.start, i."end"),
x AS (SELECT *, mappable >= {FRACTION} * ("end" - start) AS enough FROM w)
SELECT contig, start, "end", mappable, CASE WHEN enough THEN round(cov / (obs / mappable) * (("end" - start)::DOUBLE / mappable), 6) END AS counts, CASE WHEN enough THEN round(2.0::DOUBLE * cov / ex, 6) END AS cn FROM x""")
def bed_windows(spark, d):
    return _six(windows.bed_windows(_ok(spark, d), _bed(spark, d), v.contigs(spark, d), FRACTION, bucket=1024))


_SPARSE = """v_sparse AS (SELECT DISTINCT contig, p_partkey * 97 % 43000 AS start, p_partkey * 97 % 43000 + p_size AS "end" FROM part, v_contigs),
isl0 AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_sparse),
isl1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM isl0),
v_union AS (SELECT contig, min(start) AS start, max("end") AS "end" FROM isl1 GROUP BY contig, island)"""


@query(f"""WITH {_OK}, {_SPARSE}, v_in AS (SELECT o.* FROM v_ok o JOIN v_union u ON o.contig = u.contig AND o.pos >= u.start AND o.pos < u."end"), {_adaptive_sql(500, 500, 'v_in')},
nx AS (SELECT contig, "end" AS at, lead(start) OVER (PARTITION BY contig ORDER BY start) AS nxt FROM v_union), f AS (SELECT contig, min(start) AS first FROM v_union GROUP BY contig),
moved AS (SELECT av.contig, CASE WHEN av.start = 0 THEN f.first ELSE coalesce(nx.nxt, av.start) END AS start, av."end", mappable, cov, obs, ex FROM av JOIN f ON av.contig = f.contig LEFT JOIN nx ON nx.contig = av.contig AND nx.at = av.start AND nx.nxt IS NOT NULL)
{_AV} moved""")
def bed_adaptive(spark, d):
    p = v.table(spark, d, "part").select((F.col("p_partkey") * 97 % 43000).alias("start"), (F.col("p_partkey") * 97 % 43000 + F.col("p_size")).alias("end"))
    short = p.join(F.broadcast(v.contigs(spark, d).select("contig")))  # five contigs
    return _six(windows.bed_adaptive_windows(_ok(spark, d), short, v.contigs(spark, d), 500, 500, bucket=1024, block=10_000))


@query(f"""WITH {_OK}, lv AS (SELECT unnest([45, 90, 180, 360, 720, 1440, 2880, 5760, 11520, 23040]) AS ws), t AS (SELECT o.contig, ws, o.pos // ws AS k, sum(depth) AS cov, sum(expected) AS ex FROM v_ok o, lv GROUP BY o.contig, ws, o.pos // ws),
x AS (SELECT ws, 2.0::DOUBLE * cov / ex - 2 AS dv FROM t WHERE (k + 1) * ws < {v.MINUTES} AND ex > 0) SELECT ws, round(sum(dv * dv), 4) AS dev, count(*) AS n FROM x GROUP BY ws""")
def scale_variance(spark, d):
    return windows.scale_variance(_ok(spark, d), v.contigs(spark, d), 45).select("ws", F.round("dev", 4).alias("dev"), "n")


@query(f"""WITH {_OK}, lv AS (SELECT unnest([45, 90, 180, 360, 720, 1440, 2880, 5760, 11520, 23040]) AS ws), t AS (SELECT o.contig, ws, o.pos // ws AS k, sum(depth) AS cov, sum(expected) AS ex FROM v_ok o, lv GROUP BY o.contig, ws, o.pos // ws),
x AS (SELECT ws, 2.0::DOUBLE * cov / ex - 2 AS dv FROM t WHERE (k + 1) * ws < {v.MINUTES} AND ex > 0), y AS (SELECT ws, CASE WHEN count(*) > 1 THEN least(greatest(sum(dv * dv) / (count(*) - 1), 1e-6), 0.5) ELSE 0.5 END AS sd FROM x GROUP BY ws),
p AS (SELECT p_partkey AS id, p_size * 700 AS size FROM part) SELECT id, size, round(coalesce((SELECT arg_min(sd, ws) FROM y WHERE 2 * ws > size), 0.5), 6) AS sd FROM p""")
def sd_lookup(spark, d):
    """The deviation that calls of many sizes get from the levels."""
    levels = genotype.level_sd(windows.scale_variance(_ok(spark, d), v.contigs(spark, d), 45))
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 700).alias("size"))
    return genotype.with_sd(p, levels).select("id", "size", r6("sd"))


_MIN = 60
_U = "4294967296.0::DOUBLE"
#: Sums of whole numbers alone: expected coverage and gains are cut to units before they are added.
_CONTRAST = f"""{_OK}, v_rank AS (SELECT *, CAST(floor(expected * {_U}) AS BIGINT) AS units, row_number() OVER (PARTITION BY contig ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY contig) AS n FROM v_ok),
v_cum AS (SELECT contig, r, n, CAST(sum(depth) OVER w AS BIGINT) AS cs, CAST(sum(units) OVER w AS BIGINT) AS es FROM v_rank WINDOW w AS (PARTITION BY contig ORDER BY r ROWS UNBOUNDED PRECEDING)),
v_scale AS (SELECT unnest({calls.scales(_MIN)}) AS s),
v_at AS (SELECT contig, s, r, n, cs, es, lag(cs, s) OVER k AS cb, lag(es, s) OVER k AS eb, lead(cs, 100) OVER k AS cc, lead(es, 100) OVER k AS ec, lead(cs, 100 + s) OVER k AS cd, lead(es, 100 + s) OVER k AS ed FROM v_cum, v_scale WINDOW k AS (PARTITION BY contig, s ORDER BY r)),
v_sides AS (SELECT contig, s, r + 50 AS place, CASE WHEN es > coalesce(eb, 0) THEN 2.0::DOUBLE * (cs - coalesce(cb, 0)) / ((es - coalesce(eb, 0)) / {_U}) ELSE 0 END AS l, CASE WHEN ed > ec THEN 2.0::DOUBLE * (cd - cc) / ((ed - ec) / {_U}) ELSE 0 END AS r FROM v_at WHERE r >= s AND r < n - s - 100),
v_gap AS (SELECT contig, s, place, round(abs(l - r)) AS shift, abs(abs(l - r) - round(abs(l - r))) + abs(l - round(l)) + abs(r - round(r)) AS off FROM v_sides),
v_score0 AS (SELECT contig, place, CAST(sum(CASE WHEN shift >= 1 AND off < 1 - 1e-6 THEN CAST(floor(shift * (shift - off) * 1073741824) AS BIGINT) ELSE 0 END) AS BIGINT) / 1073741824.0::DOUBLE AS score FROM v_gap GROUP BY contig, place),
v_score AS (SELECT * FROM v_score0 WHERE score >= 1.5)"""


def _scores(spark, d):
    ranked = calls.ranked_bases(_ok(spark, d), 10_000)
    return ranked, calls.contrast_scores(ranked, _MIN, ranks=20_000)


@query(f"WITH {_CONTRAST} SELECT contig, place, round(score, 6) AS score FROM v_score")
def contrast_scores(spark, d):
    return _scores(spark, d)[1].select("contig", F.col("rank").alias("place"), r6("score"))


@query(f"""WITH {_CONTRAST}, g AS (SELECT *, place - row_number() OVER (PARTITION BY contig ORDER BY place) AS island FROM v_score),
m AS (SELECT *, floor(max(score) OVER (PARTITION BY contig, island)) AS whole FROM g),
p AS (SELECT contig, min(place) - 1 AS low, max(place) + 1 AS high, coalesce(max(CASE WHEN score > whole THEN place END), min(CASE WHEN score = whole THEN place END)) AS pos, max(island) AS island FROM m GROUP BY contig, island)
SELECT p.contig, low, high, pos, round(s.score, 6) AS height FROM p JOIN v_score s ON s.contig = p.contig AND s.place = p.pos""")
def positive_runs(spark, d):
    ranked, scores = _scores(spark, d)
    return calls.score_peaks(scores, calls.callable_lengths(ranked), 5_000).select("contig", "low", "high", "pos", r6("height"))


# Intervals and variants ------------------------------------------------------------------------------------------


@query(f"""WITH {v.ITV}, a AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_itv),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM a) SELECT contig, min(start) AS start, max("end") AS "end" FROM b GROUP BY contig, island""")
def interval_union(spark, d):
    return intervals.union_intervals(v.part_intervals(spark, d))


@query(f"""WITH {v.ITV} SELECT p.p_partkey AS pos, i.contig, i.start, i."end" FROM part p JOIN v_itv i ON p.p_brand = i.contig AND p.p_partkey >= i.start AND p.p_partkey < i."end" """)
def interval_point_join(spark, d):
    points = v.table(spark, d, "part").select(F.col("p_brand").alias("contig"), F.col("p_partkey").alias("pos"))
    return intervals.interval_join(points, v.part_intervals(spark, d), 64).select("pos", "contig", "start", "end")


@query(f"WITH {v.CONTIGS} SELECT contig, CAST(s AS BIGINT) AS start, CAST(s + {SCAN} AS BIGINT) AS \"end\" FROM (SELECT contig, unnest(generate_series(0, {v.MINUTES - SCAN - 1}, {SCAN})) AS s FROM v_contigs)")
def tiling(spark, d):
    return intervals.tiles(v.contigs(spark, d), SCAN).select("contig", "start", "end")


_HET = "ref_n + alt_n > 10 AND ref_n >= greatest(ceil({h}::DOUBLE * (ref_n + alt_n)), 2) AND alt_n >= greatest(ceil({h}::DOUBLE * (ref_n + alt_n)), 2)"


@query(f"WITH {v.SNP} SELECT contig, pos, ref_n, alt_n FROM v_snp WHERE {_HET.format(h=0.1)}")
def het_filter(spark, d):
    return variants.het_sites(v.snps(spark, d), 10)


_CONTROL = f"v_ctl AS (SELECT contig, pos, alt_n AS ref_n, (ref_n * 3 + 7) % 60 AS alt_n FROM v_snp WHERE pos % 4 <> 0), c_het AS (SELECT * FROM v_ctl WHERE {_HET.format(h=0.3)})"


def _control(spark, d):
    return v.snps(spark, d).filter("pos % 4 <> 0").select("contig", "pos", F.col("alt_n").alias("ref_n"), ((F.col("ref_n") * 3 + 7) % 60).alias("alt_n"))


@query(f"WITH {v.SNP}, {_CONTROL} SELECT s.* FROM v_snp s WHERE EXISTS (SELECT 1 FROM c_het c WHERE c.contig = s.contig AND c.pos = s.pos)")
def matched_sites(spark, d):
    return variants.matched_sites(v.snps(spark, d), variants.het_sites(_control(spark, d), 10, control=True))


@query(f"""WITH {v.SNP}, {_CONTROL} SELECT s.contig, s.pos, s.ref_n AS ref_t, s.alt_n AS alt_t, round(s.alt_n::DOUBLE / (s.ref_n + s.alt_n), 6) AS baf_t, coalesce(c.ref_n, 0) AS ref_c, coalesce(c.alt_n, 0) AS alt_c, round(coalesce(c.alt_n::DOUBLE / nullif(c.ref_n + c.alt_n, 0), 0.5), 6) AS baf_c
FROM v_snp s LEFT JOIN c_het c ON s.contig = c.contig AND s.pos = c.pos WHERE s.ref_n + s.alt_n > 0""")
def baf_table(spark, d):
    t = variants.baf_table(v.snps(spark, d), variants.het_sites(_control(spark, d), 10, control=True))
    return t.select("contig", "pos", "ref_t", "alt_t", r6("baf_t"), "ref_c", "alt_c", r6("baf_c"))


@query(f"WITH {v.SNP}, x AS (SELECT alt_n::DOUBLE / nullif(ref_n + alt_n, 0) AS f FROM v_snp) SELECT round(avg(least(f, 1 - f)), 6) AS mean_maf FROM x")
def mean_folded_maf(spark, d):
    return variants.mean_folded(v.snps(spark, d)).select(r6("mean_maf"))


_MAFW = f"""{v.SNP}, {_CONTROL}, w AS (SELECT contig, unnest(generate_series(0, max(pos) // 500 * 500, 500)) AS start FROM v_snp GROUP BY contig),
t AS (SELECT w.contig, w.start, coalesce(sum(least(ref_n, alt_n)), 0) AS minor, coalesce(sum(greatest(ref_n, alt_n)), 0) AS major, count(s.pos) AS n_snps FROM w LEFT JOIN v_snp s ON s.contig = w.contig AND s.pos >= w.start AND s.pos < w.start + 500 GROUP BY w.contig, w.start),
k AS (SELECT w.contig, w.start, coalesce(sum(least(ref_n, alt_n)), 0) AS minor, coalesce(sum(greatest(ref_n, alt_n)), 0) AS major FROM w LEFT JOIN c_het s ON s.contig = w.contig AND s.pos >= w.start AND s.pos < w.start + 500 GROUP BY w.contig, w.start)"""


def _maf_windows(spark, d):
    last = v.snps(spark, d).groupBy("contig").agg(F.expr("max(pos) div 500 * 500").alias("last"))
    return last.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(500).cast("long"))).alias("start")).withColumn("end", F.col("start") + 500)


@query(f"WITH {_MAFW} SELECT contig, start, CAST(minor AS BIGINT) AS minor, CAST(major AS BIGINT) AS major, n_snps FROM t")
def maf_sums(spark, d):
    return variants.maf_sums(_maf_windows(spark, d), v.snps(spark, d), 500).select("contig", "start", "minor", "major", "n_snps")


@query(f"""WITH {_MAFW}, x AS (SELECT t.contig, t.start, t.minor::DOUBLE / nullif(t.minor + t.major, 0) AS a, k.minor::DOUBLE / nullif(k.minor + k.major, 0) AS b, n_snps >= 3 AND t.minor + t.major >= 10 AND k.minor + k.major >= 10 AS ok FROM t JOIN k ON t.contig = k.contig AND t.start = k.start)
SELECT contig, start, CASE WHEN ok AND b > 0 THEN round(a / b, 6) END AS maf FROM x""")
def maf_windows(spark, d):
    w = _maf_windows(spark, d)
    t = variants.maf_sums(w, v.snps(spark, d), 500)
    c = variants.maf_sums(w, variants.het_sites(_control(spark, d), 10, control=True), 500)
    return variants.maf_ratio(t, 3, 10, control=c).select("contig", "start", r6("maf"))


@query(f"""WITH {_MAFW}, e AS (SELECT d, sum(exp(lgamma(d + 1) - lgamma(k + 1) - lgamma(d - k + 1) - d * ln(2)) * least(k, d - k) / d) AS exp_maf FROM (SELECT d, unnest(generate_series(0, d)) AS k FROM generate_series(1, 999) g(d)) GROUP BY d),
x AS (SELECT contig, start, minor::DOUBLE / nullif(minor + major, 0) AS a, CAST(floor((minor + major)::DOUBLE / nullif(n_snps, 0)) AS BIGINT) AS d, n_snps >= 3 AND minor + major >= 10 AS ok FROM t)
SELECT contig, start, CASE WHEN ok AND coalesce(exp_maf, 0.491) > 0 THEN round(a / coalesce(exp_maf, 0.491), 6) END AS maf FROM x LEFT JOIN e USING (d)""")
def maf_expected(spark, d):
    """Windows' allele fractions against the expected one of their mean depth."""
    t = variants.maf_sums(_maf_windows(spark, d), v.snps(spark, d), 500)
    return variants.maf_ratio(t, 3, 10, expected=variants.expected_table(spark)).select("contig", "start", r6("maf"))


@query(f"""WITH {v.ITV}, {v.SNP}, i AS (SELECT p_partkey AS id, p_brand, p_partkey * 5 AS low, p_partkey * 5 + p_size * 4 AS high, CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS contig FROM part),
h AS (SELECT i.id, s.pos, s.ref_n, row_number() OVER (PARTITION BY i.id ORDER BY s.ref_n DESC, s.pos) AS n FROM i JOIN v_snp s ON s.contig = i.contig AND s.pos >= i.low AND s.pos <= i.high WHERE s.ref_n >= 2)
SELECT id, pos AS best_pos, ref_n AS best_support FROM h WHERE n = 1""")
def best_breakpoint(spark, d):
    p = v.table(spark, d, "part")
    i = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 5).alias("low"), (F.col("p_partkey") * 5 + F.col("p_size") * 4).alias("high"), F.when(F.col("p_size") % 3 == 0, "F").when(F.col("p_size") % 3 == 1, "O").otherwise("P").alias("contig"))
    return calls.best_breakpoint(i, v.snps(spark, d).select("contig", "pos", F.col("ref_n").alias("support")), "low", "high", bucket=256)


@query(f"""WITH {v.SNP}, i AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS contig, p_partkey * 5 AS start, p_partkey * 5 + 1 + p_size * 4 AS "end" FROM part),
s AS (SELECT contig, pos, alt_n::DOUBLE / (ref_n + alt_n) AS f FROM v_snp WHERE ref_n + alt_n > 0)
SELECT i.contig, i.start, i."end", CAST(count(s.pos) AS INTEGER) AS nsnps, round(coalesce(sum(least(f, 1 - f)), 0), 6) AS maf FROM i LEFT JOIN s ON s.contig = i.contig AND s.pos >= i.start AND s.pos < i."end" GROUP BY i.contig, i.start, i."end" """)
def call_sites(spark, d):
    p = v.table(spark, d, "part")
    i = p.select(F.when(F.col("p_size") % 3 == 0, "F").when(F.col("p_size") % 3 == 1, "O").otherwise("P").alias("contig"), (F.col("p_partkey") * 5).alias("start"), (F.col("p_partkey") * 5 + 1 + F.col("p_size") * 4).alias("end")).distinct()
    return calls.annotate_sites(i, v.snps(spark, d), 256).select("contig", "start", "end", "nsnps", r6("maf"))


# Genotypes -------------------------------------------------------------------------------------------------------

_LIK = """x AS (SELECT c_custkey AS id, CAST(CAST((c_acctbal + 1000) / 1250 AS FLOAT) AS DOUBLE) AS cn, CASE c_nationkey % 3 WHEN 0 THEN 0.12 WHEN 1 THEN 0.2 ELSE 0.5 END::DOUBLE AS sd FROM customer),
g AS (SELECT id, cn, sd, unnest(generate_series(0, 9)) AS g FROM x), p AS (SELECT id, g, exp(-((cn - g) / sd) * ((cn - g) / sd) / 2) / (sd * sqrt(2 * pi())) AS pdf FROM g),
l AS (SELECT id, g, CASE WHEN pdf > 0 THEN log10(pdf / sum(pdf) OVER (PARTITION BY id)) ELSE -1000 END AS l FROM p), b AS (SELECT id, g, greatest(l - max(l) OVER (PARTITION BY id), -1000) AS gl FROM l)"""


def _likely(spark, d):
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal") + 1000) / 1250).alias("cn"), F.when(F.col("c_nationkey") % 3 == 0, 0.12).when(F.col("c_nationkey") % 3 == 1, 0.2).otherwise(0.5).alias("sd"))
    return c.withColumn("l", genotype.likelihoods(F.col("cn"), F.col("sd")))


@query(f"WITH {_LIK} SELECT id, CAST(g AS INTEGER) AS g, round(gl, 4) AS gl FROM b")
def cn_likelihoods(spark, d):
    return _likely(spark, d).select("id", F.posexplode("l.gl").alias("g", "gl")).select("id", "g", F.round("gl", 4).alias("gl"))


@query(f"""WITH {_LIK}, pl AS (SELECT id, round(-10 * gl) AS pl FROM b), s AS (SELECT id, sum(pow(10::DOUBLE, pl / -10)) AS total FROM pl GROUP BY id)
SELECT id, CAST(CASE WHEN total > 1 THEN round(-10 * greatest(log10(CASE WHEN 1 - 1 / total > 0 THEN 1 - 1 / total END), -1000)) ELSE 0 END AS INTEGER) AS gq FROM s""")
def gq(spark, d):
    return _likely(spark, d).select("id", genotype.quality(F.col("l.pl")).alias("gq"))


@query("""WITH x AS (SELECT CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS contig, p_size % 3 AS tid, p_partkey - 20 AS a, p_partkey - 20 + p_size * 40 AS b, p_size AS z, p_partkey AS k FROM part), n AS (SELECT *, max(k) OVER () + 500 AS length FROM x)
SELECT concat('CNV', lpad(CAST(row_number() OVER (ORDER BY tid, a, b) AS VARCHAR), 8, '0')) AS id, contig, CAST(greatest(a, 1) AS INTEGER) AS start, CAST(least(greatest(b, 1), length - 1) AS INTEGER) AS "end",
    CAST(CASE WHEN 10 - z >= 0 THEN -1 ELSE 10 - z END AS INTEGER) AS cipos_lo, CAST(CASE WHEN z - 30 <= 0 THEN 1 ELSE z - 30 END AS INTEGER) AS cipos_hi, CAST(CASE WHEN 25 - z >= 0 THEN -1 ELSE 25 - z END AS INTEGER) AS ciend_lo, CAST(CASE WHEN z - 5 <= 0 THEN 1 ELSE z - 5 END AS INTEGER) AS ciend_hi,
    round(CASE WHEN z % 4 > 0 THEN 0.3 * z / (z % 4) ELSE 0.5 END, 6)::DOUBLE AS maf, round(CASE WHEN z % 4 > 0 THEN 0.3 * z / (z % 4) / 0.4 ELSE 1.0 END, 6)::DOUBLE AS oemaf, z % 2 > 0 AND z % 5 > 0 AS precise FROM n""")
def vcf_info(spark, d):
    """Calls made of the parts, numbered and clamped by the genotyper."""
    p = v.table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") % 3).alias("tid"), (F.col("p_partkey") - 20).alias("start"), (F.col("p_partkey") - 20 + F.col("p_size") * 40).alias("end"))
    z = F.col("p_size")
    c = p.select(
        F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("tid").cast("int") + 1).alias("contig"), "start", "end", (F.col("start") + 10 - z).alias("cipos_lo"), (F.col("start") + z - 30).alias("cipos_hi"), (F.col("end") + 25 - z).alias("ciend_lo"), (F.col("end") + z - 5).alias("ciend_hi"),
        (z % 2).alias("srl"), (z % 5).alias("srr"), (z % 4).alias("nsnps"), (0.3 * z).alias("maf"), (z / 10).alias("cn"), F.lit(1.0).alias("rds"), F.lit(0.0).alias("pty"), F.lit(1.0).alias("mpb"),
    )
    longest = v.table(spark, d, "part").agg((F.max("p_partkey") + 500).alias("length"))
    tids = spark.createDataFrame([("F", 0), ("O", 1), ("P", 2)], "contig string, tid int").join(longest)  # one row
    levels = genotype.level_sd(windows.scale_variance(_ok(spark, d), v.contigs(spark, d), 45))
    g = genotype.genotype(c, levels, tids, control_maf=0.4)
    return g.select("id", "contig", "start", "end", *[F.col(x).cast("int").alias(x) for x in ("cipos_lo", "cipos_hi", "ciend_lo", "ciend_hi")], r6("maf"), r6("oemaf"), "precise")


# Matrices and segments -------------------------------------------------------------------------------------------


@query(f"""WITH {v.MINUTE}, x AS (SELECT contig, pos // 720 * 720 AS start, user_id % 4 AS s, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS value FROM v_min GROUP BY 1, 2, 3)
SELECT contig, start, start + 720 AS "end", max(value) FILTER (WHERE s = 0) AS s0, max(value) FILTER (WHERE s = 1) AS s1, max(value) FILTER (WHERE s = 2) AS s2, max(value) FILTER (WHERE s = 3) AS s3 FROM x GROUP BY contig, start""")
def merge_matrix(spark, d):
    m = v.minutes(spark, d).withColumn("start", F.expr("pos div 720 * 720"))
    rows = m.groupBy("contig", "start", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("sample")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("value")).withColumn("end", F.col("start") + 720)
    return merge.merge_matrix(rows, ["s0", "s1", "s2", "s3"])


@query(f"""WITH {v.DEPTH}, {v.CONTIGS}, h AS (SELECT contig, unnest(generate_series(0, 719)) AS h FROM v_contigs), s AS (SELECT h.contig, h.h, CASE WHEN h.h % 11 <> 3 THEN CAST(sum(d.depth) AS DOUBLE) END AS x FROM h LEFT JOIN v_depth d ON d.contig = h.contig AND d.pos // 60 = h.h GROUP BY h.contig, h.h)
SELECT contig, h AS start, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY contig ORDER BY h ROWS UNBOUNDED PRECEDING), 0) AS x FROM s""")
def ffill_signal(spark, d):
    h = v.contigs(spark, d).select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))).alias("start"))
    s = v.depth(spark, d).groupBy("contig", F.expr("pos div 60").alias("start")).agg(F.sum("depth").cast("double").alias("x"))
    s = h.join(s, ["contig", "start"], "left").withColumn("x", F.when(F.col("start") % 11 != 3, F.col("x")))
    return segment.forward_fill(s, ["x"])


@query(f"""WITH {v.DEPTH}, s AS (SELECT contig, pos // 60 AS h, CAST(sum(depth) AS BIGINT) AS x FROM v_depth GROUP BY contig, pos // 60), k AS (SELECT contig, h // 24 AS day, x, lag(x) OVER (PARTITION BY contig, h // 24 ORDER BY h) AS before FROM s)
SELECT contig, day, CAST(list_sort(list(x))[count(*) // 2 + 1] AS DOUBLE) AS level FROM k WHERE before IS NULL OR before <> x GROUP BY contig, day""")
def run_dedupe_median(spark, d):
    """The level of each day of hours, as of a segment."""
    s = v.depth(spark, d).groupBy("contig", F.expr("pos div 60").alias("h")).agg(F.sum("depth").alias("x")).withColumn("day", F.expr("h div 24"))
    return segment.run_levels(s, ["contig", "day"], "h", ["x"])


@query(f"""WITH {v.DEPTH}, s AS (SELECT contig, pos // 60 AS h, CAST(sum(depth) AS BIGINT) AS x FROM v_depth GROUP BY contig, pos // 60), d AS (SELECT contig, h // 24 AS day, CAST(max(x) AS DOUBLE) AS cn FROM s GROUP BY contig, h // 24)
SELECT s.contig, s.h * 60 AS start, s.h * 60 + 60 AS "end", d.cn FROM s JOIN d ON d.contig = s.contig AND d.day = s.h // 24""")
def expand_segments(spark, d):
    """Hours with the value of their day's segment."""
    h = v.depth(spark, d).groupBy("contig", F.expr("pos div 60").alias("h")).agg(F.sum("depth").alias("x"))
    days = h.groupBy("contig", F.expr("h div 24").alias("day")).agg(F.max("x").cast("double").alias("cn")).select("contig", (F.col("day") * 1440).alias("start"), (F.col("day") * 1440 + 1440).alias("end"), "cn")
    return segment.expand(days, h.select("contig", (F.col("h") * 60).alias("start"), (F.col("h") * 60 + 60).alias("end")), 1440)


@query("""WITH c AS (SELECT event_id, event_type AS contig, value, CASE WHEN lag(event_type) OVER (ORDER BY event_id) <> event_type THEN 1 ELSE 0 END AS new FROM events), r AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM c)
SELECT CAST(run AS BIGINT) AS run, contig, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY run, contig""")
def contig_runs(spark, d):
    """Stretches of equal event types in the order of events, as of contigs in a file of splits of 1,024 lines."""
    e = v.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("contig"))
    return segment.contig_runs(e, shift=10).groupBy("run", "contig").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


_AXIS = f"""{v.MINUTE}, x AS (SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE 'chr' END || CASE WHEN user_id % 25 = 23 THEN 'X' WHEN user_id % 25 = 24 THEN 'M' ELSE CAST(user_id % 25 + 1 AS VARCHAR) END AS contig, pos // 720 * 720 AS start, value FROM v_min),
w AS (SELECT contig, start, start + 720 AS "end", count(*)::DOUBLE AS cn, CASE WHEN count(*) % 5 > 0 THEN (count(*) % 5) / 2.0::DOUBLE END AS maf FROM x GROUP BY contig, start),
nm AS (SELECT i AS place, CASE WHEN i = 22 THEN 'X' ELSE CAST(i + 1 AS VARCHAR) END AS short FROM generate_series(0, 22) g(i)),
pick AS (SELECT CASE WHEN count_if(contig IN (SELECT 'chr' || short FROM nm)) > count_if(contig IN (SELECT short FROM nm)) THEN 'chr' ELSE '' END AS prefix FROM w),
n AS (SELECT place, prefix || short AS contig FROM nm, pick), l AS (SELECT n.contig, place, max("end") AS length FROM n JOIN w ON w.contig = n.contig GROUP BY n.contig, place),
o AS (SELECT *, coalesce(sum(length) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
s AS (SELECT contig, min(start) AS start, max("end") AS "end", avg(cn) AS cn, avg(maf) AS maf FROM w GROUP BY contig), m AS (SELECT avg(CASE WHEN maf IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5 AS with_maf FROM w JOIN n USING (contig)),
f AS (SELECT 'window' AS kind, * FROM w UNION ALL SELECT 'segment', * FROM s)"""


@query(f"""WITH {_AXIS} SELECT kind, f.contig, CAST(place AS INTEGER) AS place, start, "end", CAST(start + off AS BIGINT) AS x, CAST("end" + off AS BIGINT) AS x_end, round(CASE WHEN cn BETWEEN 0 AND 8 THEN cn END, 6) AS cn, round(CASE WHEN with_maf AND maf BETWEEN 0 AND 1.5 THEN maf END, 6) AS maf
FROM f JOIN o USING (contig), m""")
def genome_plot(spark, d):
    """Windows and segments of events on one axis; users stand for contigs, most with long names."""
    u = F.col("user_id")
    name = F.concat(F.when(u % 7 == 0, "").otherwise("chr"), F.when(u % 25 == 23, "X").when(u % 25 == 24, "M").otherwise((u % 25 + 1).cast("string")))
    w = v.minutes(spark, d).groupBy(name.alias("contig"), F.expr("pos div 720 * 720").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    w = w.select("contig", "start", (F.col("start") + 720).alias("end"), F.col("n").cast("double").alias("cn"), F.when(F.col("n") % 5 > 0, (F.col("n") % 5) / 2).alias("maf"))
    s = w.groupBy("contig").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("cn").alias("cn"), F.avg("maf").alias("maf"))
    out = axis.plot_frame(w, s)
    return out.select("kind", "contig", "place", "start", "end", "x", "x_end", r6("cn"), r6("maf"))


def _hourly(spark, d):
    """Hourly counts of two user groups as a two-column signal."""
    return v.minutes(spark, d).groupBy("contig", F.expr("pos div 60").alias("start")).agg(F.count_if(F.col("user_id") % 2 == 0).cast("double").alias("a"), F.count_if(F.col("user_id") % 2 == 1).cast("double").alias("b")).withColumn("end", F.col("start") + 1)


@query()
def segment_lars_dp(spark, d):
    return segment.segment(_hourly(spark, d), ["a", "b"])


BAND = 12


def _breaks(spark, d):
    """Hours as places: events of even and odd minutes as the two tracks."""
    return v.depth(spark, d).groupBy("contig", F.expr("cast(pos div 60 as int)").alias("pos")).agg(F.sum(F.when(F.col("pos") % 2 == 0, F.col("depth")).otherwise(0)).alias("left_n"), F.sum(F.when(F.col("pos") % 2 == 1, F.col("depth")).otherwise(0)).alias("right_n"))


@query()
def nms_peaks(spark, d):
    return calls.split_peaks(_breaks(spark, d), BAND, 100)


CALL_SIZE = 500


@query()
def cnv_calls(spark, d):
    return calls.cnv_calls(_ok(spark, d), CALL_SIZE, block=10_000, ranks=20_000)


@query("SELECT doc_id, (text LIKE '%N%' OR text LIKE '%n%') AS holds_n FROM documents")
def n_content(spark, d):
    return v.table(spark, d, "documents").select("doc_id", stats.holds_n(F.col("text")).alias("holds_n"))


@query("""WITH c AS (SELECT event_id, unnest(string_split(props, '')) AS ch, length(props) AS n FROM events), f AS (SELECT event_id, ch, count(*)::DOUBLE / max(n) AS p FROM c GROUP BY event_id, ch) SELECT event_id, round(-sum(p * log2(p)), 6) AS bits FROM f GROUP BY event_id""")
def entropy(spark, d):
    return v.table(spark, d, "events").select("event_id", F.round(stats.entropy(F.col("props")), 6).alias("bits"))


@query("SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def true_median(spark, d):
    return v.table(spark, d, "events").groupBy("event_type").agg(stats.true_median("value").alias("median"))


@query(f"""WITH {v.SNP}, p AS (SELECT DISTINCT alt_n AS k, ref_n + alt_n AS n FROM v_snp), t AS (SELECT k, n, unnest(generate_series(0, n)) AS i FROM p),
m AS (SELECT k, n, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS pi, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) AS pk FROM t),
r AS (SELECT k, n, least(sum(CASE WHEN pi <= pk * exp(1e-7) THEN pi ELSE 0 END), 1) AS p FROM m GROUP BY k, n)
SELECT contig, pos, round(r.p, 6) AS p FROM v_snp JOIN r ON r.k = alt_n AND r.n = ref_n + alt_n""")
def binomial_test(spark, d):
    s = v.snps(spark, d).withColumn("n", F.col("ref_n") + F.col("alt_n"))
    return variants.binomial_test(s, "alt_n", "n").select("contig", "pos", r6("p"))
