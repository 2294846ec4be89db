"""Genomic stand-ins made from the shared test tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType

#: Minutes of the events' month; hours of the day are strata; every seventh minute is not unique.
MINUTES, ORIGIN, ORIGIN_US = 43_200, "2024-01-01", 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def align(spark, sf_dir) -> DataFrame:
    """Reads: one row for each (order, line)."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_shipdate").alias("d"), F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p"))
    return per.select(
        F.col("l_orderkey").alias("qname"), (F.col("s") % 5).cast("int").alias("tid"), F.datediff(F.col("d").cast("date"), F.lit("1995-01-01").cast("date")).alias("pos"),
        F.col("q").cast("int").alias("mapq"), F.col("l_linenumber").alias("flag"), (F.lit(20) + F.col("p") % 30).cast("int").alias("alen"),
    )


ALIGN = """v_align AS (SELECT l_orderkey AS qname, CAST(min(l_suppkey) % 5 AS INTEGER) AS tid, CAST(date_diff('day', DATE '1995-01-01', CAST(min(l_shipdate) AS DATE)) AS INTEGER) AS pos,
    CAST(min(l_quantity) AS INTEGER) AS mapq, l_linenumber AS flag, CAST(20 + min(l_partkey) % 30 AS INTEGER) AS alen FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def minutes(spark, sf_dir) -> DataFrame:
    """Event occurrences: contig, pos."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("contig"), F.expr("event_id"), "user_id", "value", ((us - ORIGIN_US) / 60_000_000).alias("m")).select("contig", F.floor("m").cast("long").alias("pos"), "event_id", "user_id", "value")


MINUTE = f"v_min AS (SELECT event_type AS contig, (epoch_us(ts) - {ORIGIN_US}) // 60000000 AS pos, event_id, user_id, value FROM events)"
DEPTH = MINUTE + ", v_depth AS (SELECT contig, pos, least(count(*), 65534) AS depth FROM v_min GROUP BY contig, pos)"


def depth(spark, sf_dir) -> DataFrame:
    from helixframe.operators.reads import depth as count

    return count(minutes(spark, sf_dir).select("contig", "pos"))


def contigs(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("contig")).distinct()
    return names.select("contig", F.lit(MINUTES).alias("length"))


CONTIGS = f"v_contigs AS (SELECT DISTINCT event_type AS contig, {MINUTES} AS length FROM events)"


def base(spark, sf_dir) -> DataFrame:
    """Every minute of every contig: contig, pos, gc (hour of the day), uniq (1 or 0), depth."""
    d = depth(spark, sf_dir)
    every = contigs(spark, sf_dir).select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MINUTES - 1).cast("long"))).alias("pos"))
    return every.join(d, ["contig", "pos"], "left").select("contig", "pos", F.expr("cast((pos div 60) % 24 as int)").alias("gc"), F.when(F.col("pos") % 7 != 0, 1).otherwise(0).alias("uniq"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


BASE = DEPTH + ", " + CONTIGS + f""", v_base AS (SELECT e.contig, e.pos, CAST((e.pos // 60) % 24 AS INTEGER) AS gc, CASE WHEN e.pos % 7 <> 0 THEN 1 ELSE 0 END AS uniq, CAST(coalesce(d.depth, 0) AS BIGINT) AS depth
    FROM (SELECT contig, unnest(generate_series(0, {MINUTES - 1})) AS pos FROM v_contigs) e LEFT JOIN v_depth d ON e.contig = d.contig AND e.pos = d.pos)"""


def sequence(spark, sf_dir) -> DataFrame:
    """Texts of the documents as sequence blocks: contig (doc_id), length, block_start, bases."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("contig"), F.length("text").cast("long").alias("length"), F.lit(0).alias("block_start"), F.col("text").alias("bases"))


SEQUENCE = """v_seq AS (SELECT contig, length, pos - 1 AS pos, cs[pos] AS ch FROM (SELECT contig, length, cs, unnest(generate_series(1, len(cs))) AS pos
    FROM (SELECT CAST(doc_id AS VARCHAR) AS contig, CAST(length(text) AS BIGINT) AS length, string_split(text, '') AS cs FROM documents)))"""


def part_intervals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("contig"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"))


ITV = "v_itv AS (SELECT p_brand AS contig, p_partkey AS start, p_partkey + p_size AS \"end\" FROM part)"


def snps(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("contig"), F.col("o_orderkey").alias("pos"), (F.floor("o_totalprice") % 60).cast("long").alias("ref_n"), (F.floor(F.col("o_totalprice") / 7) % 60).cast("long").alias("alt_n"))


SNP = "v_snp AS (SELECT o_orderstatus AS contig, o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) % 60 AS ref_n, CAST(floor(o_totalprice / 7) AS BIGINT) % 60 AS alt_n FROM orders)"


#: Days that a genome made of ship dates has; letters of its bases and of its reads.
DAYS, HEX, LETTERS = 2_560, "0123456789abcdef", "ACGTACGTACGTACGT"


def ship_days(spark, sf_dir) -> DataFrame:
    """Lines a (supplier group, ship day): tid, pos, n."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("int").alias("tid"), day.alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def genome_contigs(spark, sf_dir) -> DataFrame:
    return spark.range(5).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("contig"), F.lit(DAYS).alias("length"))


def genome(spark, sf_dir, lines: DataFrame | None = None) -> DataFrame:
    """Sequence blocks of 64 bases: a day's base is that of its number of lines modulo 4, N on days without any. lines: ship_days() where they are at hand."""
    days = spark.range(DAYS).select(F.col("id").cast("int").alias("pos"))
    every = genome_contigs(spark, sf_dir).join(days).join(lines or ship_days(spark, sf_dir), ["tid", "pos"], "left")  # five contigs
    base = F.coalesce(F.substring(F.lit("ACGT"), (F.col("n") % 4 + 1).cast("int"), F.lit(1)), F.lit("N"))
    blocks = every.groupBy("contig", F.expr("pos div 64 * 64").cast("int").alias("block_start")).agg(F.array_sort(F.collect_list(F.struct("pos", base.alias("base")))).alias("b"))
    return blocks.select("contig", "block_start", F.array_join("b.base", "").alias("bases"))


def sites(spark, sf_dir, lines: DataFrame | None = None) -> DataFrame:
    """A site on each day whose number of lines isn't divisible by 3: REF the base, or another one on days divisible by 10. lines: as in genome()."""
    s = (lines or ship_days(spark, sf_dir)).filter("n % 3 <> 0 AND pos >= 0")
    letter = lambda k: F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
    wrong = F.when(F.col("pos") % 10 == 0, 1).otherwise(0)
    return s.select(F.concat(F.lit("g"), F.col("tid").cast("string")).alias("contig"), "pos", letter(F.col("n") + wrong).alias("ref"), letter(F.col("n") + wrong + 1 + F.col("pos") % 3).alias("alt"))


@F.arrow_udf(ArrayType(ByteType()))
def hashed_qualities(keys: pa.Array) -> pa.Array:
    """Twice each hexadecimal digit of the MD5 sums of q0key and q1key. As array functions with a lambda these take some 30 us for 64 digits."""
    named = [k.encode() for k in keys.to_pylist()]
    digits = np.frombuffer(b"".join([md5(salt + k).digest() for k in named for salt in (b"q0", b"q1")]), np.uint8)
    values = (np.stack([digits >> 4, digits & 15], 1).ravel() * 2).astype(np.int8)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(named) + 1, dtype=np.int32) * 64), pa.array(values))


def records(spark, sf_dir) -> DataFrame:
    """The reads of align() with sequences and qualities from hashes, in three shapes of CIGAR, in order of place. Lines 1 and 2, 3 and 4, ... of an order are pairs where they share a contig."""
    a = align(spark, sf_dir).withColumnRenamed("flag", "line").withColumn("half", F.expr("(line + 1) div 2"))
    two = Window.partitionBy("qname", "half")
    other = lambda c: (F.sum(c).over(two) - F.col(c)).cast("int")
    key = F.concat_ws("-", F.col("qname").cast("string"), F.col("line").cast("string"))
    spelt = lambda salt: F.concat(*[F.md5(F.concat(F.lit(f"{salt}{i}"), key)) for i in range(2)])
    piece = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("int").alias("len"))
    n = F.col("alen")
    cigar = F.when(F.col("line") % 3 == 0, F.array(piece("M", n))).when(F.col("line") % 3 == 1, F.array(piece("S", F.lit(5)), piece("M", n - 10), piece("I", F.lit(3)), piece("M", F.lit(10)))).otherwise(F.array(piece("M", F.lit(8)), piece("D", F.lit(4)), piece("=", n - 18), piece("N", F.lit(6))))
    mate = F.col("_n") == 2
    here = mate & (other("tid") == F.col("tid"))
    reads = a.withColumn("_n", F.count(F.lit(1)).over(two)).select(
        (F.shiftleft(F.col("pos").cast("long"), 33) + F.col("qname") * 8 + F.col("line")).alias("ord"), (F.col("qname") * 8 + F.col("half")).cast("string").alias("qname"),
        (F.when(mate, 1 + F.when(F.col("line") % 2 == 1, 64 + 32).otherwise(128 + 16)).otherwise(0) + F.when(F.col("mapq") == 7, 1024).otherwise(0)).cast("int").alias("flag"),
        "tid", "pos", "mapq", cigar.alias("cigar"), F.when(mate, other("tid")).otherwise(F.lit(-1)).alias("mtid"), F.when(mate, other("pos")).otherwise(F.lit(-1)).alias("mpos"),
        F.when(here, other("pos") - F.col("pos")).otherwise(F.lit(0)).cast("int").alias("isize"), n.alias("l_qseq"), F.translate(spelt("s"), HEX, LETTERS).alias("seq"),
        hashed_qualities(key).alias("qual"), "line", "alen",
    )
    return reads


#: v_days, v_genome (a row a base), v_sites and v_records, whose CIGAR is left to the queries.
GENOME = f"""v_days AS (SELECT CAST(l_suppkey % 5 AS INTEGER) AS tid, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS pos, count(*) AS n FROM lineitem GROUP BY 1, 2),
v_genome AS (SELECT concat('g', t.tid) AS contig, p.pos, coalesce(substr('ACGT', n % 4 + 1, 1), 'N') AS base FROM (SELECT unnest(generate_series(0, 4)) AS tid) t CROSS JOIN (SELECT unnest(generate_series(0, {DAYS - 1})) AS pos) p LEFT JOIN v_days d ON d.tid = t.tid AND d.pos = p.pos),
v_sites AS (SELECT concat('g', tid) AS contig, pos, substr('ACGT', (n + w) % 4 + 1, 1) AS ref, substr('ACGT', (n + w + 1 + pos % 3) % 4 + 1, 1) AS alt FROM (SELECT *, CASE WHEN pos % 10 = 0 THEN 1 ELSE 0 END AS w FROM v_days WHERE n % 3 <> 0 AND pos >= 0))"""
RECORDS = ALIGN + f""", v_two AS (SELECT *, (flag + 1) // 2 AS half, count(*) OVER two AS n, sum(tid) OVER two - tid AS otid, sum(pos) OVER two - pos AS opos FROM v_align WINDOW two AS (PARTITION BY qname, (flag + 1) // 2)),
v_records AS (SELECT pos * 8589934592 + qname * 8 + flag AS ord, CAST(qname * 8 + half AS VARCHAR) AS qname, flag AS line, n = 2 AS mate, CASE WHEN n = 2 THEN 1 + CASE WHEN flag % 2 = 1 THEN 96 ELSE 144 END ELSE 0 END + CASE WHEN mapq = 7 THEN 1024 ELSE 0 END AS flag,
    tid, pos, mapq, alen, CASE WHEN n = 2 THEN otid ELSE -1 END AS mtid, CASE WHEN n = 2 THEN opos ELSE -1 END AS mpos, CASE WHEN n = 2 AND otid = tid THEN opos - pos ELSE 0 END AS isize, alen AS l_qseq,
    translate(concat(md5(concat('s0', qname, '-', flag)), md5(concat('s1', qname, '-', flag))), '{HEX}', '{LETTERS}') AS seq, concat(md5(concat('q0', qname, '-', flag)), md5(concat('q1', qname, '-', flag))) AS q FROM v_two)"""
