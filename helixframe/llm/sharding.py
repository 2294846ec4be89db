"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: the id picks the shard by
rendezvous (the shard with the largest hash of id and shard number, so that one
more shard only takes rows into itself), and a hash of the whole record picks
one of the shard's buckets, as many as keep a bucket at ``bucket_bytes``. Pass
two gathers each bucket, Fisher-Yates shuffles it (Spark's seeded ``shuffle``)
and numbers its rows behind those of the shard's earlier buckets; ``write_shards``
writes them in shard=N folders.

Nulls: a null text counts one byte, with CRC 0; rows with a null id share a
shard. Rows that repeat an id share its shard; each has a slot of its own.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, text_key, work_path

BUCKET_BYTES = 16_000_000
#: Columns that sharding adds; columns of the input with these names give way to them.
ADDED = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    marks = [F.xxhash64(F.lit(seed), F.lit(j), key) for j in range(n_shards)]
    if n_shards == 1:
        return F.lit(0)
    return (F.array_position(F.array(*marks), F.greatest(*marks)) - 1).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def record_bytes(docs: DataFrame, carry: list[str]) -> Column:
    """About the bytes of a row: its carried texts, and 64 for the rest."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in carry if docs.schema[c].dataType.typeName() in ("string", "binary")]
    nested = [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in carry if docs.schema[c].dataType.typeName() in ("array", "map", "struct")]
    return sum([x.cast("long") for x in texts + nested], F.lit(64).cast("long"))


def shard_rows(docs: DataFrame, carry: list[str], n_shards: int = 16, bucket_bytes: int = BUCKET_BYTES, seed: int = 29) -> DataFrame:
    """The columns named in carry, with size, text_crc32, law, shard, slot and grown_shard."""
    carry = [c for c in carry if c.lower() not in ADDED]
    size, crc = record_size(F.col("text")), F.crc32(F.coalesce(F.col("text"), F.lit("")))
    total = docs.agg(F.sum(record_bytes(docs, carry))).first()[0] or 0
    per_shard = max(1, -(-int(total) // (bucket_bytes * n_shards)))
    # Rows of one mark are equal in all that is carried, so their order among themselves doesn't matter.
    plain = [F.col(f"`{c}`") for c in carry if not docs.schema[c].dataType.typeName() in ("map", "variant")]
    mark = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), text_key(F.col("text")), *plain)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), size.alias("size"), crc.alias("crc"), mark.alias("mark"),
        rendezvous(F.col("doc_id"), n_shards, seed).alias("shard"), rendezvous(F.col("doc_id"), n_shards + 1, seed).alias("grown"),
    ).withColumn("bucket", F.pmod(F.xxhash64("mark"), F.lit(per_shard)).cast("int"))
    if "text" not in carry:
        rows = materialize(rows, "shard-scatter")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    dealt = rows.repartition(n_shards * per_shard, "shard", "bucket").sortWithinPartitions("shard", "bucket", "mark", "crc", "size")
    packed = dealt.groupBy("shard", "bucket").agg(F.collect_list(F.struct("row", "size", "crc", "grown")).alias("rows"))
    mixed = packed.select("shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "r"))
    out = mixed.join(base, ["shard", "bucket"])
    return out.select("r.row.*", F.col("r.size").alias("size"), F.col("r.crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), F.col("r.grown").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, bucket_bytes: int = BUCKET_BYTES, seed: int = 29) -> None:
    """Write all of docs in shard=N folders, in shuffled order: each file's rows are sorted by slot."""
    shard_rows(docs, docs.columns, n_shards, bucket_bytes, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharding_report(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write the shards and describe each record as it is read back from them."""
    spark = docs.sparkSession
    path = path or work_path(spark, "shards")
    write_shards(docs, path, **kw)
    names = [c for c in docs.columns if c.lower() not in ADDED]
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("law", "string").add("slot", "long").add("grown_shard", "integer").add("shard", "integer")
    back = spark.read.schema(schema).parquet(path)
    size, crc = record_size(F.col("text")), F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return back.select("doc_id", size.alias("size"), crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")
