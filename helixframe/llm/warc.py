"""WARC archives: writing pages as records, and reading records back by boundary-chain verification.

Writing: a record a page through Spark's text writer, whose line separator is the
record's end, so that files are committed and retried like any other output.
Of pages with equal payloads the smallest page_id is the response that
holds the payload; the others are revisit records with an empty block, their
payload's digest and the page they refer to. Who comes first is found on (page_id,
SHA-1) alone.

Reading: the text reader splits files at the version line, so each piece starts
at a candidate record. Tasks take from each piece its length and, from its
header, the offset where the record's successor must start. Per file, from these
numbers alone (24 bytes a candidate), pointer jumping from the file's
start marks the records on the chain; a version line inside a payload isn't on
it. Pieces between two marked records are put together again.

A piece is known by file, split and its place in the scan. How files are cut into
splits follows the cores at hand, so the scan happens once and its pieces are
written; all that follows reads them from there, and a marked piece that isn't
among them raises an error. Compressed files (.gz) are one split each.

Nulls: a null html is an empty payload, empty payloads count as equal; a null url is left out.
Pages that repeat the smallest page_id of a payload are all responses, as are
those with a null page_id if no other id has that payload (else they
are revisits). Damaged files: records after a broken link are not on the chain and are
dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, work_path

VERSION, END = "WARC/1.0\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Pieces of records that span several are found again by broadcast up to so many, beyond by shuffle.
BROADCAST_PIECES = 100_000
#: Digests that several pages share are broadcast up to so many (about 50 bytes each), beyond joined by shuffle.
BROADCAST_DIGESTS = 200_000
#: Rows of one digest are dealt out over so many tasks.
SALTS = 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """40 hex digits in base 32: ten of them are eight, whose digits 0-9A-V stand for the alphabet's."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def join_salted(rows: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join of rows with a table of one row a key; the rows of a hot key are dealt out by another column."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line breaks in a value become spaces."""
    clean = F.regexp_replace(value.cast("string"), "[\\r\\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """pages: page_id, url, html."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("hex", F.sha1(F.col("payload").cast("binary")))
    keys = materialize(p.select("page_id", "hex"), "warc-keys")
    repeated = keys.groupBy("hex").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeated = materialize(repeated, "warc-repeated")
    if repeated.count() <= BROADCAST_DIGESTS:
        p = p.join(F.broadcast(repeated), "hex", "left")
    else:
        marks = join_salted(keys.distinct(), repeated, "hex", "page_id").withColumnsRenamed({"page_id": "_id", "hex": "_hex"})
        p = p.join(marks, p["page_id"].eqNullSafe(marks["_id"]) & (p["hex"] == marks["_hex"]), "left").drop("_id", "_hex")
    p = p.withColumn("first", F.coalesce("first", "page_id")).withColumn("digest", base32(F.col("hex")))
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    mark = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", "digest"))
    uuid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(mark, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(VERSION), F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")), _field("WARC-Record-ID", uuid), F.lit(f"WARC-Date: {DATE}\r\n"),
        _field("WARC-Target-URI", F.col("url")), _field("X-Page-ID", F.col("page_id")), F.when(again, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(F.lit("")),
        _field("X-Refers-To-Page-ID", F.when(again, F.col("first"))), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, octets, size, value), from one scan, written. size: the bytes to where the successor must start, by the header."""
    text = spark.read.option("lineSep", VERSION).text(path)
    value = F.col("value")
    size = F.when(F.instr(value, END) > 0, F.lit(len(VERSION) + 2 * len(END)) + F.octet_length(_head(value)) + _length(value)).cast("long")
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.octet_length(value).alias("octets"), size.alias("size"), "value")
    return materialize(pieces, "warc-pieces")


def _head(value: Column) -> Column:
    return F.substring_index(value, END, 1)


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(F.length(found) > 0, found)


def _length(value: Column) -> Column:
    return F.try_to_number(_header(_head(value), "Content-Length"), F.lit("9" * 15)).cast("long")


def mark_chain(off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """off: sorted offsets of candidates; size: bytes to each one's successor, -1 if it has no valid header. True for those reachable from offset 0."""
    n = off.size
    reached = np.zeros(n + 1, bool)
    if not n or off[0] != 0:
        return reached[:n]
    successor = off + size
    jump = np.searchsorted(off, successor)
    jump = np.append(np.where((size >= 0) & (jump < n) & (off[np.minimum(jump, n - 1)] == successor), jump, n), n)
    reached[0] = True
    while True:
        ahead = jump[np.flatnonzero(reached)]
        if reached[ahead].all():
            return reached[:n] & (size >= 0)
        reached[ahead] = True
        jump = jump[jump]


def _chains(candidates: DataFrame) -> DataFrame:
    """(file, split, seq, octets, size) -> (file, split, seq, record, n_pieces) of the pieces that belong to a record on the chain."""

    def per_file(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["split", "seq"], ignore_index=True)
        octets = pdf["octets"].to_numpy(np.int64)
        # The first piece is what stands before the first version line: nothing in a sound file.
        off = octets[0] + np.r_[0, np.cumsum(octets[1:] + len(VERSION))][:-1]
        rows = pdf.iloc[1:].reset_index(drop=True)
        reached = mark_chain(off, rows["size"].fillna(-1).to_numpy(np.int64))
        at = np.flatnonzero(reached)
        owner = np.searchsorted(at, np.arange(len(rows)), side="right") - 1
        rows = rows.assign(owner=owner)[owner >= 0]
        # Pieces beyond a record's own end are no part of it.
        own = rows["owner"].to_numpy()
        inside = off[rows.index] < off[at[own]] + pdf["size"].iloc[1:].to_numpy(np.float64)[at[own]]
        rows, own = rows[inside], own[inside]
        n = np.bincount(own, minlength=at.size)
        return pd.DataFrame({"file": rows["file"], "split": rows["split"], "seq": rows["seq"], "record": off[at[own]], "n_pieces": n[own]})

    return candidates.groupBy("file").applyInPandas(per_file, "file string, split bigint, seq bigint, record bigint, n_pieces bigint")


def _records(pieces: DataFrame, keep_payload: bool) -> DataFrame:
    """pieces (file, record, value) that are whole records -> their fields."""
    head = _head(F.col("value"))
    payload = F.substring(F.col("value").cast("binary"), F.octet_length(head) + len(END) + 1, F.col("_n").cast("int"))
    parsed = pieces.withColumn("_n", _length(F.col("value"))).select(
        "file", "record", _header(head, "WARC-Type").alias("record_type"), _header(head, "X-Page-ID").alias("page_id"), _header(head, "WARC-Target-URI").alias("url"), _header(head, "X-Refers-To-Page-ID").alias("refers_to"),
        F.regexp_replace(_header(head, "WARC-Payload-Digest"), "^sha1:", "").alias("said_digest"), F.col("_n").alias("payload_bytes"), payload.alias("payload"),
    )
    parsed = parsed.withColumn("payload_digest", base32(F.sha1("payload")))
    return parsed if keep_payload else parsed.drop("payload")


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records on each file's chain: file, record (offset), header fields, payload_bytes, payload_digest and, if wanted, payload."""
    pieces = _pieces(spark, path)
    owners = materialize(_chains(pieces.select("file", "split", "seq", "octets", "size")), "warc-chains")
    key = ["file", "split", "seq"]
    lost = owners.join(pieces.select(*key), key, "left_anti").count()
    if lost:
        raise RuntimeError(f"{lost} pieces of records on the chain are not among the pieces read")
    pieces = pieces.select(*key, "value")
    several = owners.filter("n_pieces > 1")
    few = several.count() <= BROADCAST_PIECES
    parts = pieces.join(F.broadcast(several) if few else several, key)
    whole = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "seq", "value"))).alias("x")).select("file", "record", F.array_join("x.value", VERSION).alias("value"))
    ones = owners.filter("n_pieces = 1").select(*key, "record")
    if keep_payload:
        single = _records(pieces.join(ones, key), True)
    else:
        # The digests are taken in the scan, so that payloads aren't shuffled.
        digests = _records(pieces.withColumn("record", F.struct(*key)), False)
        single = digests.withColumnRenamed("record", "_at").join(ones.select(F.struct(*key).alias("_at"), "record"), "_at").drop("_at").select("file", "record", *digests.columns[2:])
    return single.unionByName(_records(whole, keep_payload))


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages to archives, read them back and describe each record. A revisit's size is that of the payload it stands for."""
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    r = read_warc(spark, path, keep_payload=False)
    r = materialize(r.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "said_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")), "warc-records")
    held = r.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_bytes")).withColumnRenamed("payload_digest", "_digest")
    again = join_salted(r.filter("record_type = 'revisit'").withColumn("_digest", F.col("said_digest")), held, "_digest", "page_id", "left")
    again = again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    return r.filter("record_type = 'response'").select(*again.columns).unionByName(again)
