"""Reader of BAM files: the canonical alignments, split by split."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from helixframe.schemas import ALIGNMENTS, CONTIGS
from helixframe.sources import bgzf

# Fixed values of the format: the letters of 4-bit bases and of CIGAR operations, and the bytes of a tag's number.
BASES, CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
HEAD = 36
_LETTERS = str.maketrans("0123456789abcdef", BASES)
_OPS = np.array(list(CIGAR))


def read_header(path: str) -> tuple[list[tuple[str, int]], int]:
    """[(contig, length)] and the virtual offset of the first record."""
    where, name = bgzf.locate(path)
    with where.open_input_file(name) as f:
        s = bgzf.Stream(f, 0, bgzf.size_of(path))

        def take(at: int, n: int) -> bytes:
            if not s.has(at + n):
                raise ValueError("the file ends within its header")
            return s.get(at, n)

        if take(0, 4) != b"BAM\1":
            raise ValueError(f"not a BAM file: {path}")
        at = 8 + struct.unpack("<i", take(4, 4))[0]
        n, at, contigs = struct.unpack("<i", take(at, 4))[0], at + 4, []
        for _ in range(n):
            k = struct.unpack("<i", take(at, 4))[0]
            contigs.append((take(at + 4, k)[:-1].decode(), struct.unpack("<i", take(at + 4 + k, 4))[0]))
            at += 8 + k
        return contigs, s.virtual(at) if s.has(at + 1) else s.next << 16


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(read_header(path)[0])], CONTIGS)


def length(head: bytes) -> int:
    return 4 + struct.unpack_from("<i", head)[0]


def well_formed(lengths: list[int]):
    """A test of a record's first HEAD + 1 bytes at least."""

    def check(h: bytes) -> bool:
        size, tid, pos, name, _, _, ops, _, seq, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", h)
        if not (name >= 1 and 0 <= seq <= size and -1 <= tid < len(lengths) and -1 <= mtid < len(lengths)):
            return False
        if size < 32 + name + 4 * ops + (seq + 1) // 2 + seq or size > 1 << 28:
            return False
        return -1 <= pos and -1 <= mpos and (tid < 0 or pos < lengths[tid]) and (mtid < 0 or mpos < lengths[mtid])

    return check


def long_cigar(tags: bytes) -> np.ndarray | None:
    """The operations in the tag that holds those beyond 65,535."""
    at = 0
    while at + 3 <= len(tags):
        tag, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(0, at) + 1
        elif kind == "B":
            unit, n = chr(tags[at]), struct.unpack_from("<I", tags, at + 1)[0]
            if tag == b"CG" and unit == "I":
                return np.frombuffer(tags, "<u4", n, at + 5)
            at += 5 + n * TAG_BYTES[unit]
        else:
            at += TAG_BYTES[kind]
    return None


def _lists(parts: list, values: pa.Array, missing: list[bool] | None = None) -> pa.Array:
    offsets = np.cumsum([0, *[len(p) for p in parts]]).astype(np.int32)
    mask = pa.array(missing) if missing is not None else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def decode(records: list[bytes], number: int) -> pa.RecordBatch:
    fixed, names, ops, seqs, quals = [], [], [], [], []
    for r in records:
        f = struct.unpack_from("<iiBBHHHiiii", r, 4)  # tid, pos, name, mapq, bin, ops, flag, l_seq, mtid, mpos, isize
        fixed.append(f)
        at = HEAD + f[2]
        names.append(r[HEAD : at - 1].decode())
        op = np.frombuffer(r, "<u4", f[5], at)
        at += 4 * f[5]
        n = f[7]
        seqs.append(r[at : at + (n + 1) // 2].hex().translate(_LETTERS)[:n] if n else None)
        at += (n + 1) // 2
        quals.append(r[at : at + n] if n and r[at] != 0xFF else None)
        if f[5] == 2 and op[0] == (n << 4 | 4) and op[1] & 15 == 3:
            more = long_cigar(r[at + n :])
            op = op if more is None else more
        ops.append(op)
    col = lambda i: pa.array([f[i] for f in fixed], pa.int32())
    flat = np.concatenate(ops) if ops else np.zeros(0, np.uint32)
    cigar = pa.StructArray.from_arrays([pa.array(_OPS[flat & 15].tolist(), pa.string()), pa.array((flat >> 4).astype(np.int32))], ["op", "len"])
    scores = pa.array(np.frombuffer(b"".join(q or b"" for q in quals), np.int8))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(number, number + len(records))), pa.array(names), col(6), col(0), col(1), col(3), _lists(ops, cigar), col(8), col(9), col(10), col(7), pa.array(seqs, pa.string()), _lists([q or b"" for q in quals], scores, [q is None for q in quals])],
        ["ord", "qname", "flag", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "isize", "l_qseq", "seq", "qual"],
    )


def read_bam(spark: SparkSession, path: str, split_bytes: int = bgzf.SPLIT_BYTES) -> DataFrame:
    """Alignments of a BAM file, in the canonical schema; ord grows with the record's place."""
    contigs, first = read_header(path)
    return bgzf.read_splits(spark, path, first, HEAD, length, well_formed([n for _, n in contigs]), decode, ALIGNMENTS, split_bytes)
