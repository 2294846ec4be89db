"""BGZF files: gzip blocks of at most 64 KiB that state their own size, read in parallel and written.

A file of length-prefixed records is read in splits of compressed bytes. Planning
finds in each split the first block (its checksum must hold) and in it the first place
from which a chain of well-formed records runs. Reading starts there and must end
exactly on the next split's start, so a wrong guess is an error and never
a wrong row; a start that planning misses is read by the split before.
Tasks open files by ``pyarrow.fs``, a plain path or a URI that all executors reach.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08\x04"
#: The empty block that ends a file, a fixed value of the format.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of content a block, when writing.
CONTENT = 65_280
MOST_BLOCK = 1 << 16
READ_BYTES = 1 << 20
SPLIT_BYTES = 32 << 20
#: So many records must follow one another from a guessed start, unless the file ends first.
CHAIN = 4


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def size_of(path: str) -> int:
    where, name = locate(path)
    info = where.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def block_bytes(head: bytes, at: int = 0) -> int | None:
    """The size that a block's header states; None if there is no such header."""
    if head[at : at + 4] != MAGIC or len(head) < at + 12:
        return None
    p = at + 12
    stop = p + struct.unpack_from("<H", head, at + 10)[0]
    while p + 4 <= min(stop, len(head)):
        kind, n = head[p : p + 2], struct.unpack_from("<H", head, p + 2)[0]
        if kind == b"BC" and n == 2 and p + 6 <= len(head):
            return struct.unpack_from("<H", head, p + 4)[0] + 1
        p += 4 + n
    return None


def inflate(block: bytes) -> bytes:
    data_at = 12 + struct.unpack_from("<H", block, 10)[0]
    crc, size = struct.unpack_from("<II", block, len(block) - 8)
    try:
        out = zlib.decompress(block[data_at:-8], -15)
    except zlib.error as bad:
        raise ValueError(f"damaged block: {bad}") from bad
    if len(out) != size or zlib.crc32(out) != crc:
        raise ValueError("damaged block: checksum or size differs")
    return out


class Stream:
    """Content from a block onward, read as far as it is asked for. Places count from the first block's content."""

    def __init__(self, file, block: int, size: int):
        self.file, self.next, self.size = file, block, size
        self.data, self.base, self.blocks = bytearray(), 0, []  # blocks: (place, offset in the file)
        self.raw, self.raw_at = b"", block

    def _more(self) -> bool:
        if self.next >= self.size:
            return False
        if self.next + MOST_BLOCK > self.raw_at + len(self.raw):
            self.file.seek(self.next)
            self.raw, self.raw_at = self.file.read(READ_BYTES), self.next
        at = self.next - self.raw_at
        n = block_bytes(self.raw, at)
        if n is None or at + n > len(self.raw):
            raise ValueError(f"no whole block at byte {self.next}")
        out = inflate(self.raw[at : at + n])
        if out:
            self.blocks.append((self.base + len(self.data), self.next))
            self.data += out
        self.next += n
        return True

    def has(self, end: int) -> bool:
        """Content reaches the place end."""
        while self.base + len(self.data) < end:
            if not self._more():
                return False
        return True

    def get(self, place: int, n: int) -> bytes:
        return bytes(self.data[place - self.base : place - self.base + n])

    def virtual(self, place: int) -> int:
        """Offset of the place's block in the file, times 65536, plus the place within. The place must have been read."""
        start, offset = next(b for b in reversed(self.blocks) if b[0] <= place)
        return offset << 16 | place - start

    def forget(self, place: int) -> None:
        """Drop what lies before the place."""
        if place - self.base > 1 << 20:
            del self.data[: place - self.base]
            self.base = place
            last = max(i for i, b in enumerate(self.blocks) if b[0] <= place)
            self.blocks = self.blocks[last:]


def find_block(file, start: int, end: int, size: int) -> int | None:
    """The first block that begins in start..end; its content's checksum must hold."""
    file.seek(start)
    seen = file.read(min(size, end + MOST_BLOCK) - start) if end - start <= 4 * MOST_BLOCK else file.read(4 * MOST_BLOCK)
    at = seen.find(MAGIC)
    while at >= 0 and start + at < end:
        n = block_bytes(seen, at)
        if n and at + n <= len(seen):
            try:
                inflate(seen[at : at + n])
                return start + at
            except (ValueError, struct.error):
                pass  # the magic number within a block's bytes
        at = seen.find(MAGIC, at + 1)
    return None


Check = Callable[[bytes], bool]
Length = Callable[[bytes], int]


def find_record(stream: Stream, end: int, head: int, length: Length, check: Check) -> int | None:
    """The first place, in a block before the file's byte end, from which CHAIN well-formed records run."""
    place = 0
    while stream.has(place + 1):
        if stream.virtual(place) >> 16 >= end:
            return None
        p, good = place, 0
        while good < CHAIN and stream.has(p + head) and check(h := stream.get(p, head)):
            n = length(h)
            if not stream.has(p + n):
                break
            p, good = p + n, good + 1
            if not stream.has(p + 1):
                return place
        if good == CHAIN:
            return place
        place += 1
    return None


def read_records(stream: Stream, place: int, stop: int | None, head: int, length: Length) -> Iterator[bytes]:
    """Records from the place until the one at the virtual offset stop, or the end."""
    while stream.has(place + 1):
        if stop is not None:
            here = stream.virtual(place)
            if here == stop:
                return
            if here > stop:
                raise ValueError(f"records pass over the planned start {stop}; read with split_bytes=0")
        n = length(stream.get(place, head)) if stream.has(place + head) else head
        if n < head or not stream.has(place + n):
            raise ValueError("the file ends within a record")
        yield stream.get(place, n)
        place += n
        stream.forget(place)
    if stop is not None:
        raise ValueError(f"no record at the planned start {stop}; read with split_bytes=0")


def read_splits(spark: SparkSession, path: str, first: int, head: int, length: Length, check: Check, decode: Callable[[list[bytes], int], pa.RecordBatch], schema: str, split_bytes: int = SPLIT_BYTES, batch: int = 4096, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of a file from the virtual offset first, decoded (records, number of the first) batch by batch. split_bytes=0 reads in one task."""
    size = size_of(path)
    step = split_bytes or max(size, 1)
    n = max(1, -(-size // step))

    def plan(batches):
        where, name = locate(path)
        for b in batches:
            for k in b.column(0).to_pylist():
                lo, hi = k * step, min(size, (k + 1) * step)
                at = first if lo <= first >> 16 < hi else None
                if lo > first >> 16:
                    with where.open_input_file(name) as f:
                        block = find_block(f, lo, hi, size)
                        if block is not None:
                            s = Stream(f, block, size)
                            place = find_record(s, hi, head, length, check)
                            at = None if place is None else s.virtual(place)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([at], pa.int64())], ["split", "first"])

    # One row a split of the file: the window orders some thousands at most.
    splits = spark.range(0, n, 1, min(n, 512)).mapInArrow(plan, "split bigint, first bigint").filter("first is not null")
    splits = splits.withColumn("stop", F.lead("first").over(Window.orderBy("split")))

    def run(batches):
        where, name = locate(path)
        for b in batches:
            for k, at, stop in zip(*[b.column(i).to_pylist() for i in range(3)]):
                with where.open_input_file(name) as f:
                    got, held, number = [], 0, k << 33
                    for r in read_records(Stream(f, at >> 16, size), at & 0xFFFF, stop, head, length):
                        got.append(r)
                        held += len(r)
                        if len(got) == batch or held >= batch_bytes:
                            yield decode(got, number)
                            number += len(got)
                            got, held = [], 0
                    if got:
                        yield decode(got, number)

    return splits.repartitionByRange(n, "split").mapInArrow(run, schema) if n > 1 else splits.mapInArrow(run, schema)


def compress(data: bytes) -> tuple[bytes, list[int]]:
    """data as BGZF, and the file offset of each CONTENT bytes."""
    out, offsets = bytearray(), []
    for at in range(0, len(data), CONTENT):
        part = data[at : at + CONTENT]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        if len(body) > MOST_BLOCK - 26:
            packer = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = packer.compress(part) + packer.flush()
        offsets.append(len(out))
        out += END[:16] + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    offsets.append(len(out))
    return bytes(out) + END, offsets


def virtual_offset(place: int, offsets: list[int]) -> int:
    return offsets[place // CONTENT] << 16 | place % CONTENT
