"""Media columns: PNG images in binary columns, with perceptual hashes.

``encode_png`` writes 8-bit samples as PNG: IHDR, zlib data in IDAT chunks, IEND,
each chunk with its CRC. ``decode_png`` checks the signature and every chunk's
CRC, inflates, and undoes the row filters in numpy. ``dct_hash`` averages the
picture to 32 x 32 grey cells, takes its cosine transform and keeps the signs
of the 8 x 8 lowest frequencies against their median.

Texts as pictures: UTF-8 padded with spaces to a positive multiple of 192
bytes, as RGB rows of 64 pixels. A null text is an empty one. Equal texts give
equal values. A damaged picture raises ValueError in ``decode_png`` and gives a
row with null features and its error in ``read_media``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW, WIDTH, CHANNELS = 192, 64, 3
IDAT_BYTES = 1 << 16
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(pixels: np.ndarray, row_filter: int = 0, level: int = 1) -> bytes:
    """pixels: uint8, height x width x 1, 2, 3 or 4 samples. Filter 0 (none), 1 (left) or 2 (up)."""
    height, width, n = pixels.shape
    rows = pixels.reshape(height, width * n)
    out = np.empty((height, width * n + 1), np.uint8)
    out[:, 0], out[:, 1:] = row_filter, rows
    if row_filter == 1:
        out[:, 1 + n :] -= rows[:, :-n]
    elif row_filter == 2:
        out[1:, 1:] -= rows[:-1]
    elif row_filter:
        raise ValueError("the writer knows filters 0, 1 and 2")
    data = zlib.compress(out.tobytes(), level)
    kind = {v: k for k, v in _SAMPLES.items()}[n]
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))]
    parts += [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(rows: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
    """rows: height x (width * n) filtered bytes. Runs of one filter that numpy can undo are undone together."""
    height, wide = rows.shape
    out = rows.copy()
    ends = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *ends], [*ends, height]):
        kind = kinds[lo]
        if kind == 1:
            out[lo:hi] = np.add.accumulate(out[lo:hi].reshape(hi - lo, -1, n), axis=1, dtype=np.uint8).reshape(hi - lo, wide)
        elif kind == 2:
            if lo:
                out[lo] += out[lo - 1]
            out[lo:hi] = np.add.accumulate(out[lo:hi], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(lo, hi):
                up = (out[y - 1] if y else np.zeros(wide, np.uint8)).astype(np.int32)
                row = out[y].astype(np.int32)
                for x in range(0, wide, n):
                    left = row[x - n : x] if x else np.zeros(n, np.int32)
                    above, corner = up[x : x + n], up[x - n : x] if x else np.zeros(n, np.int32)
                    if kind == 3:
                        guess = (left + above) >> 1
                    else:
                        p = left + above - corner
                        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                    row[x : x + n] = (row[x : x + n] + guess) & 255
                out[y] = row
        elif kind:
            raise ValueError(f"row filter {kind} is unknown")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """height x width x samples, uint8. Not interlaced, 8 bits a sample."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("the last chunk is cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, bits, colour, _, _, laced = head
    if bits != 8 or laced or colour not in _SAMPLES:
        raise ValueError("only plain 8-bit pictures are read")
    n = _SAMPLES[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"the picture's data can't be inflated: {e}") from e
    if raw.size != height * (width * n + 1):
        raise ValueError("the picture's data has another size than its head says")
    raw = raw.reshape(height, width * n + 1)
    return _unfilter(raw[:, 1:], raw[:, 0], n).reshape(height, width, n)


_k = np.arange(32)
_COSINES = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:8, None] / 64)


def _cells(grey: np.ndarray, axis: int) -> np.ndarray:
    """Means over 32 cells along an axis; a shorter axis repeats its lines."""
    size = grey.shape[axis]
    if size < 32:
        return np.take(grey, np.arange(32) * size // 32, axis)
    edges = np.arange(33) * size // 32
    return np.add.reduceat(grey, edges[:-1], axis) / np.diff(edges).reshape([-1, 1] if axis == 0 else [1, -1])


def dct_hash(pixels: np.ndarray) -> str:
    """16 hex digits."""
    grey = pixels[..., : min(pixels.shape[2], 3)].mean(axis=2)
    low = _COSINES @ _cells(_cells(grey, 0), 1) @ _COSINES.T
    bits = low.ravel() > np.median(low.ravel()[1:])
    return np.packbits(bits).tobytes().hex()


def text_pixels(text: bytes) -> np.ndarray:
    padded = text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b" ")
    return np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, CHANNELS)


def _batches(columns: pa.RecordBatch, step: int = 256):
    for at in range(0, columns.num_rows, step):
        yield columns.slice(at, step)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media): every text as a PNG in a binary column."""

    def encode(batches):
        for whole in batches:
            for b in _batches(whole):
                texts = [t or b"" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_png(text_pixels(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(encode, f"doc_id {kind}, n_bytes bigint, media binary")


MEDIA_SCHEMA = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> payload digests and features from the stored bytes."""

    def one(media: bytes | None):
        if media is None:
            return None, None, None, None, None, None, "no media"
        sizes = len(media), hashlib.sha256(media).hexdigest()
        try:
            pixels = decode_png(media)
        except ValueError as e:
            return None, None, None, *sizes, None, str(e)
        payload = pixels.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *sizes, dct_hash(pixels), None

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", *[x.split()[0] for x in MEDIA_SCHEMA.split(", ")]]

    def decode(batches):
        for whole in batches:
            for b in _batches(whole):
                rows = [one(m) for m in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(decode, f"doc_id {kind}, n_bytes bigint, {MEDIA_SCHEMA}")
