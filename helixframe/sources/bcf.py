"""BCF files: biallelic SNPs read split by split, copy-number calls written with their index."""

from __future__ import annotations

import re
import struct
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.schemas import VARIANTS
from helixframe.sources import bgzf
from helixframe.sources.sinks import vcf_header

# Fixed values of the format: types of values with their bytes and letters for struct, and the bits that mean a missing number.
INT8, INT16, INT32, FLOAT, CHAR = 1, 2, 3, 5, 7
WIDTH = {INT8: (1, "b"), INT16: (2, "h"), INT32: (4, "i"), FLOAT: (4, "f"), CHAR: (1, "s")}
MISSING_FLOAT = struct.pack("<I", 0x7F800001)
#: The least of an integer type mark missing values and the ends of vectors.
RESERVED = 8
HEAD = 32
#: Bits of the smallest bin of an index, and its levels below the root for sequences up to 2**29.
MIN_SHIFT, DEPTH = 14, 5


def descriptor(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + integers([n])


def integers(values: list[int]) -> bytes:
    kind = next(k for k in (INT8, INT16, INT32) if all(-(1 << 8 * WIDTH[k][0] - 1) + RESERVED <= v < 1 << 8 * WIDTH[k][0] - 1 for v in values))
    return descriptor(kind, len(values)) + struct.pack(f"<{len(values)}{WIDTH[kind][1]}", *values)


def floats(values: list[float | None]) -> bytes:
    return descriptor(FLOAT, len(values)) + b"".join(MISSING_FLOAT if v is None else struct.pack("<f", v) for v in values)


def string(text: str) -> bytes:
    return descriptor(CHAR, len(text.encode())) + text.encode()


def read_typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, number of values, place of the first)."""
    kind, n, at = data[at] & 15, data[at] >> 4, at + 1
    if n == 15:
        k, _, at = read_typed(data, at)
        width, letter = WIDTH[k]
        n, at = struct.unpack_from("<" + letter, data, at)[0], at + width
    return kind, n, at


def dictionaries(header: str) -> tuple[list[str], dict[int, str], dict[int, str], list[str]]:
    """(samples, contigs by number, strings by number, header lines). Numbers are stated by IDX or follow the order of first mention."""
    strings, contigs = {"PASS": 0}, {}
    lines = header.rstrip("\0\n").split("\n")
    for line in lines:
        found = re.match(r"##(FILTER|INFO|FORMAT|contig)=<(?:.*?,)?ID=([^,>]+)", line)
        if not found:
            continue
        into, stated = contigs if found[1] == "contig" else strings, re.search(r"[,<]IDX=(\d+)", line)
        into.setdefault(found[2], int(stated[1]) if stated else max(into.values(), default=-1) + 1)
    return lines[-1].split("\t")[9:], {v: k for k, v in contigs.items()}, {v: k for k, v in strings.items()}, lines


def read_header(path: str) -> tuple[str, int]:
    """The header's text and the virtual offset of the first record."""
    where, name = bgzf.locate(path)
    with where.open_input_file(name) as f:
        s = bgzf.Stream(f, 0, bgzf.size_of(path))
        if not s.has(9) or s.get(0, 3) != b"BCF":
            raise ValueError(f"not a BCF file: {path}")
        n = struct.unpack("<I", s.get(5, 4))[0]
        if not s.has(9 + n):
            raise ValueError("the file ends within its header")
        return s.get(9, n).decode(), s.virtual(9 + n) if s.has(10 + n) else s.next << 16


def length(head: bytes) -> int:
    shared, each = struct.unpack_from("<II", head)
    return 8 + shared + each


def well_formed(n_contigs: int, n_samples: int):
    def check(h: bytes) -> bool:
        shared, each, contig, pos, rlen = struct.unpack_from("<IIiii", h)
        samples = struct.unpack_from("<I", h, 28)[0] & 0xFFFFFF
        return 24 <= shared < 1 << 28 and each < 1 << 30 and 0 <= contig < n_contigs and pos >= -1 and rlen >= 0 and samples == n_samples

    return check


def _alleles(r: bytes) -> list[str]:
    at, out = HEAD, []
    for i in range(1 + (struct.unpack_from("<I", r, 24)[0] >> 16)):
        kind, n, at = read_typed(r, at)
        at += n * WIDTH[kind][0] if kind else 0
        if i:
            out.append(r[at - n : at].decode())
    return out


def _genotype(r: bytes, sample: int, gt: int) -> list[int | None] | None:
    """Allele numbers of a sample; None if the record has no genotypes."""
    shared = struct.unpack_from("<I", r)[0]
    fields, samples = struct.unpack_from("<I", r, 28)[0] >> 24, struct.unpack_from("<I", r, 28)[0] & 0xFFFFFF
    at = 8 + shared
    for _ in range(fields):
        k, _, at = read_typed(r, at)
        width, letter = WIDTH[k]
        key, at = struct.unpack_from("<" + letter, r, at)[0], at + width
        kind, n, at = read_typed(r, at)
        size = n * WIDTH[kind][0] if kind else 0
        if key == gt:
            least = -(1 << 8 * WIDTH[kind][0] - 1)
            values = struct.unpack_from(f"<{n}{WIDTH[kind][1]}", r, at + sample * size)
            return [None if v >> 1 == 0 or v == least else (v >> 1) - 1 for v in values if v != least + 1]  # that ends a shorter vector
        at += samples * size
    return None


def read_bcf(spark: SparkSession, path: str, sample: str | None = None, split_bytes: int = bgzf.SPLIT_BYTES) -> DataFrame:
    """Biallelic SNPs as ``text.read_vcf`` gives them: the first of a place; if the header names the sample, those it is heterozygous at."""
    header, first = read_header(path)
    samples, contigs, strings, _ = dictionaries(header)
    column = samples.index(sample) if sample in samples else None
    gt = next((k for k, v in strings.items() if v == "GT"), -1)

    def decode(records: list[bytes], number: int) -> pa.RecordBatch:
        rows = []
        for i, r in enumerate(records):
            alleles = [a.upper() for a in _alleles(r)]
            if len(alleles) != 2 or any(len(a) != 1 or a in ".*" for a in alleles) or alleles[0] == alleles[1]:
                continue
            numbers = None
            if column is not None:
                numbers = _genotype(r, column, gt)
                if not numbers or None in numbers or sum(numbers) != 1:
                    continue
            contig, pos = struct.unpack_from("<ii", r, 8)
            rows.append((number + i, contigs[contig], pos, *alleles, numbers))
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["ord", "contig", "pos", "ref", "alt", "gt"])

    rows = bgzf.read_splits(spark, path, first, HEAD, length, well_formed(max(contigs, default=-1) + 1, len(samples)), decode, "ord long, " + VARIANTS, split_bytes)
    order = F.row_number().over(Window.partitionBy("contig", "pos").orderBy("ord"))
    return rows.withColumn("_n", order).filter("_n = 1").drop("_n", "ord")


def encode(r: dict, contig: int, keys: dict[str, int], method: str) -> bytes:
    """One call's record, with the fields that the text form has."""
    whole = lambda name, *v: integers([keys[name]]) + integers(list(v))
    real = lambda name: integers([keys[name]]) + floats([r[name.lower()]])
    said = lambda name, v: integers([keys[name]]) + string(v)
    info = [
        integers([keys["PRECISE" if r["precise"] else "IMPRECISE"]]) + b"\0", said("SVTYPE", "CNV"), said("SVMETHOD", method), whole("END", r["end"]), whole("SRL", r["srl"]), whole("SRR", r["srr"]), whole("NSNPS", r["nsnps"]),
        real("MAF"), integers([keys["OEMAF"]]) + floats([r["oemaf"]]), whole("CIEND", r["ciend_lo"], r["ciend_hi"]), whole("CIPOS", r["cipos_lo"], r["cipos_hi"]), real("PTY"), real("MPB"), real("RDS"),
    ]
    each = [
        integers([keys["GT"]]) + integers([0, 0]), integers([keys["CNL"]]) + floats(r["cnl"]), whole("GQ", r["gq"]), said("FT", r["ft"]), whole("CN", r["cn_int"]),
    ]
    alleles = ["N", "<CNV>"]
    fixed = struct.pack("<iiifII", contig, r["start"], r["end"] - r["start"], r["gq"], len(alleles) << 16 | len(info), len(each) << 24 | 1)
    shared = fixed + string(r["id"]) + b"".join(string(a) for a in alleles) + integers([keys["PASS"]]) + b"".join(info)
    own = b"".join(each)
    return struct.pack("<II", len(shared), len(own)) + shared + own


def bin_of(start: int, end: int, depth: int) -> int:
    """The smallest bin of the index's tree that holds start..end."""
    last = end - 1
    for level in range(depth, 0, -1):
        shift = MIN_SHIFT + 3 * (depth - level)
        if start >> shift == last >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def _first_place(number: int, depth: int) -> int:
    """Where a bin begins."""
    level = 0
    while ((1 << 3 * (level + 1)) - 1) // 7 <= number:
        level += 1
    return number - ((1 << 3 * level) - 1) // 7 << MIN_SHIFT + 3 * (depth - level)


def index(places: list[tuple[int, int, int, int, int]], lengths: list[int]) -> bytes:
    """CSI of records (contig, start, end, virtual offset, virtual offset of the next) in order."""
    depth = DEPTH
    while max(lengths, default=0) > 1 << MIN_SHIFT + 3 * depth:
        depth += 1
    bins, windows = defaultdict(lambda: defaultdict(list)), defaultdict(dict)
    for contig, start, end, at, until in places:
        end = max(end, start + 1)
        chunks = bins[contig][bin_of(start, end, depth)]
        if chunks and chunks[-1][1] == at:
            chunks[-1] = (chunks[-1][0], until)
        else:
            chunks.append((at, until))
        for w in range(start >> MIN_SHIFT, (end - 1 >> MIN_SHIFT) + 1):
            windows[contig].setdefault(w, at)
    out = [b"CSI\1", struct.pack("<iiii", MIN_SHIFT, depth, 0, len(lengths))]
    for c in range(len(lengths)):
        out.append(struct.pack("<i", len(bins[c])))
        seen = sorted(windows[c].items())
        for number, chunks in sorted(bins[c].items()):
            # The least offset of a record that reaches into the bin or beyond its begin.
            low = min((v for w, v in seen if w >= _first_place(number, depth) >> MIN_SHIFT), default=chunks[0][0])
            out.append(struct.pack("<IQi", number, low, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks))
    return bgzf.compress(b"".join(out))[0]


def write_bcf(records: DataFrame, contigs: DataFrame, path: str, sample: str, method: str = "helixframe", reference: str = "", day: str = "") -> None:
    """One file in order of place, and ``path``.csi. One task writes both: calls only, a few thousand a genome."""
    names = [(r["contig"], r["length"]) for r in contigs.orderBy("tid").collect()]
    lines = vcf_header(names, sample, reference, day)
    text = "\n".join([lines[0], '##FILTER=<ID=PASS,Description="All filters passed">', *lines[1:]]) + "\n"
    keys = {v: k for k, v in dictionaries(text)[2].items()}
    numbers = {c: i for i, (c, _) in enumerate(names)}

    def run(batches):
        said = text.encode() + b"\0"
        data, spans = bytearray(b"BCF\2\2" + struct.pack("<I", len(said)) + said), []
        for b in batches:
            for r in b.to_pylist():
                at = len(data)
                data += encode(r, numbers[r["contig"]], keys, method)
                spans.append((numbers[r["contig"]], r["start"], r["end"], at, len(data)))
        packed, offsets = bgzf.compress(bytes(data))
        places = [(c, s, e, bgzf.virtual_offset(at, offsets), bgzf.virtual_offset(until, offsets)) for c, s, e, at, until in spans]
        where, name = bgzf.locate(path)
        for suffix, content in (("", packed), (".csi", index(places, [n for _, n in names]))):
            # Moved into place when whole, so a task that is lost and run again leaves no half file.
            with where.open_output_stream(f"{name}{suffix}.part") as f:
                f.write(content)
            where.move(f"{name}{suffix}.part", name + suffix)
        yield pa.RecordBatch.from_arrays([pa.array([len(spans)], pa.int64())], ["n"])

    if not records.drop("cn", "gq_corrected").coalesce(1).sortWithinPartitions("id").mapInArrow(run, "n bigint").collect():
        list(run([]))  # an empty table may have no task: header and empty index
