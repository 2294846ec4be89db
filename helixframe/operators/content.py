"""Sequence content: strong bases and uniqueness around each position, computed block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a contig that are computed together.
TILE = 1 << 16
STRONG, UNIQUE = "cCgG", "C"


def tiled(sequence: DataFrame, half: int, tile: int) -> DataFrame:
    """Sequence blocks (contig, length, block_start, bases) -> (contig, length, tile, at, bases): the part of each block that a tile, with half positions on both sides, has of it. at counts from the tile's start."""
    b = sequence.select("contig", F.col("length").cast("long").alias("length"), F.col("block_start").cast("long").alias("from"), "bases", F.length("bases").cast("long").alias("n")).filter("n > 0")
    first = F.expr(f"greatest(from - {half}, 0) div {tile}")
    last = F.expr(f"(from + n - 1 + {half}) div {tile}")
    each = b.withColumn("tile", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("from"), F.col("tile") * tile - half)
    high = F.least(F.col("from") + F.col("n"), (F.col("tile") + 1) * tile + half)
    part = F.substring("bases", (low - F.col("from") + 1).cast("int"), (high - low).cast("int"))
    return each.filter(low < high).select("contig", "length", "tile", (low - F.col("tile") * tile).cast("int").alias("at"), part.alias("bases"))


def block_sums(sequences: dict[str, tuple[DataFrame, str]], half: int, tile: int = TILE) -> DataFrame:
    """{name: (blocks (contig, length, block_start, bases), characters)} -> (contig, pos, a column for each name): how many of the characters lie within half positions of pos; 0 where that leaves the contig.

    Rows are the positions that all sequences hold. What is shuffled is the text, cut into tiles with a halo; the counts are
    differences of running sums within a tile, and no row a position is shuffled.
    """
    names = list(sequences)
    parts = None
    for k, (sequence, _) in enumerate(sequences.values()):
        one = tiled(sequence, half, tile).withColumn("which", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    grouped = parts.groupBy("contig", "tile").agg(F.max("length").alias("length"), F.collect_list(F.struct("which", "at", "bases")).alias("parts"))
    wanted = [np.frombuffer("".join(sorted(set(chars))).encode("utf-32-le"), np.uint32) for _, chars in sequences.values()]

    def run(batches):
        for b in batches:
            for contig, k, length, parts in zip(*[b.column(c).to_pylist() for c in range(4)]):
                first, last = k * tile, min((k + 1) * tile, length)
                if last <= first:
                    continue
                there, held = np.zeros((2, len(names), last - first + 2 * half), bool)
                for p in parts:
                    points = np.frombuffer(p["bases"].encode("utf-32-le"), np.uint32)
                    at = slice(p["at"] + half, p["at"] + half + points.size)
                    points = points[: there[p["which"], at].size]
                    there[p["which"], at] = True
                    held[p["which"], at] = np.isin(points, wanted[p["which"]])
                so_far = np.zeros((len(names), held.shape[1] + 1), np.int32)
                np.cumsum(held, axis=1, out=so_far[:, 1:])
                pos = np.arange(first, last)
                sums = so_far[:, 2 * half + 1 :] - so_far[:, : pos.size]
                sums[:, (pos < half) | (pos >= length - half)] = 0
                kept = there[:, half : half + pos.size].all(axis=0)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(contig, pa.string()), int(kept.sum())), pa.array(pos[kept]), *[pa.array(x[kept]) for x in sums]], ["contig", "pos", *names])

    return grouped.select("contig", "tile", "length", "parts").mapInArrow(run, "contig string, pos long, " + ", ".join(f"{n} int" for n in names))


def content(reference: DataFrame, mappability: DataFrame, contigs: DataFrame, meanisize: int, tile: int = TILE) -> DataFrame:
    """(contig, pos, gc, uniq): strong bases, and unique fragment centres, among the meanisize bases around pos; 0 near the contig's ends."""
    lengths = F.broadcast(contigs.select("contig", "length"))  # one row a contig
    return block_sums({"gc": (reference.join(lengths, "contig"), STRONG), "uniq": (mappability.join(lengths, "contig"), UNIQUE)}, meanisize // 2, tile)


def unique_enough(fragment: float, meanisize: int) -> Column:
    """Compared in single precision, as the threshold is."""
    return F.col("uniq").cast("float") >= F.lit(fragment).cast("float") * F.lit(meanisize).cast("float")


def callable_base(low: int, high: int, fragment: float, meanisize: int) -> Column:
    return (F.col("gc") > low) & (F.col("gc") < high) & unique_enough(fragment, meanisize)
