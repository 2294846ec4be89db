"""Merging the window tables of many samples into one matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(table: DataFrame, file_no: int, by_type: str = "CN") -> DataFrame:
    """A sample's window table -> (file, line, contig, start, end, sample, value). The sample's name is the 4th column's up to its last underscore; by_type CN takes copy numbers, anything else counts."""
    names = table.columns
    sample = names[3].rpartition("_")[0]
    value = names[5] if by_type == "CN" else names[4]
    return table.select(F.lit(file_no).alias("file"), F.monotonically_increasing_id().alias("line"), F.col(names[0]).alias("contig"), F.col(names[1]).cast("long").alias("start"), F.col(names[2]).cast("long").alias("end"), F.lit(sample).alias("sample"), F.col(f"`{value}`").cast("float").alias("value"))


def merge_matrix(rows: DataFrame, samples: list[str]) -> DataFrame:
    """rows (contig, start, end, sample, value) -> a row for every interval of any sample, a column a sample, null where missing. Rows with start >= end are skipped."""
    ok = rows.filter(F.col("start") < F.col("end"))
    return ok.groupBy("contig", "start", "end").pivot("sample", samples).agg(F.first("value", ignorenulls=True))


def merge_tables(tables: list[DataFrame], by_type: str = "CN") -> DataFrame:
    """The matrix of all tables, ordered by the contigs' first appearance, then place."""
    parts = [long_form(t, i, by_type) for i, t in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, parts)
    samples = [t.columns[3].rpartition("_")[0] for t in tables]
    order = rows.groupBy("contig").agg(F.min(F.struct("file", "line")).alias("_order"))
    out = merge_matrix(rows, list(dict.fromkeys(samples)))
    return out.join(F.broadcast(order), "contig").orderBy("_order", "start", "end").drop("_order")
