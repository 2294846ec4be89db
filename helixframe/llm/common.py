"""Shared helpers: tables, text and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.work import materialize, shared_dir, work_path

__all__ = ["ascii_lower", "free_name", "materialize", "shared_dir", "table", "text_key", "unit_hash", "work_path"]

#: ASCII A-Z to a-z; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id; null and empty texts differ."""
    return F.xxhash64(text.isNull(), text)


def unit_hash(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1) with 52 bits of MD5, as DuckDB can compute it too."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
