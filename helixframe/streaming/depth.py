"""Depth and window sums over a stream: the coordinate plays the part of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(pos: str = "pos", unit: int = 1):
    """A position as seconds since the epoch."""
    return F.timestamp_seconds(F.col(pos) * unit)


def stream_depth(points: DataFrame, slack: int = 1_000) -> DataFrame:
    """(contig, pos) -> depth by position, emitted once the stream is `slack` bases past it."""
    at = points.withColumn("at", event_time()).withWatermark("at", f"{slack} seconds")
    return at.groupBy("contig", "at").agg(F.count(F.lit(1)).alias("depth")).select("contig", F.unix_seconds("at").alias("pos"), "depth")


def stream_windows(points: DataFrame, size: int, offset: int, slack: int = 1_000) -> DataFrame:
    """(contig, pos) -> counts of fixed or sliding windows."""
    at = points.withColumn("at", event_time()).withWatermark("at", f"{slack} seconds")
    w = F.window("at", f"{size} seconds", f"{offset} seconds")
    return at.groupBy("contig", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("contig", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n")


def stream_sessions(points: DataFrame, gap: int, slack: int = 1_000) -> DataFrame:
    """(contig, pos) -> islands of points no more than gap apart."""
    at = points.withColumn("at", event_time()).withWatermark("at", f"{slack} seconds")
    w = F.session_window("at", f"{gap} seconds")
    return at.groupBy("contig", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("contig", F.unix_seconds("w.start").alias("start"), (F.unix_seconds("w.end") - gap + 1).alias("end"), "n")
