"""Ranks, running sums, islands and first rows along a contig or a file in levels, so that no task holds a whole contig.

Rows are cut into blocks by position; block totals are summed in a small
running sum, and rows are ranked or summed within their block only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000


def _totals(df: DataFrame, key: str, total, block: int) -> DataFrame:
    per = df.groupBy(key, "_block").agg(total.alias("_total"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))


def rank_rows(df: DataFrame, key: str = "contig", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """A column rank: the number of rows of the same key before this one by pos."""
    cut = df.withColumn("_block", F.expr(f"{pos} div {block}"))
    base = _totals(cut, key, F.count(F.lit(1)), block)
    within = F.row_number().over(Window.partitionBy(key, "_block").orderBy(pos)) - 1
    out = cut.withColumn("_within", within).join(base, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")))
    return out.withColumn("rank", (F.col("_base") + F.col("_within")).cast("long")).drop("_block", "_within", "_k", "_b", "_base")


def running_sum(df: DataFrame, value: str, name: str, key: str = "contig", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """The sum of value over rows of the same key up to and with this one."""
    cut = df.withColumn("_block", F.expr(f"{pos} div {block}"))
    base = _totals(cut, key, F.sum(value), block)
    within = F.sum(value).over(Window.partitionBy(key, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    out = cut.withColumn("_within", within).join(base, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")))
    return out.withColumn(name, F.col("_base") + F.col("_within")).drop("_block", "_within", "_k", "_b", "_base")


def ranked_sums(df: DataFrame, values: list[str], key: str = "contig", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """df with rank, and for each value <value>_before: the number of rows and the sum of whole numbers before this row. One shuffle of the rows for all of them."""
    cut = df.withColumn("_block", F.expr(f"{pos} div {block}"))
    per = cut.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"{c}_base") for c in ("_n", *[f"_{v}" for v in values])])
    within = Window.partitionBy(key, "_block").orderBy(pos)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_rank", F.row_number().over(within) - 1)
    for v in values:
        out = out.withColumn(f"_{v}_before", F.coalesce(F.sum(v).over(earlier), F.lit(0)))
    out = out.join(base, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")))
    sums = [(F.col(f"_{v}_before") + F.col(f"_{v}_base")).cast("long").alias(f"{v}_before") for v in values]
    return out.select(*df.columns, (F.col("_rank") + F.col("_n_base")).cast("long").alias("rank"), *sums)


def islands(df: DataFrame, gap: int, key: str = "contig", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """df with island, a number that rows of a key share if no two neighbours among them are more than gap apart.

    A row also goes to the blocks that begin within gap after it, so that each block knows whether its first row continues an island.
    """
    own = F.expr(f"{pos} div {block}")
    cut = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, F.expr(f"({pos} + {gap}) div {block}"))))
    before = F.max(pos).over(Window.partitionBy(key, "_block").orderBy(pos).rangeBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(pos) - before > gap), 1).otherwise(0)
    # Rows at one place are one row here: their number is that of the place.
    marked = cut.withColumn("_new", new).filter("_own = _block").drop("_block", "_own")
    starts = running_sum(marked.select(key, pos, "_new").dropDuplicates([key, pos]), "_new", "island", key, pos, block)
    starts = starts.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.col("island").cast("long").alias("island"))
    return df.join(starts, (F.col(key) == F.col("_k")) & (F.col(pos) == F.col("_p"))).drop("_k", "_p")


def first_rows(df: DataFrame, n: int, order: str = "ord", shifts: tuple[int, ...] = (33, 22, 11, 0)) -> DataFrame:
    """The first n rows by order, a column of distinct whole numbers from 0: a filter, without sorting rows.

    Rows are counted by the leading bits of their number (the split of a file, where Spark numbered its lines), which tells how many each group gives;
    the one that gives a part is counted again by the next bits, until the number of the last row is known.
    """
    left, group = n, F.lit(True)
    if n <= 0:
        return df.filter(F.lit(False))
    for shift in shifts:
        part = F.shiftright(F.col(order), shift)
        counts = df.filter(group).groupBy(part.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
        through = counts.withColumn("_through", F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)))  # a row a group
        last = through.filter(F.col("_through") >= left).agg(F.min_by(F.struct("_g", (F.col("_through") - F.col("_n")).alias("before")), "_g")).first()[0]
        if last is None:
            return df
        left, group = left - last["before"], part == last["_g"]
    return df.filter(F.col(order) <= last["_g"])


def centred_sums(df: DataFrame, values: list[str], half: int, key: str = "contig", pos: str = "pos", length: str = "length", block: int = BLOCK) -> DataFrame:
    """For each value a column <value>_sum over [pos-half, pos+half]; 0 where that leaves the contig. Rows must be dense in pos.

    Blocks get a halo of half rows from their neighbours; each sum is the difference of two running sums.
    """
    b = F.expr(f"{pos} div {block}")
    copies = F.array_distinct(F.array(b, F.expr(f"greatest({pos} - {half}, 0) div {block}"), F.expr(f"({pos} + {half}) div {block}")))
    cut = df.withColumn("_own", b).withColumn("_block", F.explode(copies))
    w = Window.partitionBy(key, "_block").orderBy(pos)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = cut
    for v in values:
        out = out.withColumn(f"_{v}", F.sum(v).over(run))
    whole = (F.col(pos) >= half) & (F.col(pos) < F.col(length) - half)
    for v in values:
        span = F.lead(f"_{v}", half).over(w) - F.coalesce(F.lag(f"_{v}", half + 1).over(w), F.lit(0))
        out = out.withColumn(f"{v}_sum", F.when(whole, span).otherwise(F.lit(0)))
    return out.filter(F.col("_own") == F.col("_block")).drop("_own", "_block", *[f"_{v}" for v in values])
