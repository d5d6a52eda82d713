"""Joins of points with intervals, as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    """Every row of points with every row of intervals whose ends lo and hi (whole numbers, both included) its value `at` lies between.

    An interval of 2^(k-1) to 2^k numbers meets at most two of the blocks of 2^k numbers, and is found by those; a point looks up its block of
    each size that some interval has, 64 at most. So rows are shuffled by (size, block) and no pair is looked at that isn't in
    the same block, whether intervals are many, long, nested or equal. Columns of both sides stay and must not share names. Null values
    and null or inverted ends meet nothing. Ends lie within 2^62 of 0."""
    level = F.when(F.col(lo) == F.col(hi), 0).otherwise(F.length(F.bin(F.col(hi).cast("long") - F.col(lo).cast("long"))))  # 2^level > hi - lo
    spans = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_level", level)
    block = lambda c, k: F.call_function("shiftright", F.col(c).cast("long"), k)
    spans = spans.withColumn("_block", F.explode(F.sequence(block(lo, F.col("_level")), block(hi, F.col("_level")))))
    levels = spans.select("_level").distinct().agg(F.sort_array(F.collect_set("_level")).alias("_levels"))  # one row of 64 numbers at most
    keyed = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    keyed = keyed.withColumn("_block", block(at, F.col("_level")))
    return keyed.join(spans, ["_level", "_block"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_level", "_block")
