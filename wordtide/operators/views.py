"""Views that a presentation layer shows: small queries over the results of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import ratio
from .lifecycle import series


def headline(active: DataFrame, focal: str, terms: int) -> DataFrame:
    own = F.col("genre") == focal
    return active.agg(F.sum(F.when(own, 1).otherwise(0)).alias("focal_records"), F.count_distinct(F.when(own, F.col("entity"))).alias("focal_entities"), F.sum(F.when(own, 0).otherwise(1)).alias("other_records")).withColumn("terms", F.lit(terms).cast("long"))


def lookup(lex: DataFrame, text: str) -> DataFrame:
    """A term by its id, or its label in any case."""
    return lex.where((F.col("id") == text) | (F.lower("label") == text.lower()))


def category_tops(lex: DataFrame, peaks: DataFrame) -> DataFrame:
    """cat, terms, top: how many terms, and the most used one, plain spellings before ambiguous ones. peaks: item, P."""
    df = lex.select("id", "cat", "poly").join(peaks.select(F.col("item").alias("id"), "P"), "id", "left")
    order = W.partitionBy("cat").orderBy("poly", F.desc_nulls_last("P"), "id")
    return df.withColumn("k", F.row_number().over(order)).groupBy("cat").agg(F.count("*").alias("terms"), F.max(F.when(F.col("k") == 1, F.col("id"))).alias("top"))


def index_to_peak(curve: DataFrame) -> DataFrame:
    """genre, item, year, idx: the smoothed rate as percent of its own peak."""
    top = F.max("s").over(W.partitionBy("genre", "item"))
    return curve.select("genre", "item", "year", (ratio(F.col("s"), top) * 100).alias("idx"))


def crossover_medians(crossed: DataFrame, from_year: int, least_lag: int = -3, poly: DataFrame | None = None, slow: int = 8) -> DataFrame:
    """genre, items, median, slow: lags of items with a take-off in both genres."""
    df = crossed.where((F.col("focal_takeoff") >= from_year) & (F.col("lag") >= least_lag))
    if poly is not None:
        df = df.join(poly.select("item"), "item", "left_anti")
    return df.groupBy("genre").agg(F.count("*").alias("items"), F.percentile("lag", F.lit(0.5)).alias("median"), F.sum(F.when(F.col("lag") >= slow, 1).otherwise(0)).alias("slow"))


def reach_top(crossed: DataFrame, k: int = 20, least_peak: float = 1.0, poly: DataFrame | None = None) -> DataFrame:
    """genre, rank, item, reach of the items that reach furthest."""
    df = crossed.where((F.col("focal_peak") >= least_peak) & (F.col("peak") > 0))
    if poly is not None:
        df = df.join(poly.select("item"), "item", "left_anti")
    order = W.partitionBy("genre").orderBy(F.desc("reach"), "item")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("genre", "rank", "item", "reach")


def cohort_extremes(facts: DataFrame) -> DataFrame:
    return facts.agg(F.min("rise_median").alias("rise_min"), F.max("rise_median").alias("rise_max"), F.min("keep_median").alias("keep_min"), F.max("keep_median").alias("keep_max"))


def sense_shares(by_year: DataFrame, least: int = 40, unclear: str = "unclear") -> DataFrame:
    """target, sense, year, share: of the classified uses in three years around; years with fewer than `least` are left out."""
    around = W.partitionBy("target", "sense").orderBy("year").rowsBetween(-1, 1)
    df = by_year.where(F.col("sense") != unclear).withColumn("m", F.sum("n").over(around))
    df = df.withColumn("total", F.sum("m").over(W.partitionBy("target", "year"))).where(F.col("total") >= least)
    return df.select("target", "sense", "year", ratio(F.col("m"), F.col("total")).alias("share"))


def unclear_share(by_year: DataFrame, unclear: str = "unclear") -> DataFrame:
    return by_year.groupBy("target").agg(ratio(F.sum(F.when(F.col("sense") == unclear, F.col("n")).otherwise(0)), F.sum("n")).alias("unclear"))


def distinctive_top(found: DataFrame, k: int = 12) -> DataFrame:
    """Adds times = share / max(rest, 0.01), for the k highest z of a region."""
    keys = [c for c in ("era", "region") if c in found.columns]
    df = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("z"), "item"))).where(F.col("rank") <= k)
    return df.withColumn("times", F.col("share") / F.greatest("rest", F.lit(0.01)))


def diffusion_regions(curves: DataFrame, least: int = 200) -> DataFrame:
    """item, region: regions with enough entity-years for a line of their own."""
    return curves.groupBy("item", "region").agg(F.sum("active").alias("entity_years")).where(F.col("entity_years") >= least)


def peak_calendar(curve: DataFrame, lex: DataFrame) -> DataFrame:
    """py, cat, items: how many terms of a category peaked in a year."""
    ser = series(curve).where("P > 0").select(F.col("item").alias("id"), "py")
    return ser.join(lex.select("id", "cat"), "id").groupBy("py", "cat").agg(F.count("*").alias("items"))


def profiles(curve: DataFrame, life: DataFrame) -> DataFrame:
    """item, profile: one JSON document an item, with its curves by genre and what life holds of it."""
    ser = series(curve).select("item", "genre", F.transform("c", lambda x: F.bround(x.s, 3)).alias("s"))
    by = ser.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("genre", "s")))).alias("curves"))
    facts = [c for c in life.columns if c != "item"]
    return by.join(life, "item", "left").select("item", F.to_json(F.struct("item", "curves", *facts)).alias("profile"))
