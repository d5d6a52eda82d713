"""Entities behind an item: guards, first uses, early adopters, popularisers, signature users.

uses(record, entity, genre, year, item, title) of the focal genre; attrs(entity, name, sitelinks, in_base, records); life(item, emerged,
takeoff, poly)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import quantiles

def attributes(active: DataFrame, names: DataFrame, focal: str, known: DataFrame | None = None) -> DataFrame:
    """entity, name, records (focal), sitelinks, in_base, region, scene, fame. known is an optional input; without it nobody is known."""
    n = active.groupBy("entity").agg(F.sum(F.when(F.col("genre") == focal, 1).otherwise(0)).alias("records"))
    df = names.join(n, "entity", "left")
    if known is not None:
        df = df.join(known.select("entity", "sitelinks", F.col("base_id").isNotNull().alias("in_base"), "region", "scene"), "entity", "left")
    else:
        df = df.select("*", F.lit(None).cast("long").alias("sitelinks"), F.lit(False).alias("in_base"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("scene"))
    df = df.withColumn("sitelinks", F.coalesce("sitelinks", F.lit(0))).withColumn("in_base", F.coalesce("in_base", F.lit(False)))
    return df.withColumn("fame", F.col("sitelinks") + F.log1p(F.coalesce("records", F.lit(0))) / 10)


def guard(uses: DataFrame, active: DataFrame, slack: int = 3) -> DataFrame:
    """Uses dated more than slack years before the 10th percentile of their entity's records are not trusted."""
    p10 = quantiles(active, ["entity"], "year", {"p10": 0.1})
    return uses.join(p10, "entity").where(F.col("year") >= F.col("p10") - slack).drop("p10")


def notable(attrs: DataFrame, catalogue: int, leagues: str) -> DataFrame:
    """Adds notable: known to an encyclopedia, or in the base with a real catalogue, and no league; leagues is a pattern of the names of
    accounts that publish for others."""
    ok = (F.col("sitelinks") > 0) | (F.col("in_base") & (F.col("records") >= catalogue))
    return attrs.withColumn("notable", F.coalesce(ok, F.lit(False)) & ~F.coalesce(F.col("name").rlike(leagues), F.lit(False)))


def first_seen(uses: DataFrame, least: int = 2) -> DataFrame:
    """item, first_seen: the first year with at least two entities, else the first year; total entities."""
    by = uses.groupBy("item", "year").agg(F.count_distinct("entity").alias("n"))
    first = by.groupBy("item").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("year"))), F.min("year")).alias("first_seen"))
    return first.join(uses.groupBy("item").agg(F.count_distinct("entity").alias("entities")), "item")


def _ranked(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _per_entity(uses: DataFrame) -> DataFrame:
    """item, entity, n, first year, last year, the title of the first use (smallest record on ties)."""
    return uses.groupBy("item", "entity").agg(F.count("*").alias("n"), F.min("year").alias("year"), F.max("year").alias("last"), F.min(F.struct("year", "record", "title")).alias("f")).select("item", "entity", "n", "year", "last", F.col("f.title").alias("title"))


def early_adopters(uses: DataFrame, attrs: DataFrame, life: DataFrame, k: int = 6, lookback: tuple[int, int] = (3, 1), uses_least: tuple[int, int] = (2, 3), after: int = 2) -> DataFrame:
    """item, rank, entity, name, year, n: notable entities whose uses begin in the run up to take-off and that came back to the item;
    items with an older meaning (poly) get a narrower run and need more uses."""
    pick = lambda pair: F.when(F.col("poly"), pair[1]).otherwise(pair[0])
    run = uses.join(life.where("takeoff is not null"), "item").join(attrs.where("notable").select("entity", "name"), "entity")
    lo = F.coalesce("emerged", "takeoff") - pick(lookback)
    run = run.where((F.col("year") >= lo) & (F.col("year") <= F.col("takeoff") + after))
    per = run.groupBy("item", "entity", "name", "takeoff", "poly").agg(F.count("*").alias("n"), F.min(F.struct("year", "record", "title")).alias("f"))
    per = per.where((F.col("n") >= pick(uses_least)) & (F.col("f.year") <= F.col("takeoff")))
    per = per.select("item", "entity", "name", F.col("f.year").alias("year"), F.col("f.title").alias("title"), "n")
    return _ranked(per, [F.asc("year"), F.desc("n"), F.asc("entity")], k)


def popularizers(uses: DataFrame, attrs: DataFrame, life: DataFrame, k: int = 5, around: tuple[int, int] = (-2, 1), catalogue: int = 25) -> DataFrame:
    """item, rank, entity, name, year, n, score: those who drove it around take-off: log1p(sitelinks, at least 1) x uses."""
    who = attrs.where(F.col("notable") & (F.col("records") >= catalogue)).select("entity", "name", "sitelinks")
    w = uses.join(life.where("takeoff is not null").select("item", "takeoff"), "item").where(F.col("year").between(F.col("takeoff") + around[0], F.col("takeoff") + around[1]))
    per = _per_entity(w).join(who, "entity").withColumn("score", F.log1p(F.greatest("sitelinks", F.lit(1)).cast("double")) * F.col("n"))
    return _ranked(per, [F.desc("score"), F.asc("entity")], k).select("item", "rank", "entity", "name", "year", "title", "n", "score")


def signature(uses: DataFrame, attrs: DataFrame, k: int = 5, least: int = 5) -> DataFrame:
    """item, rank, entity, name, n, share of the catalogue, first and last year."""
    per = _per_entity(uses).where(F.col("n") >= least).join(attrs.where("notable").select("entity", "name", "records"), "entity")
    return _ranked(per.withColumn("share", F.col("n") / F.col("records")), [F.desc("n"), F.asc("entity")], k).select("item", "rank", "entity", "name", "n", "share", F.col("year").alias("y0"), F.col("last").alias("y1"))
