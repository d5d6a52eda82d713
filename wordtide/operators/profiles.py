"""Profiles: all that is known of an item, as one nested document.

Each part is a table by item with one struct, map or array an item; profiles() merges them by item. Curves, life and crossover come from the arrays of
curve_arrays(); people and regions from guarded uses(record, entity, year, item, title) of the focal genre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import half_even
from . import lifecycle as L
from . import people as P
from . import regional as R


def _column(c: Column, field: str, digits: int | None = None) -> Column:
    return F.transform(c, lambda x: half_even(x[field], digits) if digits is not None else x[field])


def life(curves: DataFrame, focal: str, lex: DataFrame, takeoff: float = 0.25, emerge: float = 0.10, min_users: int = 5) -> DataFrame:
    """item, poly, peak_year, peak, now, emerged, takeoff, stage of the items that the focal genre used; peak and now unrounded."""
    own = curves.where(F.col("genre") == focal)
    ser = L.with_rise(L.with_rise(L.series(own), "emerged", emerge, min_users), "takeoff", takeoff, min_users).where("P > 0")
    ser = ser.withColumn("now", L.now_level(F.col("c"))).select("item", F.col("py").alias("peak_year"), F.col("P").alias("peak"), "now", "emerged", "takeoff")
    ser = ser.join(L.stage(own).drop("genre"), "item")
    return ser.join(lex.select(F.col("id").alias("item"), F.coalesce("poly", F.lit(False)).alias("poly")), "item")


def crossings(curves: DataFrame, focal: str, takeoff: float = 0.25, min_users: int = 5) -> DataFrame:
    """item, cross: a map from each other genre to its peak, peak_year, takeoff, lag and reach."""
    rows = L.crossover(curves, focal, takeoff, min_users)
    fact = F.struct(half_even(F.col("peak"), 3).alias("peak"), "peak_year", "takeoff", "lag", half_even(F.col("reach"), 3).alias("reach"))
    return rows.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("genre", fact.alias("x"))))).alias("cross"))


def _listed(ranked: DataFrame, name: str, *fields: Column) -> DataFrame:
    """item, name: the ranked rows of an item as an array in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("x"))))
    return ranked.groupBy("item").agg(F.transform(rows, lambda r: r.x).alias(name))


def people(uses: DataFrame, attrs: DataFrame, life: DataFrame) -> DataFrame:
    """item, total_entities, people(first_seen, early, popularizers, signature)."""
    who, year, title = F.col("name").alias("artist"), F.col("year").cast("int").alias("year"), F.col("title")
    run = life.select("item", "emerged", "takeoff", "poly")
    early = _listed(P.early_adopters(uses, attrs, run), "early", who, year, title)
    drove = _listed(P.popularizers(uses, attrs, run), "popularizers", who, year, F.col("n").alias("songs"), title)
    sign = _listed(P.signature(uses, attrs), "signature", who, F.col("n").alias("songs"), half_even(F.col("share"), 3).alias("share"), F.array(F.col("y0").cast("int"), F.col("y1").cast("int")).alias("years"))
    out = P.first_seen(uses).join(early, "item", "left").join(drove, "item", "left").join(sign, "item", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("item", F.col("entities").alias("total_entities"), F.struct(F.col("first_seen").cast("int").alias("first_seen"), none("early"), none("popularizers"), none("signature")).alias("people"))


def regions(uses: DataFrame, active: DataFrame, ever_active: DataFrame, regions: DataFrame, y0: int, y1: int) -> DataFrame:
    """item, regions: a map from each region to its smoothed curve, the share of its entities that ever used the item, and its entity-years
    between y0 and y1. active(entity, year) within those years; ever_active(entity) at any time."""
    curves = R.regional_arrays(uses.select("item", "entity", "year"), active, regions, y0, y1)
    rows = curves.join(R.ever_share(uses, ever_active, regions), ["item", "region"], "left")
    entities = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x.active)
    fact = F.struct(_column(F.col("c"), "s", 3).alias("curve"), half_even(F.coalesce("ever", F.lit(0.0)), 2).alias("ever"), entities.alias("entity_years"))
    return rows.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", fact.alias("x"))))).alias("regions"))


def profiles(lex: DataFrame, curves: DataFrame, life: DataFrame, focal: str, takeoff: float = 0.25, min_users: int = 5, people: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """A row for each item of life: id, label, cat, gloss, poly, region_hint, focal (smoothed), focal_raw, focal_n, genres (smoothed, by
    genre), life, cross, people, regions. Rates have three digits. Without people or regions those are null."""
    ser = curves.select("item", "genre", "c")
    own = ser.where(F.col("genre") == focal).select("item", _column(F.col("c"), "s", 3).alias("focal"), _column(F.col("c"), "r", 3).alias("focal_raw"), _column(F.col("c"), "n").alias("focal_n"))
    other = ser.where(F.col("genre") != focal).groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("genre", _column(F.col("c"), "s", 3).alias("s"))))).alias("genres"))
    words = lex.select(F.col("id").alias("item"), "label", "cat", "gloss", F.col("region").alias("region_hint"))
    df = life.join(words, "item").join(own, "item").join(other, "item", "left").join(crossings(curves, focal, takeoff, min_users), "item", "left")
    if people is not None:
        df = df.join(people, "item", "left")
    else:
        df = df.select("*", F.lit(None).cast("long").alias("total_entities"), F.lit(None).cast("string").alias("people"))
    if regions is not None:
        df = df.join(regions, "item", "left")
    else:
        df = df.withColumn("regions", F.lit(None).cast("string"))
    facts = F.struct("peak_year", half_even(F.col("peak"), 3).alias("peak"), half_even(F.col("now"), 3).alias("now"), "emerged", "takeoff", "stage", "total_entities")
    return df.select(F.col("item").alias("id"), "label", "cat", "gloss", "poly", "region_hint", "focal", "focal_raw", "focal_n", "genres", facts.alias("life"), "cross", "people", "regions")
