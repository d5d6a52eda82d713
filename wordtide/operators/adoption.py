"""Adoption: the share of a genre's active entities that use an item in a year, on a dense grid of years.

uses(record, entity, genre, year, item): distinct by record and item. active(record, entity, genre, year): every record, so that those
without any item count in the denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import once, pct
from . import presence as P


def totals(active: DataFrame) -> DataFrame:
    """genre, year, records, entities."""
    return active.groupBy("genre", "year").agg(F.count("*").alias("records"), F.count_distinct("entity").alias("entities"))


def dense_totals(whole: DataFrame, y0: int, y1: int) -> DataFrame:
    """genre, year, records, entities for every year from y0 to y1, 0 in years without records."""
    grid = whole.select("genre").distinct().withColumn("year", F.explode(F.sequence(F.lit(y0), F.lit(y1))))
    return grid.join(whole.select("genre", F.col("year").cast("int").alias("year"), "records", "entities"), ["genre", "year"], "left").fillna({"records": 0, "entities": 0})


def adoption(uses: DataFrame, active: DataFrame) -> DataFrame:
    """genre, year, item, records, entities, entities_tot, pct, pct_records. A record counts once an item."""
    n = uses.groupBy("genre", "year", "item").agg(F.count("*").alias("records"), F.count_distinct("entity").alias("entities"))
    return rates(n, totals(active))


def rates(counts: DataFrame, whole: DataFrame) -> DataFrame:
    """adoption() of counts(genre, year, item, records, entities) that are at hand, over totals(genre, year, records, entities)."""
    t = whole.select("genre", "year", F.col("records").alias("records_tot"), F.col("entities").alias("entities_tot"))
    joined = counts.join(t, ["genre", "year"])
    return joined.select("genre", "year", "item", "records", "entities", "entities_tot", pct(F.col("entities"), F.col("entities_tot")).alias("pct"), pct(F.col("records"), F.col("records_tot")).alias("pct_records"))


def pool_rates(entity_year_item: DataFrame, active: DataFrame, pool: DataFrame, focal: str) -> DataFrame:
    """adoption() in the focal genre by the pool(entity) alone: others count neither as users nor as active."""
    own = active.where(F.col("genre") == focal).join(pool, "entity", "left_semi")
    used = entity_year_item.join(pool, "entity", "left_semi").groupBy("year", "item").agg(F.sum("records").alias("records"), F.count_distinct("entity").alias("entities"))
    return rates(used.withColumn("genre", F.lit(focal)), totals(own))


def pool_shares(present: DataFrame, active: DataFrame, pool: DataFrame, focal: str) -> DataFrame:
    """genre, year, item, entities, entities_tot, pct by the pool(entity) alone, as pool_rates() has them, from presence tables:
    present(genre, year, item) of uses and active(genre, year) of records. No use is joined with the pool."""
    members = P.presence(pool.distinct())
    own = F.col("genre") == focal
    n = P.entities_within(present.where(own), members, "genre", "year", "item")
    whole = P.entities_within(active.where(own), members, "genre", "year").withColumnRenamed("entities", "entities_tot")
    return n.join(whole, ["genre", "year"]).select("genre", "year", "item", "entities", "entities_tot", pct(F.col("entities"), F.col("entities_tot")).alias("pct"))


def curve_arrays(adopted: DataFrame, y0: int, y1: int, genres: DataFrame | None = None) -> DataFrame:
    """genre, item, c: curve() as an array of (year, r, s, n) in order of years, for every item and genre.

    Rates are gathered by item, which is the only shuffle; genres(genre) are a small dimension that is broadcast. Without it they are
    read from adopted, which then runs twice."""
    genres = genres if genres is not None else adopted.select("genre").distinct()
    had = adopted.groupBy("item").agg(F.collect_list(F.struct("genre", "year", F.col("pct").alias("r"), F.col("entities").alias("n"))).alias("had"))
    own = F.filter("had", lambda x: (x.genre == F.col("genre")) & x.year.between(y0, y1))
    by_year = F.map_from_entries(F.transform(own, lambda x: F.struct(x.year.cast("int").alias("year"), x)))
    dense = had.crossJoin(F.broadcast(genres.select("genre"))).select("genre", "item", by_year.alias("had"))
    at = lambda y, field: F.coalesce(F.try_element_at("had", y)[field], F.lit(0))
    rows = F.transform(F.sequence(F.lit(y0), F.lit(y1)), lambda y: F.struct(y.alias("year"), at(y, "r").alias("r"), at(y, "n").alias("n")))
    return smooth_arrays(dense.select("genre", "item", rows.alias("c")))


def smooth_arrays(df: DataFrame) -> DataFrame:
    """c with s, the centred mean of r over three years (two at the ends), behind year and r. Other columns stay."""
    around = lambda i: F.slice("c", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.r) / F.size(xs)
    rest = [f.name for f in df.schema["c"].dataType.elementType.fields if f.name not in ("year", "r")]
    c = F.transform("c", lambda x, i: F.struct(x.year.alias("year"), x.r.alias("r"), mean(around(i)).alias("s"), *[x[f].alias(f) for f in rest]))
    return once(df, "c", c)


def curve(adopted: DataFrame, y0: int, y1: int, genres: DataFrame | None = None) -> DataFrame:
    """genre, item, year, r, s, n: raw rate, mean of three years around, users. Missing years are zeros, also for smoothing."""
    return curve_arrays(adopted, y0, y1, genres).select("genre", "item", F.inline("c"))


def smooth(dense: DataFrame, keys: list[str]) -> DataFrame:
    """Adds s, the centred mean of r over three years (two at the ends)."""
    around = W.partitionBy(*keys).orderBy("year").rowsBetween(-1, 1)
    return dense.withColumn("s", F.avg("r").over(around))
