"""Regions: curves, distinctive items, take-off and origin. regions(entity, region) maps part of the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import pct
from . import presence as P
from .adoption import smooth_arrays
from .context import log_odds
from .lifecycle import series, years_where


def _present(rows: DataFrame, *keys: str) -> DataFrame:
    """A presence table over those keys, of uses or of a presence table over more."""
    return P.joined(rows, *keys) if "bits" in rows.columns else P.presence(rows, *keys)


def members(regions: DataFrame) -> DataFrame:
    """regions(entity, region) as a presence table."""
    return P.presence(regions.where("region is not null"), "region")


def active_by_year(active: DataFrame, regions: DataFrame) -> DataFrame:
    """region, year, active: entities of the region with a record that year."""
    return P.entities_within(_present(active, "year"), members(regions), "year").select("region", "year", F.col("entities").alias("active"))


def regional_arrays(uses: DataFrame, active: DataFrame, regions: DataFrame, y0: int, y1: int, valid_from: int = 0) -> DataFrame:
    """item, region, c: regional_curves() as an array of (year, r, s, n, active, valid) in order of years.

    uses(item, year) and active(year): rows with their entity, or presence tables; both meet the regions as presence words, so uses are
    shuffled once, before they are joined with anything. Counts are gathered by item; the regions' active entities by year are a small
    dimension, one row a region."""
    who = members(regions)
    n = P.entities_within(_present(uses, "item", "year"), who, "item", "year")
    had = n.groupBy("item").agg(F.collect_list(F.struct("region", "year", F.col("entities").alias("n"))).alias("had"))  # regions x years
    den = P.entities_within(_present(active, "year"), who, "year")
    den = regions.where("region is not null").select("region").distinct().join(den, "region", "left").groupBy("region").agg(F.collect_list(F.when(F.col("year").isNotNull(), F.struct(F.col("year").cast("int").alias("year"), "entities"))).alias("den"))
    years = F.sequence(F.lit(y0), F.lit(y1))
    by_year = lambda xs, value: F.map_from_entries(F.transform(xs, lambda x: F.struct(x.year.cast("int").alias("year"), x[value])))
    rows = had.crossJoin(den)  # each item with each region, as asked for
    rows = rows.select("item", "region", by_year(F.filter("had", lambda x: (x.region == F.col("region")) & x.year.between(y0, y1)), "n").alias("had"), by_year(F.col("den"), "entities").alias("den"))
    at = lambda xs, y: F.coalesce(F.try_element_at(xs, y), F.lit(0).cast("long"))

    def year(y):
        n, a = at("had", y), at("den", y)
        ok = (a >= valid_from) & (a > 0)
        return F.struct(y.alias("year"), F.when(ok, pct(n, a)).otherwise(0.0).alias("r"), n.alias("n"), a.alias("active"), ok.alias("valid"))

    return smooth_arrays(rows.select("item", "region", F.transform(years, year).alias("c")))


def regional_curves(uses: DataFrame, active: DataFrame, regions: DataFrame, y0: int, y1: int, valid_from: int = 0) -> DataFrame:
    """item, region, year, r, s, n, active, valid: years with fewer than valid_from active entities, or none, are 0 before smoothing."""
    return regional_arrays(uses, active, regions, y0, y1, valid_from).select("item", "region", F.inline("c"))


def ever_share(uses: DataFrame, active: DataFrame, regions: DataFrame) -> DataFrame:
    """item, region, ever: share of the region's entities that ever used the item, in percent. uses, active: rows or presence tables."""
    who = members(regions)
    whole = P.entities_within(_present(active), who).withColumnRenamed("entities", "all")
    n = P.entities_within(_present(uses, "item"), who, "item")
    return n.join(whole, "region").select("item", "region", pct(F.col("entities"), F.col("all")).alias("ever"))


def distinctive(uses: DataFrame, active: DataFrame, regions: DataFrame, strength: float = 2000.0, least: int = 6, least_share: float = 0.015, times: float = 2.0, z: float = 3.0) -> DataFrame:
    """era (if there), region, item, n, share, rest, z: items that a region's entities use far more than all others'. uses, active: rows
    or presence tables."""
    keys = ["era"] if "era" in uses.columns else []
    who = members(regions)
    y = P.entities_within(_present(uses, *keys, "item"), who, *keys, "item").withColumnRenamed("entities", "y")
    trials = P.entities_within(_present(active, *keys), who, *keys).withColumnRenamed("entities", "n")
    df = log_odds(y, strength, keys, "region", trials=trials)
    df = df.withColumn("share", pct(F.col("y1"), F.col("n1"))).withColumn("rest", pct(F.col("y2"), F.col("n2")))
    ok = (F.col("y1") >= F.greatest(F.lit(float(least)), F.col("n1") * least_share)) & (F.col("share") >= F.col("rest") * times) & (F.col("z") > z)
    return df.where(ok).select(*keys, "region", "item", F.col("y1").alias("n"), "share", "rest", "z")


def name_tokens(names: DataFrame, dictionary: DataFrame | None = None, longer_than: int = 2) -> DataFrame:
    """word: pieces of names that no dictionary has."""
    words = names.select(F.explode(F.split(F.translate(F.lower("name"), ".$", " s"), r"\s+")).alias("word")).where(F.length("word") > longer_than).distinct()
    return words if dictionary is None else words.join(dictionary, "word", "left_anti")


def place_words(places: DataFrame, longer_than: int = 3) -> DataFrame:
    return places.select(F.explode(F.split(F.translate(F.lower("place"), ",-", "  "), r"\s+")).alias("word")).where(F.length("word") > longer_than).distinct()


def split_places(found: DataFrame, places: DataFrame, dropped: DataFrame | None = None, k_words: int = 30, k_places: int = 8) -> DataFrame:
    """found without dropped words, with is_place and rank: the highest z of either list in each era and region."""
    if dropped is not None:
        found = found.join(dropped.select(F.col("word").alias("item")).distinct(), "item", "left_anti")
    mark = places.select(F.col("word").alias("item")).distinct().withColumn("is_place", F.lit(True))
    found = found.join(mark, "item", "left").withColumn("is_place", F.coalesce("is_place", F.lit(False)))
    keys = [c for c in ("era", "region") if c in found.columns]
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "is_place").orderBy(F.desc("z"), "item")))
    return ranked.where(F.col("rank") <= F.when(F.col("is_place"), k_places).otherwise(k_words))


def regional_takeoff(curves: DataFrame, least_peak: float = 1.0, min_users: int = 5, frac: float = 0.25) -> DataFrame:
    """item, region, year, established, level: start of the climb to the peak; it can't cross a year that isn't valid, and if it touches
    one, or the first year, the region had the item when it became measurable."""
    ser = series(curves, ("item", "region")).where((F.col("P") >= least_peak) & (F.col("n_py") >= min_users))
    breaks = years_where(F.col("c"), lambda x: (x.year < F.col("py")) & ((x.s < F.lit(frac) * F.col("P")) | ~x.valid))
    ser = ser.withColumn("stop", F.array_max(breaks)).withColumn("year", F.coalesce(F.col("stop") + 1, F.col("y0")))
    at = lambda y, field: F.get(F.filter("c", lambda x: x.year == y), F.lit(0))[field]
    established = F.col("stop").isNull() | ~at(F.col("stop"), "valid")
    return ser.select("item", "region", "year", established.alias("established"), at(F.col("year"), "s").alias("level"))


def origin(takeoffs: DataFrame, least_regions: int = 2) -> DataFrame:
    """item, origin, year, established, others, lead: the earliest region (the heavier user on ties, then by name) and how many years
    the median of the others came later."""
    order = W.partitionBy("item").orderBy("year", F.desc("level"), "region")
    ranked = takeoffs.withColumn("k", F.row_number().over(order)).withColumn("regions", F.count("*").over(W.partitionBy("item")))
    ranked = ranked.where(F.col("regions") >= least_regions)
    first = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    df = ranked.groupBy("item").agg(first("region").alias("origin"), first("year").alias("year"), first("established").alias("established"), F.percentile(F.when(F.col("k") > 1, F.col("year")), F.lit(0.5)).alias("others"))
    return df.withColumn("lead", F.col("others") - F.col("year"))


def diffusion_choice(origins: DataFrame, featured: list[str], from_year: int = 1993, lead: float = 3.0, featured_lead: float = 1.0, others: int = 8) -> DataFrame:
    """The featured items that lead at all, and the clearest of the rest."""
    own = origins.where(F.col("item").isin(featured) & (F.col("lead") >= featured_lead))
    rest = origins.where(~F.col("item").isin(featured) & ~F.col("established") & (F.col("year") >= from_year) & (F.col("lead") >= lead)).orderBy(F.desc("lead"), "item").limit(others)
    return own.unionByName(rest)
