"""Names of entities matched against items of a knowledge base, by tiers; origins picked by a ladder of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import collated, keyed

TIERS = ("slug", "exact_label", "exact_alias", "plain", "dollar")


def match_names(names: DataFrame, labels: DataFrame, aliases: DataFrame, slugs: DataFrame, attrs: DataFrame, dictionary: DataFrame | None = None, youngest: int = 12, well_known: int = 10) -> DataFrame:
    """entity, item, method, candidates: for each entity the first tier that yields candidates, and of those the best.

    names(entity, name, records, last_year); labels(item, name); aliases(item, name); slugs(item, slug); attrs(item, birth_year, sitelinks,
    focal boolean, num long). A slug key belongs to the entity with most records. Guards: the catalogue must not end before the person
    was `youngest`; an item with slugs of other names is someone else (for aliases, only where the name is generic); a generic name (at most
    4 characters, or in the dictionary) needs a well-known item unless it is an exact label. Best: focal, sitelinks, lowest number."""
    n = names.withColumn("exact", keyed(F.col("name"), "exact")).withColumn("plain", keyed(F.col("name"), "plain")).withColumn("dollar", F.when(F.col("name").contains("$"), keyed(F.col("name"), "dollar")))
    generic = F.length("plain") <= 4
    if dictionary is not None:
        n = n.join(dictionary.select(F.col("word").alias("plain"), F.lit(True).alias("listed")).distinct(), "plain", "left")
        generic = generic | F.coalesce("listed", F.lit(False))
    n = n.withColumn("generic", generic)
    both = labels.unionByName(aliases).distinct()
    exact = lambda df: df.select("item", keyed(F.col("name"), "exact").alias("key")).distinct()
    plain = both.select("item", keyed(F.col("name"), "plain").alias("key")).where(F.length("key") >= 3).distinct()
    dollar = both.where(F.col("name").contains("$") | F.lower("name").contains("s")).select("item", keyed(F.col("name"), "dollar").alias("key")).where(F.length("key") >= 3).distinct()
    slug = slugs.select("item", keyed(F.translate("slug", "-", " "), "plain").alias("key")).where(F.length("key") >= 2).distinct()
    owner = W.partitionBy("plain").orderBy(F.desc("records"), "entity")
    tiers = [
        (n.withColumn("k", F.row_number().over(owner)).where("k = 1").drop("k"), "plain", slug),
        (n, "exact", exact(labels)), (n, "exact", exact(aliases)), (n, "plain", plain), (n.where("dollar is not null"), "dollar", dollar),
    ]
    cols = ["entity", "plain", "generic", "last_year"]
    found = None
    for tier, (who, key, index) in enumerate(tiers):
        rows = who.select(*cols, F.col(key).alias("key")).join(index, "key").select(*cols, "item", F.lit(tier).alias("tier"))
        found = rows if found is None else found.unionByName(rows)
    own_slugs = slug.groupBy("item").agg(F.collect_set("key").alias("keys"))
    found = found.join(attrs, "item").join(own_slugs, "item", "left")
    plausible = F.col("birth_year").isNull() | (F.col("last_year") >= F.col("birth_year") + youngest)
    other = F.col("keys").isNotNull() & ~F.array_contains("keys", F.col("plain")) & ((F.col("tier") != 2) | F.col("generic"))
    obscure = (F.col("tier") != 1) & F.col("generic") & (F.col("sitelinks") < well_known)
    found = found.where(plausible & ((F.col("tier") == 0) | (~other & ~obscure)))
    first = W.partitionBy("entity")
    found = found.withColumn("best", F.min("tier").over(first)).where("tier = best").withColumn("candidates", F.count("*").over(first))
    order = first.orderBy(F.desc("focal"), F.desc("sitelinks"), "num")
    method = F.element_at(F.array(*[F.lit(t) for t in (*TIERS[:4], "plain")]), F.col("tier") + 1)
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").select("entity", "item", method.alias("method"), "candidates")


#: Steps of the ladder, best first.
LADDER = ("formation", "encyclopedia_origin", "genre+place", "genre", "residence", "birthplace", "members_birthplace", "country_only")


def assign_origin(items: DataFrame, claims: DataFrame, places: DataFrame, genres: DataFrame, mapped: list[str], home: str = "US", grown: int = 18) -> DataFrame:
    """item, place, region, scene, source: the first step of LADDER that holds.

    items(item, birth_year); claims(item, kind, ord, place, start): kind formed, origin, residence, birth, member, country; places(place,
    state, country, lat, is_country, region, scene); genres(item, region, scene): what an item's genres say. mapped: regions that residence
    counts for. A formation or origin that is only a state or country is sharpened by a finer place inside it (source "+refined").
    Genres: a place in the genre's scene, else in its region; else the genre alone if all agree or no place is known. A residence counts if
    no birthplace has a region, or that is unmapped, or the same, or the move came by the age of `grown`."""
    c = claims.join(places, "place").withColumn("coarse", F.col("lat").isNull())
    ranked = lambda df, *order: df.withColumn("k", F.row_number().over(W.partitionBy("item").orderBy(*order))).where("k = 1").drop("k")
    cols = ["item", "place", "region", "scene"]
    steps = []

    finer = c.where(F.col("kind").isin("origin", "residence", "birth") & ~F.col("coarse")).select("item", F.col("place").alias("f_place"), F.col("region").alias("f_region"), F.col("scene").alias("f_scene"), F.col("state").alias("f_state"), F.col("country").alias("f_country"), F.element_at(F.create_map(F.lit("origin"), F.lit(0), F.lit("residence"), F.lit(1), F.lit("birth"), F.lit(2)), F.col("kind")).alias("f_kind"), F.col("ord").alias("f_ord"))
    for step, kind in ((0, "formed"), (1, "origin")):
        top = ranked(c.where((F.col("kind") == kind) & F.col("region").isNotNull()), "ord", "place")
        both = top.join(finer.withColumnRenamed("item", "f_item"), (F.col("f_item") == F.col("item")) & F.col("coarse") & (F.col("f_country") == F.col("country")) & (F.col("is_country") | (F.col("f_state") == F.col("state"))), "left")
        both = ranked(both, "f_kind", "f_ord", "f_place")
        use = F.col("f_place").isNotNull()
        steps.append(both.select("item", F.when(use, F.col("f_place")).otherwise(F.col("place")).alias("place"), F.when(use, F.col("f_region")).otherwise(F.col("region")).alias("region"), F.when(use, F.col("f_scene")).otherwise(F.col("scene")).alias("scene"), F.lit(step).alias("step"), F.when(use, F.lit(LADDER[step] + "+refined")).otherwise(F.lit(LADDER[step])).alias("source")))

    g = genres.select("item", F.col("region").alias("g_region"), F.col("scene").alias("g_scene")).distinct()
    lived = c.where(F.col("kind").isin("residence", "birth")).withColumn("kind_ord", F.when(F.col("kind") == "residence", 0).otherwise(1))
    hit = g.join(lived, "item").withColumn("how", F.when(F.col("scene") == F.col("g_scene"), 0).when(F.col("region") == F.col("g_region"), 1)).where("how is not null")
    hit = ranked(hit, "how", F.col("g_scene").isNull(), "coarse", "kind_ord", "ord", "place", "g_region")
    exact = F.col("how") == 0
    steps.append(hit.select("item", "place", F.when(exact, F.col("region")).otherwise(F.col("g_region")).alias("region"), F.when(exact, F.col("scene")).otherwise(F.coalesce("g_scene", "scene")).alias("scene"), F.lit(2).alias("step"), F.lit(LADDER[2]).alias("source")))
    said = g.groupBy("item").agg(F.count_distinct("g_region").alias("regions"), F.min(F.struct(F.col("g_scene").isNull().alias("none"), "g_region", "g_scene")).alias("m"))
    some = ranked(lived, F.desc("kind_ord"), "ord", "place").select("item", "place", F.lit(True).alias("some"))
    said = said.join(some, "item", "left").where("regions = 1 or some is null")
    steps.append(said.select("item", "place", F.col("m.g_region").alias("region"), F.col("m.g_scene").alias("scene"), F.lit(3).alias("step"), F.lit(LADDER[3]).alias("source")))

    born = ranked(c.where((F.col("kind") == "birth") & F.col("region").isNotNull()), "ord", "place")
    home_of = c.where((F.col("kind") == "residence") & F.col("region").isin(mapped)).join(born.select("item", F.col("region").alias("b_region")), "item", "left").join(items, "item", "left")
    early = F.coalesce(F.col("start") - F.col("birth_year") <= grown, F.lit(False))
    counts = F.col("b_region").isNull() | (~F.col("coarse") & (~F.col("b_region").isin(mapped) | (F.col("b_region") == F.col("region")) | early))
    steps.append(ranked(home_of.where(counts), "ord", "place").select(*cols, F.lit(4).alias("step"), F.lit(LADDER[4]).alias("source")))
    steps.append(born.select(*cols, F.lit(5).alias("step"), F.lit(LADDER[5]).alias("source")))
    most = W.partitionBy("item", "region", "scene")
    member = c.where((F.col("kind") == "member") & F.col("region").isNotNull()).withColumn("votes", F.count("*").over(most)).withColumn("seen", F.min("ord").over(most))
    steps.append(ranked(member, F.desc("votes"), "seen", "ord", "place").select(*cols, F.lit(6).alias("step"), F.lit(LADDER[6]).alias("source")))
    abroad = c.where((F.col("kind") == "country") & F.col("country").isNotNull() & (F.col("country") != home))
    steps.append(ranked(abroad, "ord", "place").select(*cols, F.lit(7).alias("step"), F.lit(LADDER[7]).alias("source")))

    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    return ranked(every, "step").select("item", "place", "region", "scene", "source")


def search_fallback(names: DataFrame, hits: DataFrame, matched: DataFrame, least_records: int, cap: int, score: int = 95) -> DataFrame:
    """entity, base_id: unmatched entities with many records (at most `cap`, what a rate-limited search service allows; the rest can be
    searched later), whose top hit scores enough and has the same plain name. hits(entity, base_id, rank, score, names array<string>)."""
    todo = names.where(F.col("records") >= least_records).join(matched.select("entity"), "entity", "left_anti").orderBy(F.desc("records"), "entity").limit(cap)
    top = hits.where((F.col("rank") == 1) & (F.col("score") >= score)).select("entity", "base_id", F.explode("names").alias("other"))
    both = todo.join(top, "entity").where((keyed(F.col("other"), "plain") == keyed(F.col("name"), "plain")) & (keyed(F.col("name"), "plain") != ""))
    return both.select("entity", "base_id").distinct()


def spelling_variants(names: DataFrame, name: str = "name", least: int = 2) -> DataFrame:
    """name (the first in binary order), variants, rows: names that differ in case and accents only, if there are at least `least` spellings."""
    own = F.col(name).cast("string")
    by = names.where(own.isNotNull()).groupBy(own.alias("spelling")).agg(F.count("*").alias("n"))
    out = by.groupBy(collated(F.col("spelling")).alias("key")).agg(F.min(F.collate("spelling", "UTF8_BINARY")).alias("name"), F.count("*").alias("variants"), F.sum("n").alias("rows"))
    return out.where(F.col("variants") >= least).select("name", "variants", "rows")


def collated_match(names: DataFrame, entries: DataFrame) -> DataFrame:
    """names(name, ...) with entries(label, ...) of the same name in any case and with any accents, in one join without Python workers."""
    return names.withColumn("_key", collated(F.col("name"))).join(entries.withColumn("_key", collated(F.col("label"))), "_key").drop("_key")
