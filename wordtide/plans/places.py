"""Entity resolution over the star schema: customers and suppliers live in nations, nations lie in regions, and what is known of a customer
are triples. The small tables of hand-made cases here are what tests hold the same operators and SQL against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo as G
from ..operators import matching as M
from .registry import query, rounded, table

# place, label, lat, lon, codes, countries, parents in order
PLACES = [
    ("US", "United States", 39.0, -98.0, [], [], []),
    ("GB", "United Kingdom", 54.0, -2.0, [], ["GB"], []),
    ("CA", "Canada", 60.0, -95.0, [], [], []),
    ("s1", "Northstate", 41.0, -74.0, ["x", "US-NJ"], ["US"], ["US"]),
    ("s2", "Eaststate", 40.9, -77.8, ["US-PA"], ["US"], ["US"]),
    ("s3", "Longname", 35.0, -80.0, ["US-LNG"], ["US"], ["US"]),
    ("dc", "Capital", 38.9, -77.0, ["US-DC"], ["US"], ["US"]),
    ("c1", "Harbour", None, None, [], ["US"], ["s1", "US"]),
    ("t1", "Riverton", 39.94, -75.12, [], ["US"], ["c1"]),
    ("t2", "Quarter", None, None, [], [], ["t1"]),
    ("t3", "Hilltop", 40.73, -74.17, [], ["US"], ["c1"]),
    ("p1", "Oldtown", 39.95, -75.16, [], ["US"], ["q1", "s2"]),
    ("q1", "District", 39.96, -75.2, [], ["US"], ["q2"]),
    ("q2", "Loop", 39.9, -75.3, [], ["US"], ["q1", "p1"]),
    ("e1", "Shire", 52.0, -1.0, ["GB-SHR"], ["GB"], ["GB"]),
    ("e2", "Borough", 51.5, -0.1, [], ["GB"], ["e1"]),
    ("m1", "Border", 45.0, -73.0, [], [], ["e1", "s2"]),
    ("o1", "Orphan", 10.0, 10.0, [], [], ["nowhere"]),
    ("k1", "Prairie", 50.0, -100.0, ["CA-MB"], ["CA"], ["CA"]),
    ("l1", "Suburb", 35.1, -80.1, [], ["US"], ["s3"]),
    ("w1", "Ward", 38.91, -77.02, [], ["US"], ["dc"]),
]
CENTRES = [("Philly", 39.95, -75.16, 60.0, "US"), ("Metro", 40.71, -74.0, 80.0, "US"), ("Capital", 38.9, -77.03, 50.0, "US"), ("Thames", 51.51, -0.12, 40.0, "GB")]


def tables(spark):
    places = spark.createDataFrame([(p, lab, la, lo, codes) for p, lab, la, lo, codes, _, _ in PLACES], "place string, label string, lat double, lon double, codes array<string>")
    parents = spark.createDataFrame([(p, i, x) for p, *_, up in PLACES for i, x in enumerate(up)], "place string, ord int, parent string")
    countries = spark.createDataFrame([(p, i, x) for p, _, _, _, _, own, _ in PLACES for i, x in enumerate(own)], "place string, ord int, country string")
    return places, parents, countries


def star_places(spark, d):
    """places, parents, countries: customers with a point in nations; the nations of region 1 are states at home."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    n = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    at_home = F.col("n_regionkey") == 1
    letters = F.concat(F.chr(F.lit(65) + F.col("n_nationkey")), F.lit("Z"))
    who, where = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "n_nationkey")
    places = c.select(who.alias("place"), F.col("c_name").alias("label"), (F.lit(30.0) + F.col("c_custkey") % 20).alias("lat"), (F.lit(-80.0) - F.col("c_custkey") % 30).alias("lon"), F.array().cast("array<string>").alias("codes"))
    codes = F.array(F.when(at_home, F.concat(F.lit("US-"), letters)).otherwise(F.concat(F.lit("X"), F.chr(F.lit(65) + F.col("n_regionkey")), F.lit("-"), letters)))
    places = places.unionByName(n.select(where.alias("place"), F.col("n_name").alias("label"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), codes.alias("codes")))
    parents = c.select(who.alias("place"), F.lit(0).alias("ord"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    countries = n.select(where.alias("place"), F.lit(0).alias("ord"), F.when(at_home, "US").otherwise(F.col("r_name")).alias("country"))
    return places, parents, countries


@query(
    """WITH n AS (SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 'US' ELSE r_name END AS country, CASE WHEN n_regionkey = 1 THEN chr(65 + n_nationkey) || 'Z' ELSE n_name END AS state FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT 'c' || c_custkey AS place, c_name AS label, state, country, 30.0::DOUBLE + c_custkey % 20 AS lat, -80.0::DOUBLE - c_custkey % 30 AS lon, false AS is_country FROM customer JOIN n ON c_nationkey = n_nationkey
    UNION ALL SELECT 'n' || n_nationkey, n_name, state, country, NULL, NULL, false FROM n"""
)
def place_climb(spark, d):
    return G.resolve(*star_places(spark, d))


def closure_sql(pairs: str) -> str:
    """pairs: SQL of (place, parent)."""
    return f"""WITH RECURSIVE p(place, parent) AS ({pairs}), up AS (SELECT DISTINCT place AS a, place AS b, 0 AS steps, [place] AS path FROM p UNION ALL SELECT up.a, p.parent, steps + 1, list_append(path, p.parent) FROM up JOIN p ON p.place = up.b WHERE steps < 14 AND NOT list_contains(path, p.parent))
    SELECT a AS place, b AS parent, CAST(min(steps) AS BIGINT) AS steps FROM up GROUP BY a, b"""


LIVES = "SELECT 'c' || c_custkey AS place, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region"


@query(closure_sql(LIVES))
def place_closure(spark, d):
    pair = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), x).alias("place"), (F.concat(F.lit(b), y) if y else F.lit(b)).alias("parent"))
    lives = pair("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(pair("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    lives = lives.unionByName(pair("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(pair("region", "r", "r_regionkey", "world", None))
    return G.closure(lives, "place", "parent").withColumn("steps", F.col("steps").cast("long"))


SPOTS = [
    ("a", "NJ", "US", 40.73, -74.17), ("b", "NJ", "US", 39.93, -75.1), ("c", "NJ", "US", 39.4, -74.6), ("d", "PA", "US", 40.1, -75.3), ("e", "OH", "US", 41.5, -81.7),
    ("f", None, "US", 38.95, -77.1), ("g", "VA", "US", 38.95, -77.1), ("h", "WV", "US", 38.95, -77.1), ("i", "ENG", "GB", 51.6, -0.2), ("j", None, None, 40.7, -74.0), ("k", "NY", "US", None, None), ("l", None, "GB", 40.7, -74.0), ("m", "NJ", "US", None, None),
]


def _sql_rows(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def scene_sql(spots: str) -> str:
    """spots: SQL of (place, state, country, lat, lon)."""
    return f"""WITH s(place, state, country, lat, lon) AS ({spots}), c(scene, clat, clon, radius, ccountry) AS ({_sql_rows(CENTRES)}),
    h AS (SELECT *, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) AS km FROM s JOIN c
      ON (ccountry = country OR (country IS NULL AND ccountry = 'US')) AND (scene <> 'Capital' OR state IS NULL OR state IN ('DC', 'VA', 'MD')) WHERE lat IS NOT NULL),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY km, scene) AS k FROM h WHERE km <= radius) WHERE k = 1)
    SELECT s.place, CASE WHEN s.country = 'US' AND s.state = 'OH' THEN 'Ohio' WHEN s.country = 'US' AND s.state = 'NJ' AND s.lat IS NOT NULL THEN CASE WHEN n.scene = 'Philly' AND km < 30 THEN 'Philly' ELSE 'Garden' END ELSE n.scene END AS scene
    FROM s LEFT JOIN n ON n.place = s.place"""


def scenes(spark, spots):
    centres = spark.createDataFrame(CENTRES, "scene string, lat double, lon double, radius double, country string")
    return G.scene(spots, centres, {"OH": "Ohio"}, {"Capital": ["DC", "VA", "MD"]}, ("NJ", "Garden", "Philly", 30.0))


STATES = ["NJ", "PA", "OH", "VA", "MD", "NY"]


@query(scene_sql(f"""SELECT 'c' || c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN [{", ".join(f"'{x}'" for x in STATES)}][c_nationkey % 6 + 1] END, CASE c_custkey % 13 WHEN 0 THEN 'GB' WHEN 1 THEN NULL ELSE 'US' END,
    CASE WHEN c_custkey % 17 <> 0 THEN 38.7 + (c_custkey % 50) / 20.0::DOUBLE END, -77.2 + (c_custkey % 37) / 10.0::DOUBLE FROM customer"""))
def scene_nearest(spark, d):
    """Customers, with a point and a state by their keys, among a few centres."""
    k = F.col("c_custkey")
    state = F.when(k % 11 != 0, F.element_at(F.array(*map(F.lit, STATES)), (F.col("c_nationkey") % 6 + 1).cast("int")))
    country = F.when(k % 13 == 0, "GB").when(k % 13 == 1, F.lit(None)).otherwise("US")
    spots = table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("place"), state.alias("state"), country.alias("country"), F.when(k % 17 != 0, F.lit(38.7) + (k % 50) / 20.0).alias("lat"), (F.lit(-77.2) + (k % 37) / 10.0).alias("lon"))
    return scenes(spark, spots)


@query("SELECT n.n_nationkey AS place, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(n_nationkey * 2.0 - 10) / 2), 2) + cos(radians(10.0)) * cos(radians(n_nationkey * 2.0)) * pow(sin(radians(n_nationkey * 5.0 - 20) / 2), 2))), 3) AS km FROM nation n")
def great_circle(spark, d):
    from ..functions.names import haversine

    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey").cast("double")
    return rounded(n.select(F.col("n_nationkey").alias("place"), haversine(F.lit(10.0), F.lit(20.0), k * 2, k * 5).alias("km")), "km", digits=3)


NAMES = [(1, "Björk Stone", 90, 2010), (2, "A$tro", 80, 2015), (3, "bjork stone", 20, 2012), (4, "Rex", 70, 2015), (5, "Mc & Son", 60, 2001), (6, "Early Bird", 50, 1990), (7, "Nobody", 40, 2000), (8, "The Slug", 30, 2005), (9, "Twin", 5, 2003), (10, "Astro Boy", 5, 2011)]
LABELS = [("Q1", "Björk Stone"), ("Q2", "Astro"), ("Q4", "Rex"), ("Q5", "MC and Son"), ("Q6", "Early Bird"), ("Q8", "Someone Else"), ("Q9", "Twin"), ("Q19", "Twin"), ("Q10", "Boy Wonder")]
ALIASES = [("Q14", "Rex"), ("Q10", "Astro Boy"), ("Q20", "A$tro Boy")]
SLUGS = [("Q8", "The-slug"), ("Q1", "Bjork-stone"), ("Q9", "Other-twin")]
ATTRS = [("Q1", 1965, 40, True, 1), ("Q2", 1990, 3, True, 2), ("Q4", 1980, 2, False, 4), ("Q5", None, 12, True, 5), ("Q6", 1985, 9, True, 6), ("Q8", 1970, 5, True, 8), ("Q9", None, 50, True, 9), ("Q19", None, 7, False, 19), ("Q14", None, 99, True, 14), ("Q10", 1980, 4, False, 10), ("Q20", 1980, 4, True, 20)]


def names_sql(tables: str) -> str:
    """tables: SQL of n(entity, name, records, last_year), l(item, name), al(item, name), s(item, slug), a(item, birth_year, sitelinks, focal, num)."""
    return f"""WITH {tables},
    k AS (SELECT *, lower(name) AS ex, regexp_replace(replace(strip_accents(lower(name)), '&', 'and'), '[^a-z0-9]', '', 'g') AS pl, regexp_replace(replace(strip_accents(lower(replace(name, '$', 's'))), '&', 'and'), '[^a-z0-9]', '', 'g') AS dl FROM n),
    sl AS (SELECT item, regexp_replace(strip_accents(lower(replace(slug, '-', ' '))), '[^a-z0-9]', '', 'g') AS key FROM s),
    b AS (SELECT * FROM l UNION SELECT * FROM al), bp AS (SELECT DISTINCT item, regexp_replace(replace(strip_accents(lower(name)), '&', 'and'), '[^a-z0-9]', '', 'g') AS key FROM b),
    bd AS (SELECT DISTINCT item, regexp_replace(replace(strip_accents(lower(replace(name, '$', 's'))), '&', 'and'), '[^a-z0-9]', '', 'g') AS key FROM b WHERE contains(name, '$') OR contains(lower(name), 's')),
    f AS (SELECT k.*, item, 0 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY pl ORDER BY records DESC, entity) AS r FROM k) k JOIN sl ON sl.key = pl WHERE r = 1
      UNION ALL SELECT k.*, NULL, item, 1 FROM k JOIN (SELECT DISTINCT item, lower(name) AS key FROM l) ON key = ex UNION ALL SELECT k.*, NULL, item, 2 FROM k JOIN (SELECT DISTINCT item, lower(name) AS key FROM al) ON key = ex
      UNION ALL SELECT k.*, NULL, item, 3 FROM k JOIN bp ON bp.key = pl AND length(bp.key) >= 3 UNION ALL SELECT k.*, NULL, item, 4 FROM k JOIN bd ON bd.key = dl AND length(bd.key) >= 3 WHERE contains(k.name, '$')),
    g AS (SELECT f.*, a.*, EXISTS (SELECT 1 FROM sl WHERE sl.item = f.item) AND NOT EXISTS (SELECT 1 FROM sl WHERE sl.item = f.item AND sl.key = pl) AND (tier <> 2 OR length(pl) <= 4) AS other, tier <> 1 AND length(pl) <= 4 AND sitelinks < 10 AS obscure FROM f JOIN a ON a.item = f.item WHERE birth_year IS NULL OR last_year >= birth_year + 12),
    h AS (SELECT *, min(tier) OVER (PARTITION BY entity) AS best FROM g WHERE tier = 0 OR (NOT other AND NOT obscure)),
    r AS (SELECT *, count(*) OVER (PARTITION BY entity) AS candidates, row_number() OVER (PARTITION BY entity ORDER BY focal DESC, sitelinks DESC, num) AS k2 FROM h WHERE tier = best)
    SELECT CAST(entity AS BIGINT) AS entity, item, CASE tier WHEN 0 THEN 'slug' WHEN 1 THEN 'exact_label' WHEN 2 THEN 'exact_alias' ELSE 'plain' END AS method, candidates FROM r WHERE k2 = 1""".replace("SELECT k.*, item, 0 AS tier FROM (SELECT *,", "SELECT k.*, sl.item, 0 AS tier FROM (SELECT *,")


MADE = f"n(entity, name, records, last_year) AS ({_sql_rows(NAMES)}), l(item, name) AS ({_sql_rows(LABELS)}), al(item, name) AS ({_sql_rows(ALIASES)}), s(item, slug) AS ({_sql_rows(SLUGS)}), a(item, birth_year, sitelinks, focal, num) AS ({_sql_rows(ATTRS)})"


def made_names(spark):
    f = spark.createDataFrame
    return M.match_names(f(NAMES, "entity long, name string, records long, last_year int"), f(LABELS, "item string, name string"), f(ALIASES, "item string, name string"), f(SLUGS, "item string, slug string"), f(ATTRS, "item string, birth_year int, sitelinks int, focal boolean, num long"))


STAR_NAMES = """n AS (SELECT c_custkey AS entity, c_name AS name, count(o_orderkey) AS records, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    l AS (SELECT 'Q' || c_custkey AS item, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) ELSE replace(c_name, '#', ' No. ') END AS name FROM customer WHERE c_custkey % 4 IN (0, 3) UNION ALL SELECT 'P' || c_custkey, replace(c_name, '#', ' ') FROM customer WHERE c_custkey % 3 = 0),
    al AS (SELECT 'A' || c_custkey AS item, c_name AS name FROM customer WHERE c_custkey % 4 = 2 UNION ALL SELECT 'B' || c_custkey, lower(c_name) FROM customer WHERE c_custkey % 8 = 2),
    s AS (SELECT 'Q' || c_custkey AS item, replace(c_name, '#', '-') AS slug FROM customer WHERE c_custkey % 5 = 1),
    a AS (SELECT k || c_custkey AS item, CASE WHEN c_custkey % 7 <> 0 THEN CAST(1950 + c_custkey % 50 AS INTEGER) END AS birth_year, CAST(abs(floor(c_acctbal / 1000)) AS INTEGER) AS sitelinks, c_custkey % 2 = 0 AS focal, 4 * c_custkey + i AS num FROM customer, (VALUES ('Q', 0), ('P', 1), ('A', 2), ('B', 3)) t(k, i))"""


@query(names_sql(STAR_NAMES))
def name_tiers(spark, d):
    """Customers' names against items whose labels, aliases and slugs spell them in other ways."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k, name = F.col("c_custkey"), F.col("c_name")
    item = lambda letter: F.concat(F.lit(letter), "c_custkey").alias("item")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("records"), F.max(F.year("o_orderdate")).alias("last_year"))
    n = c.select("c_custkey", "c_name").join(n, "c_custkey", "left").select(k.alias("entity"), name.alias("name"), F.coalesce("records", F.lit(0)).alias("records"), "last_year")
    spaced = lambda to: F.replace(name, F.lit("#"), F.lit(to))
    labels = c.where((k % 4).isin(0, 3)).select(item("Q"), F.when(k % 4 == 0, F.upper(name)).otherwise(spaced(" No. ")).alias("name")).unionByName(c.where(k % 3 == 0).select(item("P"), spaced(" ").alias("name")))
    aliases = c.where(k % 4 == 2).select(item("A"), name.alias("name")).unionByName(c.where(k % 8 == 2).select(item("B"), F.lower(name).alias("name")))
    slugs = c.where(k % 5 == 1).select(item("Q"), spaced("-").alias("slug"))
    letters = F.posexplode(F.array(*map(F.lit, "QPAB"))).alias("i", "letter")
    attrs = c.select("*", letters).select(F.concat("letter", "c_custkey").alias("item"), F.when(k % 7 != 0, (F.lit(1950) + k % 50).cast("int")).alias("birth_year"), F.abs(F.floor(F.col("c_acctbal") / 1000)).cast("int").alias("sitelinks"), (k % 2 == 0).alias("focal"), (4 * k + F.col("i")).alias("num"))
    return M.match_names(n, labels, aliases, slugs, attrs)


# place, state, country, lat, is_country, region, scene
SITES = [("x1", "GA", "US", 33.7, False, "South", "Atl"), ("x2", "GA", "US", None, False, "South", None), ("x3", "NY", "US", 40.7, False, "East", "NYC"), ("x4", "CA", "US", 34.0, False, "West", "LA"), ("x5", None, "FR", 48.8, False, "Other", None), ("x6", None, "US", None, True, None, None), ("x7", None, "GB", 51.5, False, "UK", "Thames")]
PEOPLE = [("i1", 1980), ("i2", 1980), ("i3", 1980), ("i4", 1980), ("i5", None), ("i6", 1990), ("i7", 1970), ("i8", 1985), ("i9", 1975), ("i10", 1960)]
CLAIMS = [
    ("i1", "formed", 0, "x2", None), ("i1", "birth", 0, "x1", None), ("i2", "origin", 0, "x3", None), ("i2", "formed", 0, "x6", None), ("i3", "birth", 0, "x4", None), ("i3", "residence", 0, "x1", 2005), ("i4", "birth", 0, "x4", None), ("i4", "residence", 0, "x1", 1995),
    ("i5", "member", 0, "x3", None), ("i5", "member", 1, "x1", None), ("i5", "member", 2, "x1", None), ("i6", "country", 0, "x6", None), ("i6", "country", 1, "x5", None), ("i7", "birth", 0, "x5", None), ("i7", "residence", 0, "x7", None), ("i8", "birth", 0, "x3", None), ("i9", "birth", 0, "x4", None),
]
GENRES = [("i8", "East", "NYC"), ("i9", "South", None), ("i10", "West", "LA"), ("i10", "West", None), ("i3", "South", "Memphis"), ("i3", "East", None)]
MAPPED = ["West", "South", "East", "Midwest", "UK", "Canada"]


def made_origins(spark):
    f = spark.createDataFrame
    return M.assign_origin(f(PEOPLE, "item string, birth_year int"), f(CLAIMS, "item string, kind string, ord int, place string, start int"), f(SITES, "place string, state string, country string, lat double, is_country boolean, region string, scene string"), f(GENRES, "item string, region string, scene string"), MAPPED)


# Worked out by hand from the ladder's rules.
ORIGINS = [("i1", "x1", "South", "Atl", "formation+refined"), ("i2", "x3", "East", "NYC", "encyclopedia_origin"), ("i3", "x1", "South", "Memphis", "genre+place"), ("i4", "x1", "South", "Atl", "residence"), ("i5", "x1", "South", "Atl", "members_birthplace"), ("i6", "x5", "Other", None, "country_only"), ("i7", "x7", "UK", "Thames", "residence"), ("i8", "x3", "East", "NYC", "genre+place"), ("i9", "x4", "South", None, "genre"), ("i10", None, "West", "LA", "genre")]


@query()
def origin_priority(spark, d):
    """Where customers come from, by what their nations, their suppliers' nations and their segments claim."""
    c, n, r, o, li, su = (table(spark, d, t) for t in ("customer", "nation", "region", "orders", "lineitem", "supplier"))
    item, place, k = F.concat(F.lit("c"), "c_custkey").alias("item"), F.concat(F.lit("n"), "n_nationkey"), F.col("n_nationkey")
    items = c.select(item, F.when(F.col("c_custkey") % 7 != 0, (F.lit(1970) + F.col("c_custkey") % 20).cast("int")).alias("birth_year"))
    none = F.lit(None).cast("int").alias("start")
    claims = c.where("c_custkey % 3 > 0").select(item, F.lit("birth").alias("kind"), F.lit(0).alias("ord"), F.concat(F.lit("n"), "c_nationkey").alias("place"), none)
    claims = claims.unionByName(c.where("c_custkey % 10 = 0").select(item, F.lit("formed").alias("kind"), F.lit(0).alias("ord"), F.concat(F.lit("n"), (F.col("c_nationkey") + 1) % 25).alias("place"), none))
    lived = li.join(o, li.l_orderkey == o.o_orderkey).join(su, li.l_suppkey == su.s_suppkey).groupBy("o_custkey", "s_nationkey").agg(F.min(F.year("o_orderdate")).alias("start"))
    claims = claims.unionByName(lived.select(F.concat(F.lit("c"), "o_custkey").alias("item"), F.lit("residence").alias("kind"), F.col("s_nationkey").cast("int").alias("ord"), F.concat(F.lit("n"), "s_nationkey").alias("place"), "start"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(place.alias("place"), F.col("n_name").alias("state"), F.when(F.col("n_regionkey") == 1, "US").otherwise(F.col("r_name")).alias("country"), F.when(k % 4 != 0, k.cast("double")).alias("lat"), (k % 5 == 0).alias("is_country"), F.col("r_name").alias("region"), F.when(k % 3 == 0, F.col("n_name")).alias("scene"))
    one = r.agg(F.min("r_name").alias("region"))  # one row
    genres = c.where("c_mktsegment = 'BUILDING'").select(item).crossJoin(one).select("item", "region", F.lit(None).cast("string").alias("scene"))
    mapped = [x[0] for x in r.select("r_name").orderBy("r_name").limit(3).collect()]
    return M.assign_origin(items, claims, places, genres, mapped)


TRIPLES = [
    ("rapper", "sub", "musician"), ("mc", "sub", "rapper"), ("beatboxer", "sub", "mc"), ("trap", "sub", "rap"), ("drill", "sub", "trap"), ("duo", "sub", "group"), ("loop1", "sub", "loop2"), ("loop2", "sub", "loop1"),
    ("i1", "occ", "beatboxer"), ("i1", "is", "human"), ("i1", "sitelinks", "7"), ("i1", "sitelinks", "12"), ("i1", "born", "1987-00-00"), ("i1", "born", "1985-03-01"), ("i1", "genre", "drill"), ("i1", "genre", "drill"),
    ("i2", "occ", "musician"), ("i2", "is", "human"), ("i2", "genre", "rap"), ("i2", "sitelinks", "none"), ("i3", "genre", "trap"), ("i3", "is", "duo"), ("i3", "born", "soon"),
    ("i4", "occ", "mc"), ("i4", "is", "place"), ("i5", "occ", "dj"), ("i5", "is", "human"), ("i5", "sitelinks", "3"), ("i5", "genre", "loop1"),
]
TRIPLE_SQL = "tr(item, property, value) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TRIPLES) + ")"


def made_triples(spark):
    return spark.createDataFrame(TRIPLES, "item string, property string, value string")


def discover_sql(tr: str, roots: list[str], kinds: list[str], routes: str) -> str:
    """tr: SQL of tr(item, property, value); routes: a condition on a row of it, with below(root, class)."""
    every = ", ".join(f"('{x}', '{x}')" for x in dict.fromkeys([*roots, *kinds]))
    return f"""WITH RECURSIVE {tr}, below(root, class) AS (SELECT * FROM (VALUES {every}) UNION SELECT root, item FROM below JOIN tr ON value = class AND property = 'sub'),
    right_kind AS (SELECT DISTINCT item FROM tr WHERE property = 'is' AND value IN (SELECT class FROM below WHERE root IN ({", ".join(f"'{x}'" for x in kinds)})))
    SELECT DISTINCT item, property AS route FROM tr WHERE item IN (SELECT item FROM right_kind) AND ({routes})"""


def fold_sql(tr: str, items: str, genre: str, sitelinks: str, born: str) -> str:
    return f"""WITH {tr} SELECT item, coalesce(array_to_string(list_sort(list_distinct(list(value) FILTER (property = '{genre}'))), ';'), '') AS genres, coalesce(max(try_cast(value AS BIGINT)) FILTER (property = '{sitelinks}'), 0) AS sitelinks,
    min(CASE WHEN property = '{born}' AND regexp_matches(value, '^-?[0-9]{{1,4}}-') THEN CAST(regexp_extract(value, '^(-?[0-9]{{1,4}})-', 1) AS BIGINT) END) AS born FROM tr WHERE item LIKE '{items}%' GROUP BY item"""


def folded(triples, items, genre, sitelinks, born):
    from ..operators.items import fold

    out = fold(triples.where(F.col("item").startswith(items)), [genre], [], {sitelinks: "sitelinks"}, {born: "born"})
    return out.select("item", F.array_join(genre, ";").alias("genres"), "sitelinks", F.col("born").cast("long").alias("born"))


STAR_TRIPLES = """tr(item, property, value) AS (SELECT 'c' || c_custkey, 'lives', 'n' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'is', c_mktsegment FROM customer
    UNION ALL SELECT 'n' || n_nationkey, 'sub', 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || o_custkey, 'priority', o_orderpriority FROM orders
    UNION ALL SELECT 'c' || o_custkey, 'spent', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) FROM orders UNION ALL SELECT 'c' || o_custkey, 'ordered', strftime(o_orderdate, '%Y-%m-%d') FROM orders)"""


def star_triples(spark, d):
    """What the tables know of customers and nations, as triples."""
    c, n, o = (table(spark, d, t) for t in ("customer", "nation", "orders"))
    of = lambda df, letter, key, prop, value: df.select(F.concat(F.lit(letter), key).alias("item"), F.lit(prop).alias("property"), value.alias("value"))
    parts = [
        of(c, "c", "c_custkey", "lives", F.concat(F.lit("n"), "c_nationkey")), of(c, "c", "c_custkey", "is", F.col("c_mktsegment")),
        of(n, "n", "n_nationkey", "sub", F.concat(F.lit("r"), "n_regionkey")), of(o, "c", "o_custkey", "priority", F.col("o_orderpriority")),
        of(o, "c", "o_custkey", "spent", F.floor("o_totalprice").cast("string")), of(o, "c", "o_custkey", "ordered", F.date_format("o_orderdate", "yyyy-MM-dd")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query(discover_sql(STAR_TRIPLES, ["r1"], ["BUILDING", "MACHINERY"], "(property = 'lives' AND (value = 'n2' OR value IN (SELECT class FROM below WHERE root = 'r1'))) OR (property = 'is' AND value = 'BUILDING')"))
def discover_items(spark, d):
    """Customers of two segments, found by living in a region's nations or by one segment."""
    from ..operators.items import discover

    return discover(star_triples(spark, d), [("lives", ["r1"], ["n2"]), ("is", ["BUILDING"], [])], "sub", "is", ["BUILDING", "MACHINERY"])


@query(fold_sql(STAR_TRIPLES, "c", "priority", "spent", "ordered"))
def item_attributes(spark, d):
    return folded(star_triples(spark, d), "c", "priority", "spent", "ordered")


@query(
    """SELECT c_name AS name, CASE WHEN c_custkey % 9 <> 0 THEN r_name END AS region, CASE WHEN c_custkey % 9 <> 0 AND c_acctbal >= 0 THEN c_mktsegment END AS scene,
    c_custkey % 9 <> 0 AND (CASE WHEN c_custkey % 10 = 0 THEN 'ASIA' ELSE r_name END) = r_name AND (CASE WHEN c_acctbal >= 0 THEN c_mktsegment IN ('BUILDING', CASE WHEN c_custkey % 2 = 1 THEN 'MACHINERY' ELSE 'BUILDING' END) ELSE c_custkey % 2 = 0 END) AS ok
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def spot_check(spark, d):
    """Regions and segments of customers, a ninth of them unassigned, against what is expected of them."""
    from ..operators.items import spot_check

    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    got = rows.where(k % 9 != 0).select(F.col("c_name").alias("name"), F.col("r_name").alias("region"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("scene"))
    want = rows.select(F.col("c_name").alias("name"), F.when(k % 10 == 0, "ASIA").otherwise(F.col("r_name")).alias("region"), F.when(k % 2 == 1, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(F.array(F.lit("BUILDING"), F.lit(None))).alias("scenes"))
    return spot_check(got, want)
