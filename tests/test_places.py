"""Names, scenes, origins and items on small tables of hand-made cases, against the same SQL as the queries, or worked out by hand."""

import random

import duckdb
import pytest

from wordtide.operators import geo as G
from wordtide.operators.items import discover, residence_starts, spot_check
from wordtide.operators.matching import search_fallback
from wordtide.operators.views import distinctive_top, lookup
from wordtide.plans import places as P


def same(df, sql):
    cur = duckdb.sql(sql)
    cols = sorted(df.columns)
    assert sorted(cur.columns) == cols
    want = sorted(str(tuple(r[cur.columns.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want and want


def test_names_are_matched_by_tiers(spark):
    same(P.made_names(spark), P.names_sql(P.MADE))


def test_scenes_are_the_nearest(spark):
    spots = spark.createDataFrame(P.SPOTS, "place string, state string, country string, lat double, lon double")
    same(P.scenes(spark, spots), P.scene_sql(P._sql_rows(P.SPOTS)))


def test_closures_end_in_cycles(spark):
    pairs = [(p, x) for p, *_, up in P.PLACES for x in up]
    same(G.closure(P.tables(spark)[1], "place", "parent").withColumn("steps", P.F.col("steps").cast("long")), P.closure_sql(P._sql_rows(pairs)))


def test_climbs_have_no_bound_on_rows(spark):
    """Spark ends a recursive query with an error beyond so many rows; the fixture's ways are 50."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        places, parents, countries = P.tables(spark)
        got = G.resolve(places.unionByName(places.where("place = 't1'")), parents, countries)  # a row more of a place is a row more, no more
        assert sorted(r["place"] for r in got.collect()) == sorted([*(p for p, *_ in P.PLACES), "t1"])
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_closures_have_no_bound_on_rows(spark):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] + [("n1", None), (None, "n2"), ("n3", "n3")]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        df = spark.createDataFrame(pairs, "place string, parent string")
        same(G.closure(df, "place", "parent").withColumn("steps", P.F.col("steps").cast("long")), P.closure_sql(P._sql_rows(pairs)))
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_origins_follow_the_ladder(spark):
    assert sorted(map(str, map(tuple, P.made_origins(spark).collect()))) == sorted(map(str, P.ORIGINS))


def test_items_are_discovered_and_folded(spark):
    t = P.made_triples(spark)
    routes = "(property = 'occ' AND (value = 'dj' OR value IN (SELECT class FROM below WHERE root = 'rapper'))) OR (property = 'genre' AND value IN (SELECT class FROM below WHERE root = 'rap'))"
    same(discover(t, [("occ", ["rapper"], ["dj"]), ("genre", ["rap"], [])], "sub", "is", ["human", "group"]), P.discover_sql(P.TRIPLE_SQL, ["rapper", "rap"], ["human", "group"], routes))
    same(P.folded(t, "i", "genre", "sitelinks", "born"), P.fold_sql(P.TRIPLE_SQL, "i", "genre", "sitelinks", "born"))


def test_spot_check(spark):
    got = spark.createDataFrame([("A", "West", "Bay"), ("B", "West", None), ("C", "South", None), ("E", "East", "Metro"), ("Z", "East", None)], "name string, region string, scene string")
    want = spark.createDataFrame([("A", "West", ["Bay"]), ("B", "West", ["Bay", None]), ("C", "South", ["Delta"]), ("D", "East", [None]), ("E", "East", ["Thames"])], "name string, region string, scenes array<string>")
    assert {r["name"]: r["ok"] for r in spot_check(got, want).collect()} == {"A": True, "B": True, "C": False, "D": False, "E": False}


def test_first_years_of_residence(spark):
    df = spark.createDataFrame([("i", "p", "1990-00-00"), ("i", "p", "1985-01-02"), ("i", "q", "soon"), ("j", "p", None)], "item string, place string, start string")
    assert [tuple(r) for r in residence_starts(df).collect()] == [("i", "p", 1985)]


def test_search_finds_the_same_name_only(spark):
    names = spark.createDataFrame([(1, "Björk S.", 50), (2, "Rex", 40), (3, "Few", 5), (4, "Known", 90), (5, "Weak", 60)], "entity long, name string, records long")
    hits = spark.createDataFrame([(1, "m1", 1, 100, ["Bjork S"]), (2, "m2", 1, 99, ["Max"]), (3, "m3", 1, 99, ["Few"]), (4, "m4", 1, 99, ["Known"]), (5, "m5", 1, 90, ["Weak"]), (2, "m6", 2, 99, ["Rex"])], "entity long, base_id string, rank int, score int, names array<string>")
    out = search_fallback(names, hits, spark.createDataFrame([(4,)], "entity long"), 20, 10)
    assert [tuple(r) for r in out.collect()] == [(1, "m1")]
    assert search_fallback(names, hits, spark.createDataFrame([(4,)], "entity long"), 20, 1).count() == 0  # the most used name only


def test_distinctive_top_and_lookup(spark):
    df = spark.createDataFrame([("r", "a", 4.0, 2.0, 5.0), ("r", "b", 4.0, 0.0, 9.0), ("r", "c", 1.0, 1.0, 1.0)], "region string, item string, share double, rest double, z double")
    got = [(r["item"], r["rank"], r["times"]) for r in distinctive_top(df, 2).orderBy("rank").collect()]
    assert got == [("b", 1, pytest.approx(400)), ("a", 2, 2.0)]
    lex = spark.createDataFrame([("x", "Art"), ("art", "Y")], "id string, label string")
    assert sorted(r["id"] for r in lookup(lex, "art").collect()) == ["art", "x"] and lookup(lex, "ART").count() == 1
