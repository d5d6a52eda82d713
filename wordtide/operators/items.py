"""Items of a knowledge base as tables: discovery over a closure of classes, attributes folded from triples, spot checks.

triples(item, property, value): what a fetcher leaves, strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import year_of
from .geo import closure


def classes_below(triples: DataFrame, roots: list[str], subclass: str) -> DataFrame:
    """class: the roots and everything that is a subclass of one, over any number of steps."""
    edges = triples.where(F.col("property") == subclass).select(F.col("value").alias("class"), F.col("item").alias("below"))
    seeds = triples.sparkSession.createDataFrame([(r, r) for r in roots], "class string, below string")
    reached = closure(edges.unionByName(seeds), "class", "below")
    return reached.where(F.col("class").isin(roots)).select(F.col("below").alias("class")).distinct()


def discover(triples: DataFrame, routes: list[tuple[str, list[str], list[str]]], subclass: str, kind: str, kinds: list[str]) -> DataFrame:
    """item, route: items that a route finds: (property, its roots, further values as they are). The item's `kind` has to be in the
    closure of kinds."""
    right = triples.where(F.col("property") == kind).join(classes_below(triples, kinds, subclass).withColumnRenamed("class", "value"), "value", "left_semi").select("item").distinct()
    found = None
    for prop, roots, more in routes:
        classes = classes_below(triples, roots, subclass)
        if more:
            classes = classes.union(triples.sparkSession.createDataFrame([(x,) for x in more], "class string")).distinct()
        part = triples.where(F.col("property") == prop).join(classes.withColumnRenamed("class", "value"), "value", "left_semi").select("item", F.lit(prop).alias("route")).distinct()
        found = part if found is None else found.unionByName(part)
    return found.join(right, "item", "left_semi")


def fold(triples: DataFrame, lists: list[str], sets: list[str], most: dict[str, str], earliest: dict[str, str]) -> DataFrame:
    """item and a column for each attribute, in one aggregation: lists (distinct values in order), sets (as lists), most (property ->
    column: the largest whole number, 0 without any), earliest (property -> column: the first year of partial dates)."""
    of = lambda p: F.when(F.col("property") == p, F.col("value"))
    values: list[Column] = [F.array_sort(F.collect_set(of(p))).alias(p) for p in [*lists, *sets]]
    values += [F.coalesce(F.max(F.expr(f"try_cast(CASE WHEN property = '{p}' THEN value END AS BIGINT)")), F.lit(0)).alias(c) for p, c in most.items()]
    values += [F.min(year_of(of(p))).alias(c) for p, c in earliest.items()]
    return triples.groupBy("item").agg(*values)


def residence_starts(statements: DataFrame) -> DataFrame:
    """item, place, year: when an item came to a place, the first year of statements(item, place, start) that give one."""
    return statements.select("item", "place", year_of(F.col("start")).alias("year")).where("year is not null").groupBy("item", "place").agg(F.min("year").alias("year"))


def spot_check(assigned: DataFrame, expected: DataFrame) -> DataFrame:
    """name, region, scene, ok for every row of expected(name, region, scenes): the name's region is the expected one and its scene is
    among scenes (a null there allows none). assigned: name, region, scene."""
    both = expected.select("name", F.col("region").alias("_region"), "scenes").join(assigned.select("name", "region", "scene"), "name", "left")
    held = F.when(F.col("scene").isNull(), F.exists("scenes", lambda x: x.isNull())).otherwise(F.coalesce(F.array_contains(F.array_compact("scenes"), F.col("scene")), F.lit(False)))
    return both.select("name", "region", "scene", (F.coalesce(F.col("region") == F.col("_region"), F.lit(False)) & held).alias("ok"))
