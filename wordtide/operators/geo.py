"""Places: climbing to the first-level unit, regions, scenes.

places(place, label, lat, lon, codes array<string>); parents(place, ord, parent); countries(place, ord, country)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import haversine, subdivision
from ..sources.tables import shared_folder


def _kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: plans of later rounds start from it."""
    path = f"{shared_folder(df.sparkSession)}/wordtide-places/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, src: str, dst: str, depth: int = 14) -> DataFrame:
    """src, dst, steps: everything that is reached over edges, itself included, and the fewest steps; cycles end where a node would be met
    again. Breadth first, a round a step: any number of rows, and a round holds what it reached first only. Edges whose source no other
    edge leads to are followed once, so that many leaves below few nodes join the few edges above."""
    pairs = _kept(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    out = pairs.where("a <> b")
    above = _kept(out.join(out.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("at"), F.col("b").alias("to")))
    reached = pairs.select(F.col("a").alias("src"), F.col("a").alias("dst")).distinct().withColumn("steps", F.lit(0))
    new = out.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    for step in range(1, depth + 1):
        reached = reached.unionByName(new.withColumn("steps", F.lit(step)))
        further = new.join(above, F.col("dst") == F.col("at")).select("src", F.col("to").alias("dst")).distinct()
        new = _kept(further.join(reached.select("src", "dst"), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
    return reached.select(F.col("src").alias(src), F.col("dst").alias(dst), "steps")


def resolve(places: DataFrame, parents: DataFrame, countries: DataFrame, home: str = "US", depth: int = 14) -> DataFrame:
    """place, label, state, country, lat, lon, is_country of every place.

    A place takes its state from the first parent that has one (one of the home country before others), else from its own code; it never
    climbs into its own country, or into a country without a row, nor twice into a place on its way. Coordinates of countries and
    first-level units are centroids and are left out; a place without one takes its parent's. Way after way upwards is laid out as rows,
    one step a round, and folded from the top, one step a round."""
    own = countries.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "country"))), lambda x: x.country).alias("own"))
    known = countries.select(F.col("country").alias("place")).distinct().withColumn("named", F.lit(True))
    base = places.join(own, "place", "left").join(known, "place", "left")
    base = base.withColumn("own", F.coalesce("own", F.array().cast("array<string>"))).withColumn("code", subdivision(F.col("codes")))
    base = base.withColumn("is_country", F.coalesce("named", F.lit(False)) & ((F.size("own") == 0) | F.array_contains("own", F.col("place"))))
    base = _kept(base.select("place", "label", "lat", "lon", "own", "code", "is_country"))
    # Many places have few parents: what lies above is told apart, so that no parent's children meet in one task.
    tops = _kept(base.join(parents.select(F.col("parent").alias("place")).distinct(), "place", "left_semi"))
    ups = parents.join(base.select("place", "own").distinct(), "place").join(tops.select(F.col("place").alias("parent")).distinct(), "parent")
    ups = ups.where(~F.array_contains("own", F.col("parent")) & (F.col("place") != F.col("parent")))
    ups = _kept(ups.select("place", F.col("ord").cast("int").alias("ord"), "parent").distinct())
    above = _kept(ups.join(tops.select("place").distinct(), "place", "left_semi").select(F.col("place").alias("at"), F.col("ord").alias("nth"), "parent"))
    ways = [None]  # of each number of steps: path, ords, place
    new = ups.select(F.array("place", "parent").alias("path"), F.array("ord").alias("ords"), F.col("parent").alias("place"))
    while len(ways) <= depth and not new.isEmpty():
        ways.append(new)
        further = new.join(above, (F.col("place") == F.col("at")) & ~F.array_contains("path", F.col("parent")))
        new = _kept(further.select(F.array_append("path", F.col("parent")).alias("path"), F.array_append("ords", F.col("nth")).alias("ords"), F.col("parent").alias("place")))
    kind = "struct<state: string, country: string, lat: double, lon: double, usable: boolean>"
    above = None
    for step in range(len(ways) - 1, -1, -1):
        rows = ways[step].join(tops, "place") if step else base.withColumn("path", F.array("place")).withColumn("ords", F.array().cast("array<int>"))
        if above is not None:
            rows = rows.join(above, "path", "left")
        else:
            rows = rows.withColumn("up", F.lit(None).cast(kind))
        rows = rows.withColumn("r", _fold(home)).select("path", "ords", "place", "label", "is_country", "r")
        if step:
            has = F.col("r.state").isNotNull()
            order = F.struct(F.when(has & (F.col("r.country") == home), 0).when(has, 1).otherwise(2).alias("rank"), F.get(F.col("ords"), F.lit(step - 1)).alias("ord"), F.get(F.col("path"), F.lit(step)).alias("at"))
            above = rows.groupBy(F.slice("path", 1, step).alias("path")).agg(F.min_by("r", order).alias("up"))
        else:
            return rows.select("place", "label", "r.state", "r.country", "r.lat", "r.lon", "is_country")


def _fold(home: str) -> Column:
    """A place's resolution from its own row and the best parent's, up."""
    up = F.col("up")
    own_state = F.when(F.col("code").isNotNull() & ~F.col("is_country"), F.when(F.col("code").startswith(f"{home}-"), F.substring("code", len(home) + 2, 9)).otherwise(F.col("label")))
    state = F.coalesce(up.state, own_state)
    country = F.when(F.col("is_country"), F.col("place")).when(F.array_contains("own", home), F.lit(home)).otherwise(F.coalesce(F.get("own", F.lit(0)), up.country))
    first_level = F.col("code").isNotNull() & up.state.isNull() & (F.col("code") != f"{home}-DC")
    hidden = F.col("is_country") | F.coalesce(first_level, F.lit(False))
    take = lambda c: F.when(hidden, None).otherwise(F.coalesce(F.col(c), F.when(up.usable, up[c])))
    state = F.when((country == home) & (F.length(state) != 2), None).otherwise(state)
    usable = F.col("code").isNull() & ~F.col("is_country") & take("lat").isNotNull()
    return F.struct(state.cast("string").alias("state"), country.cast("string").alias("country"), take("lat").alias("lat"), take("lon").alias("lon"), F.coalesce(usable, F.lit(False)).alias("usable"))


def region(resolved: DataFrame, states: DataFrame, named: dict[str, str], home: str = "US") -> DataFrame:
    """Adds region: by state at home (null if it is unknown), by country where it is named, else Other; null without a country.
    states: state, region."""
    df = resolved.join(F.broadcast(states.select("state", F.col("region").alias("_r"))), "state", "left")
    out = F.when(F.col("country") == home, F.col("_r"))
    for c, r in named.items():
        out = out.when(F.col("country") == c, F.lit(r))
    return df.withColumn("region", out.when(F.col("country").isNotNull(), F.lit("Other"))).drop("_r")


def scene(resolved: DataFrame, centres: DataFrame, statewide: dict[str, str], guards: dict[str, list[str]], own: tuple[str, str, str, float] | None = None, home: str = "US") -> DataFrame:
    """place, scene of every resolved place. centres: scene, lat, lon, radius, country; a few dozen rows that are broadcast.

    Statewide scenes first; then the nearest centre whose radius holds the place, of its country (or of home, if it has none), and of
    an allowed state where guards(scene -> states) has some. own (state, its scene, exception, km): a state that is a scene of its own
    but for places that the exception's centre holds within km."""
    c = F.broadcast(centres.select(F.col("scene").alias("_scene"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("radius").alias("_radius"), F.col("country").alias("_country")))
    same = (F.col("_country") == F.col("country")) | (F.col("country").isNull() & (F.col("_country") == home))
    allowed = F.lit(True)
    for name, states in guards.items():
        allowed = allowed & ((F.col("_scene") != name) | F.col("state").isNull() | F.col("state").isin(states))
    near = resolved.where("lat is not null and lon is not null").join(c, same & allowed, "inner")
    near = near.withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).where("km <= _radius")
    near = near.withColumn("k", F.row_number().over(W.partitionBy("place").orderBy("km", "_scene"))).where("k = 1").select("place", "_scene", "km")
    df = resolved.join(near, "place", "left")
    out = F.col("_scene")
    if own:
        mine = (F.col("country") == home) & (F.col("state") == own[0]) & F.col("lat").isNotNull()
        out = F.when(mine, F.when((F.col("_scene") == own[2]) & (F.col("km") < own[3]), own[2]).otherwise(own[1])).otherwise(out)
    for s, name in statewide.items():
        out = F.when((F.col("country") == home) & (F.col("state") == s), F.lit(name)).otherwise(out)
    return df.select("place", out.alias("scene"))


def kept_scenes(assigned: DataFrame, optional: list[str], least: int = 20) -> DataFrame:
    """scene: the optional scenes that enough entities were assigned to; the assignment is then made again with those only."""
    return assigned.where(F.col("scene").isin(optional)).groupBy("scene").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("scene")
