"""Life-cycle operators over curves (genre, item, year, r, s, n).

A curve is gathered into one sorted array an item and genre (a few dozen years), so that peaks, walk-backs and offsets are expressions
over the array: one shuffle for all of them, and no loop over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import half_even, once, quantiles, ratio


def series(curve: DataFrame, keys: tuple[str, ...] = ("genre", "item")) -> DataFrame:
    """keys, c (array of year, r, s, n in order), y0, P (highest s), py (its first year), n_py (users then). A curve that has c already,
    from curve_arrays(), isn't shuffled."""
    if "c" in curve.columns:
        top = F.array_max(F.transform("c", lambda x: F.struct(x.s.alias("s"), (-x.year).alias("ny"), x.n.alias("n"))))
        out = once(curve.select(*keys, "c", F.get("c", F.lit(0)).year.alias("y0")), "m", top)
        return out.select(*keys, "c", "y0", F.col("m.s").alias("P"), (-F.col("m.ny")).alias("py"), F.col("m.n").alias("n_py"))
    cols = [c for c in ("year", "r", "s", "n", "valid") if c in curve.columns]
    out = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("c"), F.max(F.struct("s", (-F.col("year")).alias("ny"), "n")).alias("m"), F.min("year").alias("y0"))
    return out.select(*keys, "c", "y0", F.col("m.s").alias("P"), (-F.col("m.ny")).alias("py"), F.col("m.n").alias("n_py"))


def value_at(c: Column, year: Column, field: str) -> Column:
    """The field in that year; null outside the curve."""
    return F.get(F.filter(c, lambda x: x.year == year), F.lit(0))[field]


def years_where(c: Column, test) -> Column:
    return F.transform(F.filter(c, test), lambda x: x.year)


def rise_start(c: Column, py: Column, level: Column, y0: Column) -> Column:
    """Start of the unbroken run up to the peak with s >= level: the year after the last one below it."""
    return F.coalesce(F.array_max(years_where(c, lambda x: (x.year < py) & (x.s < level))) + 1, y0)


def baseline(c: Column, py: Column, mode: str) -> Column:
    """The low that a rise is measured from: before the peak (0 if there is no year), or of the whole curve."""
    if mode == "global":
        return F.array_min(F.transform(c, lambda x: x.s))
    return F.coalesce(F.array_min(F.transform(F.filter(c, lambda x: x.year < py), lambda x: x.s)), F.lit(0.0))


def with_rise(ser: DataFrame, name: str, frac: float, min_users: int = 5, mode: str = "pre_peak") -> DataFrame:
    """Adds the year in which the run up to the peak begins; null where nothing was used, or by too few at the peak."""
    df = ser.withColumn("_base", baseline(F.col("c"), F.col("py"), mode))
    df = df.withColumn("_level", F.col("_base") + F.lit(frac) * (F.col("P") - F.col("_base")))
    year = rise_start(F.col("c"), F.col("py"), F.col("_level"), F.col("y0"))
    return df.withColumn(name, F.when((F.col("P") > 0) & (F.col("n_py") >= min_users), year)).drop("_base", "_level")


def rise_year(curve: DataFrame, frac: float, min_users: int = 5, mode: str = "pre_peak") -> DataFrame:
    """genre, item, py, P, year."""
    return with_rise(series(curve), "year", frac, min_users, mode).select("genre", "item", "py", "P", "year")


def emergence(curve: DataFrame, frac: float = 0.10, min_users: int = 5) -> DataFrame:
    """genre, item, emerged: the first year with s >= frac x peak and enough users."""
    ser = series(curve)
    found = F.array_min(years_where(F.col("c"), lambda x: (x.s >= F.lit(frac) * F.col("P")) & (x.n >= min_users)))
    return ser.select("genre", "item", found.alias("emerged"))


def now_level(c: Column, last: int = 2) -> Column:
    """Mean raw rate of the last years."""
    tail = F.slice(c, -last, last)
    return F.aggregate(tail, F.lit(0.0), lambda a, x: a + x.r, lambda a: a / F.size(tail))


def growth(curve: DataFrame, back: int = 8) -> DataFrame:
    """genre, item, py, P, now, now_vs_peak, rise_x: the peak over the level some years before."""
    ser = series(curve)
    before = value_at(F.col("c"), F.greatest(F.col("y0"), F.col("py") - back), "s")
    out = ser.withColumn("now", now_level(F.col("c"))).withColumn("before", before)
    return out.select("genre", "item", "py", "P", "now", ratio(F.col("now"), F.col("P")).alias("now_vs_peak"), (F.col("P") / (F.col("before") + F.lit(0.02))).alias("rise_x"))


def log_ratio(counts: DataFrame, totals: DataFrame, focal: str, others: list[str], from_year: int, add: float = 5.0) -> DataFrame:
    """item, ratio: ln((focal + add) / focal total) - ln((other + add) / other total) of records from a year on."""
    side = lambda col, genres: F.coalesce(F.sum(F.when(F.col("genre").isin(genres), F.col(col))), F.lit(0)).cast("double")
    g = counts.where(F.col("year") >= from_year).groupBy("item").agg(side("records", [focal]).alias("a"), side("records", others).alias("b"))
    t = totals.where(F.col("year") >= from_year).agg(side("records", [focal]).alias("at"), side("records", others).alias("bt"))
    g = g.crossJoin(F.broadcast(t))  # one row
    return g.select("item", (F.ln((F.col("a") + add) / F.col("at")) - F.ln((F.col("b") + add) / F.col("bt"))).alias("ratio"))


#: Thresholds of category(): lowest ratio, lowest peak; faded: last peak year, highest now/peak, least rise; rising: first emergence,
#: lowest now/peak, least rise; staple: last emergence, lowest now/peak.
CATEGORY = {"ratio": 0.7, "peak": 0.25, "faded": (2016, 0.35, 3.0), "rising": (2008, 0.75, 3.0), "staple": (1998, 0.6)}


def category(grown: DataFrame, emerged: DataFrame, ratios: DataFrame, t: dict = CATEGORY) -> DataFrame:
    """item, category by the first rule that fits, on rounded values as they are exported; null for what isn't specific to the genre, too
    rare, all digits or without a ratio."""
    df = grown.join(emerged.select("item", "emerged"), "item", "left").join(ratios, "item", "left")
    p, now, rise = half_even(F.col("P"), 3), half_even(F.col("now_vs_peak"), 3), half_even(F.col("rise_x"), 1)
    none = F.col("ratio").isNull() | (F.col("ratio") < t["ratio"]) | (p < t["peak"]) | F.col("item").rlike(r"^[0-9]+\z")
    label = (
        F.when(none, F.lit(None).cast("string"))
        .when((F.col("py") <= t["faded"][0]) & (now <= t["faded"][1]) & (rise >= t["faded"][2]), "faded")
        .when((F.col("emerged") >= t["rising"][0]) & (now >= t["rising"][1]) & (rise >= t["rising"][2]), "rising")
        .when((F.col("emerged") <= t["staple"][0]) & (now >= t["staple"][1]), "staple")
        .otherwise("other")
    )
    return df.select("item", label.alias("category"))


def stage(curve: DataFrame, rising_from: int = 2018, early: float = 0.4, staple: float = 0.5, rising: float = 0.85, faded: float = 0.35, literal: bool = False) -> DataFrame:
    """genre, item, stage. The early level is the mean of the first four smoothed years; literal: as if it were never known, so that
    nothing is a staple. Items that were never used have no row."""
    ser = series(curve).where("P > 0").withColumn("now", now_level(F.col("c")))
    first = F.slice("c", 1, 4)
    level = F.lit(None).cast("double") if literal else F.aggregate(first, F.lit(0.0), lambda a, x: a + x.s, lambda a: a / F.size(first))
    ser = ser.withColumn("early", level)
    at_first = F.coalesce(F.col("early") >= early * F.col("P"), F.lit(False))
    label = (
        F.when(at_first, F.when(F.col("now") >= staple * F.col("P"), "staple").otherwise("faded"))
        .when((F.col("now") >= rising * F.col("P")) & (F.col("py") >= rising_from), "rising")
        .when(F.col("now") <= faded * F.col("P"), "faded")
        .otherwise("cooling")
    )
    return ser.select("genre", "item", label.alias("stage"))


def crossover(curve: DataFrame, focal: str, frac: float = 0.25, min_users: int = 5, least_peak: float = 0.1, mode: str = "pre_peak") -> DataFrame:
    """item, genre, peak, peak_year, takeoff, focal_takeoff, focal_peak, lag, reach for every other genre; items unused in the focal
    genre have no row."""
    ser = with_rise(series(curve), "takeoff", frac, min_users, mode)
    item, used = W.partitionBy("item"), (F.col("genre") == focal) & (F.col("P") > 0)
    own = lambda c: F.max(F.when(used, F.col(c))).over(item)
    df = ser.select("item", "genre", "P", "py", "takeoff", own("takeoff").alias("focal_takeoff"), own("P").alias("focal_peak"))
    df = df.where((F.col("genre") != focal) & F.col("focal_peak").isNotNull()).withColumn("takeoff", F.when(F.col("P") >= least_peak, F.col("takeoff")))
    return df.select("item", "genre", F.col("P").alias("peak"), F.when(F.col("P") > 0, F.col("py")).alias("peak_year"), "takeoff", "focal_takeoff", "focal_peak", (F.col("takeoff") - F.col("focal_takeoff")).alias("lag"), ratio(F.col("P"), F.col("focal_peak")).alias("reach"))


def bursts(curve: DataFrame, least_peak: float = 0.5, min_users: int = 10, back: int = 8, prior: float = 1 / 3, frac: float = 0.25, keep_after: int = 3) -> DataFrame:
    """genre, item, py, P, rise, keep: items that rose from little to their peak. The run starts at frac x peak, without a baseline, and
    must not reach the first year. rise: years of the run; keep: share of the peak left keep_after years on."""
    ser = series(curve).where((F.col("P") >= least_peak) & (F.col("n_py") >= min_users))
    ser = ser.withColumn("before", value_at(F.col("c"), F.greatest(F.col("y0"), F.col("py") - back), "s")).where(F.col("before") <= F.col("P") * F.lit(prior))
    ser = ser.withColumn("start", rise_start(F.col("c"), F.col("py"), F.lit(frac) * F.col("P"), F.col("y0"))).where(F.col("start") > F.col("y0"))
    keep = value_at(F.col("c"), F.col("py") + keep_after, "s") / F.col("P")
    return ser.select("genre", "item", "py", "P", (F.col("py") - F.col("start") + 1).alias("rise"), keep.alias("keep"), "c")


def cohorts(burst: DataFrame, ranges: list[tuple[int, int]], offsets: tuple[int, int] = (-8, 8), min_support: int = 15) -> DataFrame:
    """cohort_from, cohort_to, offset, n, median: usage over the (rounded) peak, at most 1, with every item aligned on its peak year; the
    median needs min_support items that have that year."""
    era = F.coalesce(*[F.when(F.col("py").between(a, b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in ranges])
    rows = burst.withColumn("era", era).where("era is not null").withColumn("offset", F.explode(F.sequence(F.lit(offsets[0]), F.lit(offsets[1]))))
    rows = rows.withColumn("u", value_at(F.col("c"), F.col("py") + F.col("offset"), "s") / half_even(F.col("P"), 2))
    rows = rows.withColumn("u", F.when(F.col("u") > 1, 1.0).otherwise(F.col("u")))  # null outside the curve stays null
    rows = rows.select(F.col("era.a").alias("cohort_from"), F.col("era.b").alias("cohort_to"), "offset", "u")
    keys = ["cohort_from", "cohort_to", "offset"]
    n = rows.groupBy(*keys).agg(F.count("u").alias("n"))
    out = n.join(quantiles(rows, keys, "u", {"median": 0.5}), keys, "left")
    return out.select(*keys, "n", F.when(F.col("n") >= min_support, F.col("median")).alias("median"))


def cohort_facts(burst: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """cohort_from, cohort_to, items and quartiles of rise and keep."""
    era = F.coalesce(*[F.when(F.col("py").between(a, b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in ranges])
    keys, quarters = ["cohort_from", "cohort_to"], {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rows = burst.withColumn("era", era).where("era is not null").select(F.col("era.a").alias("cohort_from"), F.col("era.b").alias("cohort_to"), "rise", "keep")
    out = rows.groupBy(*keys).agg(F.count("*").alias("items"))
    for c in ("rise", "keep"):
        out = out.join(quantiles(rows, keys, c, {f"{c}_{name}": p for name, p in quarters.items()}), keys, "left")
    return out


def churn(curve: DataFrame, k: int, gap: int) -> DataFrame:
    """genre, year, kept: share of a year's top k by raw rate that is in the top k some years on; ties go to the smaller item."""
    order = W.partitionBy("genre", "year").orderBy(F.desc("r"), "item")
    top = curve.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("genre", "year", "item")
    # the top has every year of the curve, and k rows of each: from here on tables are small
    years, until = F.collect_set("year").over(W.partitionBy("genre", "item")), F.max("year").over(W.partitionBy("genre")) - gap
    top = top.select("genre", "year", until.alias("until"), F.array_contains(years, F.col("year") + gap).alias("hit")).where("year <= until")
    return top.groupBy("genre", "year").agg((F.count(F.when(F.col("hit"), 1)) / F.lit(float(k))).alias("kept"))


def pool(active: DataFrame, focal: str, min_records: int = 20, fame: DataFrame | None = None) -> DataFrame:
    """entity: those with enough records of the focal genre, or a positive sitelinks in fame(entity, sitelinks) if it is given."""
    n = active.where(F.col("genre") == focal).groupBy("entity").agg(F.count("*").alias("n"))
    if fame is None:
        return n.where(F.col("n") >= min_records).select("entity")
    return n.join(fame, "entity", "left").where((F.col("n") >= min_records) | (F.coalesce("sitelinks", F.lit(0)) > 0)).select("entity")


def candidates(ratios: DataFrame, names: DataFrame, dictionary: DataFrame | None, least_ratio: float = 1.0, blocked: str | None = None) -> DataFrame:
    """item: specific enough, not digits, not blocked (a pattern for whole words), and no known name unless it is a dictionary word."""
    df = ratios.where((F.col("ratio") >= least_ratio) & ~F.col("item").rlike(r"^[0-9]+\z"))
    if blocked:
        df = df.where(~F.col("item").rlike(rf"^(?:{blocked})\z"))
    bad = names.select(F.lower("name").alias("item")).distinct()
    if dictionary is not None:
        bad = bad.join(dictionary.select(F.col("word").alias("item")), "item", "left_anti")
    return df.join(bad, "item", "left_anti").select("item")
