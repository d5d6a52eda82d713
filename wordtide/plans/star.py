"""Adoption over the star schema: an order is a record, a customer an entity, a market segment a genre, parts' names, brands or types the
items, the customer's region a region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adoption as A
from ..operators import intervals as I
from ..operators import lifecycle as L
from ..operators import people as P
from ..operators import presence as B
from ..operators import regional as R
from ..operators import views as V
from .registry import longs, query, rounded, table

Y0, Y1, FOCAL = 1995, 2001, "BUILDING"
OTHERS = ["AUTOMOBILE", "MACHINERY", "FURNITURE"]


def active(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("entity"), F.col("c_mktsegment").alias("genre"), "year")


def uses(spark: SparkSession, d: str, item: str = "p_type") -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, d, "part").select("p_partkey", F.expr(item).alias("item"))
    had = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("record"), "item").distinct()
    return had.join(active(spark, d), "record").select("record", "entity", "genre", "year", "item")


def arrays(spark: SparkSession, d: str, item: str = "p_type") -> DataFrame:
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("genre")).where("genre is not null").distinct()
    return A.curve_arrays(A.adoption(uses(spark, d, item), active(spark, d)), Y0, Y1, segments)


def curves(spark: SparkSession, d: str, item: str = "p_type") -> DataFrame:
    return arrays(spark, d, item).select("genre", "item", F.inline("c"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("entity"), F.col("r_name").alias("region"))


REC = "rec AS (SELECT o_orderkey AS record, o_custkey AS entity, c_mktsegment AS genre, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON o_custkey = c_custkey)"


def sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def uses_sql(item: str = "p_type") -> str:
    return f"uses AS (SELECT DISTINCT r.record, r.entity, r.genre, r.year, {item} AS item FROM rec r JOIN lineitem ON l_orderkey = r.record JOIN part ON l_partkey = p_partkey)"


TOT = "tot AS (SELECT genre, year, count(*) AS records, count(DISTINCT entity) AS entities FROM rec GROUP BY ALL)"
ADO = "ado AS (SELECT u.genre, u.year, u.item, count(*) AS records, count(DISTINCT u.entity) AS entities, any_value(t.entities) AS entities_tot, CAST(100.0 AS DOUBLE) * count(DISTINCT u.entity) / any_value(t.entities) AS pct, CAST(100.0 AS DOUBLE) * count(*) / any_value(t.records) AS pct_records FROM uses u JOIN tot t USING (genre, year) GROUP BY u.genre, u.year, u.item)"
YEARS = f"years AS (SELECT CAST(unnest(range({Y0}, {Y1 + 1})) AS INTEGER) AS year)"
CURVE = """keys AS (SELECT item, genre FROM (SELECT DISTINCT item FROM ado) CROSS JOIN (SELECT DISTINCT genre FROM ado)),
dense AS (SELECT genre, item, year, coalesce(pct, CAST(0 AS DOUBLE)) AS r, coalesce(entities, 0) AS n FROM keys CROSS JOIN years LEFT JOIN ado USING (genre, item, year)),
curve AS (SELECT *, avg(r) OVER (PARTITION BY genre, item ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM dense)"""
PEAK = f"peak AS (SELECT genre, item, year AS py, s AS P, n AS n_py, {Y0} AS y0 FROM (SELECT *, row_number() OVER (PARTITION BY genre, item ORDER BY s DESC, year) AS k FROM curve) WHERE k = 1)"


def base(item: str = "p_type") -> tuple[str, ...]:
    return REC, uses_sql(item), TOT, ADO, YEARS, CURVE, PEAK


def rise_sql(name: str, frac: float, users: int, mode: str = "pre_peak") -> str:
    low = "coalesce(min(s) FILTER (year < py), 0)" if mode == "pre_peak" else "min(s)"
    return f"""{name}_base AS (SELECT genre, item, any_value(py) AS py, any_value(P) AS P, any_value(n_py) AS n_py, {low} AS b FROM curve JOIN peak USING (genre, item) GROUP BY genre, item),
{name} AS (SELECT genre, item, any_value(x.py) AS py, any_value(x.P) AS P, CASE WHEN any_value(x.P) > 0 AND any_value(n_py) >= {users}
  THEN coalesce(max(year) FILTER (year < x.py AND s < b + {frac} * (x.P - b)) + 1, {Y0}) END AS year FROM curve JOIN {name}_base x USING (genre, item) GROUP BY genre, item)"""


@query(sql(REC, TOT) + " SELECT genre, CAST(year AS BIGINT) AS year, records, entities FROM tot")
def genre_year_totals(spark, d):
    return longs(A.totals(active(spark, d)), "year")


@query(sql(REC, uses_sql(), TOT, ADO) + " SELECT genre, CAST(year AS BIGINT) AS year, item, records, entities, entities_tot, round(pct, 4) AS pct, round(pct_records, 4) AS pct_records FROM ado")
def adoption_counts(spark, d):
    return longs(rounded(A.adoption(uses(spark, d), active(spark, d)), "pct", "pct_records"), "year")


@query(sql(*base()) + " SELECT genre, item, CAST(year AS BIGINT) AS year, round(r, 4) AS r, round(s, 4) AS s, CAST(n AS BIGINT) AS n FROM curve")
def adoption_curve(spark, d):
    return longs(rounded(curves(spark, d).select("genre", "item", "year", "r", "s", "n"), "r", "s"), "year", "n")


def _rise(spark, d, mode):
    return longs(rounded(L.rise_year(arrays(spark, d), 0.25, 5, mode), "P"), "py", "year")


RISE = " SELECT genre, item, CAST(py AS BIGINT) AS py, round(P, 4) AS P, CAST(year AS BIGINT) AS year FROM rise"


@query(sql(*base(), rise_sql("rise", 0.25, 5)) + RISE)
def takeoff_pre_peak(spark, d):
    return _rise(spark, d, "pre_peak")


@query(sql(*base(), rise_sql("rise", 0.25, 5, "global")) + RISE)
def takeoff_global_base(spark, d):
    return _rise(spark, d, "global")


@query(sql(*base("p_name")) + " SELECT genre, item, CAST(min(year) FILTER (s >= 0.75 * P AND n >= 3) AS BIGINT) AS emerged FROM curve JOIN peak USING (genre, item) GROUP BY ALL")
def emergence_forward(spark, d):
    return longs(L.emergence(arrays(spark, d, "p_name"), 0.75, 3), "emerged")


NOW = f"now AS (SELECT genre, item, avg(r) AS now FROM curve WHERE year > {Y1 - 2} GROUP BY ALL)"
GROWTH = f"growth AS (SELECT genre, item, py, P, now, now / P AS now_vs_peak, P / (c.s + 0.02) AS rise_x FROM peak JOIN now USING (genre, item) JOIN curve c USING (genre, item) WHERE c.year = greatest({Y0}, py - 2))"


@query(sql(*base("p_name"), NOW, GROWTH) + " SELECT genre, item, CAST(py AS BIGINT) AS py, round(P, 4) AS P, round(now, 4) AS now, round(now_vs_peak, 4) AS now_vs_peak, round(rise_x, 4) AS rise_x FROM growth WHERE P > 0")
def growth_now_vs_peak(spark, d):
    return longs(rounded(L.growth(arrays(spark, d, "p_name"), back=2).where("P > 0"), "P", "now", "now_vs_peak", "rise_x"), "py")


@query(
    sql(*base("p_name"), NOW, f"early AS (SELECT genre, item, avg(s) AS e FROM curve WHERE year < {Y0 + 4} GROUP BY ALL)")
    + """ SELECT genre, item, CASE WHEN e >= 0.8 * P THEN CASE WHEN now >= 0.5 * P THEN 'staple' ELSE 'faded' END WHEN now >= 0.85 * P AND py >= 2000 THEN 'rising'
    WHEN now <= 0.35 * P THEN 'faded' ELSE 'cooling' END AS stage FROM peak JOIN now USING (genre, item) JOIN early USING (genre, item) WHERE P > 0"""
)
def stage(spark, d):
    return L.stage(arrays(spark, d, "p_name"), rising_from=2000, early=0.8)


RATIO = f"""ratio AS (SELECT item, ln((coalesce(sum(records) FILTER (genre = '{FOCAL}'), 0) + 5.0) / (SELECT sum(records) FILTER (genre = '{FOCAL}') FROM tot WHERE year >= 1996))
  - ln((coalesce(sum(records) FILTER (genre IN ('AUTOMOBILE', 'MACHINERY', 'FURNITURE')), 0) + 5.0) / (SELECT sum(records) FILTER (genre IN ('AUTOMOBILE', 'MACHINERY', 'FURNITURE')) FROM tot WHERE year >= 1996)) AS ratio
  FROM ado WHERE year >= 1996 GROUP BY item)"""


def ratios(spark, d, item="p_name"):
    a = active(spark, d)
    return L.log_ratio(A.adoption(uses(spark, d, item), a), A.totals(a), FOCAL, OTHERS, 1996)


@query(sql(REC, uses_sql("p_name"), TOT, ADO, RATIO) + " SELECT item, round(ratio, 4) AS ratio FROM ratio")
def log_ratio_star(spark, d):
    return rounded(ratios(spark, d), "ratio")


CATEGORY = {"ratio": -0.2, "peak": 0.25, "faded": (1998, 0.5, 1.1), "rising": (1996, 0.7, 1.2), "staple": (1997, 0.6)}


@query(
    sql(*base("p_name"), NOW, GROWTH, RATIO, "em AS (SELECT genre, item, min(year) FILTER (s >= 0.75 * P AND n >= 3) AS emerged FROM curve JOIN peak USING (genre, item) GROUP BY ALL)")
    + f""" SELECT item, CASE WHEN ratio IS NULL OR ratio < -0.2 OR round_even(P, 3) < 0.25 OR regexp_full_match(item, '[0-9]+') THEN NULL
    WHEN py <= 1998 AND round_even(now_vs_peak, 3) <= 0.5 AND round_even(rise_x, 1) >= 1.1 THEN 'faded'
    WHEN emerged >= 1996 AND round_even(now_vs_peak, 3) >= 0.7 AND round_even(rise_x, 1) >= 1.2 THEN 'rising'
    WHEN emerged <= 1997 AND round_even(now_vs_peak, 3) >= 0.6 THEN 'staple' ELSE 'other' END AS category
    FROM growth LEFT JOIN em USING (genre, item) LEFT JOIN ratio USING (item) WHERE genre = '{FOCAL}'"""
)
def category(spark, d):
    c = arrays(spark, d, "p_name").where(F.col("genre") == FOCAL)
    return L.category(L.growth(c, back=2), L.emergence(c, 0.75, 3), ratios(spark, d), CATEGORY)


CROSS = f"""cross_ AS (SELECT r.item, r.genre, r.P AS peak, CASE WHEN r.P > 0 THEN r.py END AS peak_year, CASE WHEN r.P >= 0.1 THEN r.year END AS takeoff,
  f.year AS focal_takeoff, f.P AS focal_peak, CASE WHEN r.P >= 0.1 THEN r.year END - f.year AS lag, r.P / f.P AS reach
  FROM rise r JOIN rise f ON f.item = r.item AND f.genre = '{FOCAL}' AND f.P > 0 WHERE r.genre <> '{FOCAL}')"""


def crossed(spark, d):
    return L.crossover(arrays(spark, d, "p_name"), FOCAL, 0.25, 2)


@query(
    sql(*base("p_name"), rise_sql("rise", 0.25, 2), CROSS)
    + " SELECT item, genre, round(peak, 4) AS peak, CAST(peak_year AS BIGINT) AS peak_year, CAST(takeoff AS BIGINT) AS takeoff, CAST(focal_takeoff AS BIGINT) AS focal_takeoff, round(focal_peak, 4) AS focal_peak, CAST(lag AS BIGINT) AS lag, round(reach, 4) AS reach FROM cross_"
)
def crossover_lag(spark, d):
    return longs(rounded(crossed(spark, d), "peak", "focal_peak", "reach"), "peak_year", "takeoff", "focal_takeoff", "lag")


@query(sql(*base("p_name"), rise_sql("rise", 0.25, 2), CROSS) + " SELECT genre, count(*) AS items, round(quantile_cont(lag, 0.5), 4) AS median, CAST(sum(CASE WHEN lag >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS slow FROM cross_ WHERE focal_takeoff >= 1995 AND lag >= -3 GROUP BY genre")
def crossover_median(spark, d):
    return longs(rounded(V.crossover_medians(crossed(spark, d), 1995, slow=3), "median"), "slow")


@query(sql(*base("p_name"), rise_sql("rise", 0.25, 2), CROSS) + " SELECT genre, CAST(rank AS BIGINT) AS rank, item, round(reach, 4) AS reach FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY reach DESC, item) AS rank FROM cross_ WHERE focal_peak >= 1 AND peak > 0) WHERE rank <= 20")
def reach_top(spark, d):
    return longs(rounded(V.reach_top(crossed(spark, d)), "reach"), "rank")


BURST = f"""burst AS (SELECT genre, item, py, P, py - start + 1 AS rise, keep FROM (
  SELECT p.genre, p.item, p.py, p.P, coalesce((SELECT max(year) FROM curve c WHERE c.genre = p.genre AND c.item = p.item AND c.year < p.py AND c.s < 0.8 * p.P) + 1, {Y0}) AS start,
    (SELECT s FROM curve c WHERE c.genre = p.genre AND c.item = p.item AND c.year = p.py + 1) / p.P AS keep
  FROM peak p JOIN curve b ON b.genre = p.genre AND b.item = p.item AND b.year = greatest({Y0}, p.py - 3) WHERE P >= 0.5 AND n_py >= 3 AND b.s <= P * 0.9) WHERE start > {Y0})"""
RANGES = [(1995, 1997), (1998, 1999), (2000, 2001)]


def burst(spark, d):
    return L.bursts(arrays(spark, d, "p_name"), 0.5, 3, back=3, prior=0.9, frac=0.8, keep_after=1)


@query(sql(*base("p_name"), BURST) + " SELECT genre, item, CAST(py AS BIGINT) AS py, round(P, 4) AS P, CAST(rise AS BIGINT) AS rise, round(keep, 4) AS keep FROM burst")
def burst_words(spark, d):
    return longs(rounded(burst(spark, d).drop("c"), "P", "keep"), "py", "rise")


ERA = "CASE WHEN py BETWEEN 1995 AND 1997 THEN 1995 WHEN py BETWEEN 1998 AND 1999 THEN 1998 WHEN py BETWEEN 2000 AND 2001 THEN 2000 END"


@query(
    sql(*base("p_name"), BURST, f"u AS (SELECT {ERA} AS cohort_from, CAST(unnest(range(-3, 4)) AS INTEGER) AS o, genre, item, py, P FROM burst)", "w AS (SELECT cohort_from, o, CASE WHEN c.s IS NOT NULL THEN least(CAST(1.0 AS DOUBLE), c.s / round_even(u.P, 2)) END AS x FROM u LEFT JOIN curve c ON c.genre = u.genre AND c.item = u.item AND c.year = u.py + o)")
    + ' SELECT CAST(cohort_from AS BIGINT) AS cohort_from, CAST(o AS BIGINT) AS "offset", count(x) AS n, CASE WHEN count(x) >= 3 THEN round(quantile_cont(x, 0.5), 4) END AS median FROM w GROUP BY ALL'
)
def cohort_aligned_median(spark, d):
    return longs(rounded(L.cohorts(burst(spark, d), RANGES, (-3, 3), 3).drop("cohort_to"), "median"), "cohort_from", "offset")


@query(
    sql(*base("p_name"), BURST, f"f AS (SELECT {ERA} AS e, count(*) AS items, quantile_cont(rise, 0.25) AS rise_q1, quantile_cont(rise, 0.5) AS rise_median, quantile_cont(rise, 0.75) AS rise_q3, quantile_cont(keep, 0.5) AS keep_median FROM burst GROUP BY 1)")
    + " SELECT CAST(e AS BIGINT) AS cohort_from, items, round(rise_q1, 4) AS rise_q1, round(rise_median, 4) AS rise_median, round(rise_q3, 4) AS rise_q3, round(keep_median, 4) AS keep_median FROM f"
)
def cohort_quartiles(spark, d):
    df = L.cohort_facts(burst(spark, d), RANGES).select("cohort_from", "items", "rise_q1", "rise_median", "rise_q3", "keep_median")
    return longs(rounded(df, "rise_q1", "rise_median", "rise_q3", "keep_median"), "cohort_from")


@query(
    sql(*base("p_name"), BURST, f"f AS (SELECT {ERA} AS e, quantile_cont(rise, 0.5) AS rm, quantile_cont(keep, 0.5) AS km FROM burst GROUP BY 1)")
    + " SELECT round(min(rm), 4) AS rise_min, round(max(rm), 4) AS rise_max, round(min(km), 4) AS keep_min, round(max(km), 4) AS keep_max FROM f"
)
def cohort_extremes(spark, d):
    return rounded(V.cohort_extremes(L.cohort_facts(burst(spark, d), RANGES)), "rise_min", "rise_max", "keep_min", "keep_max")


@query(
    sql(*base("p_name"), f"top AS (SELECT genre, year, item FROM (SELECT *, row_number() OVER (PARTITION BY genre, year ORDER BY r DESC, item) AS k FROM curve) WHERE k <= 10)")
    + f" SELECT a.genre, CAST(a.year AS BIGINT) AS year, round(count(b.item) / 10.0, 4) AS kept FROM top a LEFT JOIN top b ON b.genre = a.genre AND b.item = a.item AND b.year = a.year + 2 WHERE a.year <= {Y1 - 2} GROUP BY ALL"
)
def churn_topk(spark, d):
    return longs(rounded(L.churn(curves(spark, d, "p_name"), 10, 2), "kept"), "year")


@query(sql(REC) + f" SELECT entity FROM rec LEFT JOIN (SELECT c_custkey AS entity, CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS sitelinks FROM customer) f USING (entity) WHERE genre = '{FOCAL}' GROUP BY entity HAVING count(*) >= 14 OR coalesce(max(sitelinks), 0) > 0")
def pool_filter(spark, d):
    fame = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") > 9000, 1).otherwise(0).alias("sitelinks"))
    return L.pool(active(spark, d), FOCAL, 14, fame)


@query(sql(REC, uses_sql("p_name"), TOT, ADO, RATIO) + " SELECT item FROM ratio WHERE ratio >= 0 AND NOT regexp_full_match(item, '[0-9]+') AND NOT regexp_full_match(item, '(?:red .*)') AND item NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 11 AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 12))")
def candidate_vocab(spark, d):
    p = table(spark, d, "part")
    names, words = p.where("p_size = 11").select(F.col("p_name").alias("name")), p.where("p_size = 12").select(F.lower("p_name").alias("word")).distinct()
    return L.candidates(ratios(spark, d), names, words, 0.0, "red .*")


ATTRS = f"""attrs AS (SELECT c_custkey AS entity, c_name AS name, coalesce(n, 0) AS records, CASE WHEN c_acctbal > 5000 THEN CAST(floor(c_acctbal / 1000) AS BIGINT) ELSE 0 END AS sitelinks, c_nationkey % 2 = 0 AS in_base
  FROM customer LEFT JOIN (SELECT entity, count(*) FILTER (genre = '{FOCAL}') AS n FROM rec GROUP BY entity) ON entity = c_custkey),
note AS (SELECT *, (sitelinks > 0 OR (in_base AND records >= 10)) AND NOT regexp_matches(name, '#0000001') AS notable FROM attrs)"""


def attributes(spark, d):
    c = table(spark, d, "customer")
    known = c.select(F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") > 5000, F.floor(F.col("c_acctbal") / 1000)).otherwise(0).cast("long").alias("sitelinks"), F.when(F.col("c_nationkey") % 2 == 0, "Q").alias("base_id"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("scene"))
    a = P.attributes(active(spark, d), c.select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name")), FOCAL, known)
    return P.notable(a.fillna({"records": 0}), 10, "#0000001")


def focal_uses(spark, d, item="p_brand"):
    return uses(spark, d, item).where(F.col("genre") == FOCAL).withColumn("title", F.concat(F.lit("order "), F.col("record")))


GUARD = f"""p10 AS (SELECT entity, quantile_cont(year, 0.1) AS p10 FROM rec WHERE genre = '{FOCAL}' GROUP BY entity),
g AS (SELECT u.*, 'order ' || record AS title FROM uses u JOIN p10 USING (entity) WHERE genre = '{FOCAL}' AND year >= p10 - 0.5)"""


def guarded(spark, d):
    return P.guard(focal_uses(spark, d), active(spark, d).where(F.col("genre") == FOCAL), 0.5)


@query(sql(REC, uses_sql("p_brand"), GUARD) + " SELECT record, item, CAST(year AS BIGINT) AS year FROM g")
def misdated_guard(spark, d):
    return longs(guarded(spark, d).select("record", "item", "year"), "year")


@query(sql(REC, ATTRS) + " SELECT entity, CAST(records AS BIGINT) AS records, sitelinks, in_base, notable, round(sitelinks + ln(1 + records) / 10, 4) AS fame FROM note")
def notable(spark, d):
    return longs(rounded(attributes(spark, d).select("entity", "records", "sitelinks", "in_base", "notable", "fame"), "fame"), "records")


@query(sql(REC, uses_sql("p_brand"), GUARD, "b AS (SELECT item, year, count(DISTINCT entity) AS n FROM g GROUP BY ALL)") + " SELECT item, CAST(coalesce(min(year) FILTER (n >= 2), min(year)) AS BIGINT) AS first_seen, (SELECT count(DISTINCT entity) FROM g WHERE g.item = b.item) AS entities FROM b GROUP BY item")
def first_seen(spark, d):
    return longs(P.first_seen(guarded(spark, d)), "first_seen")


def life(spark, d):
    c = arrays(spark, d, "p_brand").where(F.col("genre") == FOCAL)
    ser = L.with_rise(L.with_rise(L.series(c), "emerged", 0.1, 5), "takeoff", 0.25, 5)
    return ser.select("item", "emerged", "takeoff", (F.col("item").endswith("1")).alias("poly"))


LIFE = f"life AS (SELECT e.item, e.year AS emerged, t.year AS takeoff, ends_with(e.item, '1') AS poly FROM em e JOIN tk t USING (genre, item) WHERE genre = '{FOCAL}')"
PEOPLE = (*base("p_brand"), rise_sql("em", 0.1, 5), rise_sql("tk", 0.25, 5), LIFE, ATTRS, GUARD)


@query(
    sql(*PEOPLE, "run AS (SELECT g.item, g.entity, n.name, takeoff, poly, year, record, title FROM g JOIN life USING (item) JOIN note n USING (entity) WHERE takeoff IS NOT NULL AND notable AND year >= coalesce(emerged, takeoff) - CASE WHEN poly THEN 1 ELSE 3 END AND year <= takeoff + 2)", "per AS (SELECT item, entity, name, takeoff, poly, count(*) AS n, min(year) AS year, arg_min(title, CAST(year AS BIGINT) * 100000000000 + record) AS title FROM run GROUP BY item, entity, name, takeoff, poly)")
    + " SELECT item, CAST(rank AS BIGINT) AS rank, entity, name, CAST(year AS BIGINT) AS year, title, n FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY year, n DESC, entity) AS rank FROM per WHERE n >= CASE WHEN poly THEN 3 ELSE 2 END AND year <= takeoff) WHERE rank <= 6"
)
def early_adopters(spark, d):
    df = P.early_adopters(guarded(spark, d), attributes(spark, d), life(spark, d))
    return longs(df.select("item", "rank", "entity", "name", "year", "title", "n"), "rank", "year")


@query(
    sql(*PEOPLE, "per AS (SELECT item, entity, count(*) AS n, min(year) AS year, arg_min(title, CAST(year AS BIGINT) * 100000000000 + record) AS title FROM g JOIN life USING (item) WHERE takeoff IS NOT NULL AND year BETWEEN takeoff - 2 AND takeoff + 1 GROUP BY ALL)")
    + " SELECT item, CAST(rank AS BIGINT) AS rank, entity, name, CAST(year AS BIGINT) AS year, title, n, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, entity) AS rank FROM (SELECT per.*, name, ln(1 + greatest(sitelinks, 1)) * n AS score FROM per JOIN note USING (entity) WHERE notable AND records >= 12)) WHERE rank <= 5"
)
def popularizers(spark, d):
    return longs(rounded(P.popularizers(guarded(spark, d), attributes(spark, d), life(spark, d), catalogue=12), "score"), "rank", "year")


@query(
    sql(*PEOPLE, "per AS (SELECT item, entity, count(*) AS n, min(year) AS y0, max(year) AS y1 FROM g GROUP BY ALL HAVING count(*) >= 3)")
    + " SELECT item, CAST(rank AS BIGINT) AS rank, entity, name, n, round(n / records, 4) AS share, CAST(y0 AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1 FROM (SELECT per.*, name, records, row_number() OVER (PARTITION BY item ORDER BY n DESC, entity) AS rank FROM per JOIN note USING (entity) WHERE notable) WHERE rank <= 5"
)
def signature(spark, d):
    return longs(rounded(P.signature(guarded(spark, d), attributes(spark, d), least=3), "share"), "rank", "y0", "y1")


REG = "reg AS (SELECT c_custkey AS entity, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def rcurve_sql(valid: int) -> str:
    return f"""ract AS (SELECT region, year, count(DISTINCT entity) AS active FROM rec JOIN reg USING (entity) GROUP BY ALL),
rn AS (SELECT item, region, year, count(DISTINCT entity) AS n FROM uses JOIN reg USING (entity) GROUP BY ALL),
rdense AS (SELECT item, region, year, coalesce(n, 0) AS n, coalesce(active, 0) AS active, coalesce(active, 0) >= {valid} AND coalesce(active, 0) > 0 AS valid,
  CASE WHEN coalesce(active, 0) >= {valid} AND coalesce(active, 0) > 0 THEN CAST(100.0 AS DOUBLE) * coalesce(n, 0) / active ELSE 0 END AS r
  FROM (SELECT DISTINCT item FROM rn) CROSS JOIN (SELECT DISTINCT region FROM reg) CROSS JOIN years LEFT JOIN rn USING (item, region, year) LEFT JOIN ract USING (region, year)),
rcurve AS (SELECT *, avg(r) OVER (PARTITION BY item, region ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM rdense)"""


def rcurves(spark, d, valid, item="p_brand"):
    return R.regional_curves(uses(spark, d, item), active(spark, d), regions(spark, d), Y0, Y1, valid)


@query(sql(REC, uses_sql("p_brand"), YEARS, REG, rcurve_sql(0)) + " SELECT item, region, CAST(year AS BIGINT) AS year, round(s, 4) AS s, n, active FROM rcurve")
def regional_curve(spark, d):
    return longs(rounded(rcurves(spark, d, 0).select("item", "region", "year", "s", "n", "active"), "s"), "year")


@query(sql(REC, uses_sql("p_brand"), REG) + " SELECT u.item, region, round(CAST(100.0 AS DOUBLE) * count(DISTINCT u.entity) / (SELECT count(DISTINCT entity) FROM rec JOIN reg r USING (entity) WHERE r.region = g.region), 4) AS ever FROM uses u JOIN reg g USING (entity) GROUP BY u.item, region")
def regional_ever(spark, d):
    return rounded(R.ever_share(uses(spark, d, "p_brand"), active(spark, d), regions(spark, d)), "ever")


RTAKE = f"""rpeak AS (SELECT item, region, year AS py, s AS P, n AS n_py FROM (SELECT *, row_number() OVER (PARTITION BY item, region ORDER BY s DESC, year) AS k FROM rcurve) WHERE k = 1 AND s >= 1.0 AND n >= 2),
rstop AS (SELECT item, region, any_value(p.py) AS py, max(year) FILTER (year < p.py AND (s < 0.7 * p.P OR NOT valid)) AS stop FROM rcurve JOIN rpeak p USING (item, region) GROUP BY ALL),
rtake AS (SELECT x.item, x.region, coalesce(stop + 1, {Y0}) AS year, stop IS NULL OR NOT b.valid AS established, c.s AS level FROM rstop x
  JOIN rcurve c ON c.item = x.item AND c.region = x.region AND c.year = coalesce(stop + 1, {Y0}) LEFT JOIN rcurve b ON b.item = x.item AND b.region = x.region AND b.year = stop)"""


def rtakes(spark, d):
    return R.regional_takeoff(R.regional_arrays(uses(spark, d, "p_name"), active(spark, d), regions(spark, d), Y0, Y1, 3), 1.0, 2, 0.7)


@query(sql(REC, uses_sql("p_name"), YEARS, REG, rcurve_sql(3), RTAKE) + " SELECT item, region, CAST(year AS BIGINT) AS year, established, round(level, 4) AS level FROM rtake")
def regional_takeoff(spark, d):
    return longs(rounded(rtakes(spark, d), "level"), "year")


@query(
    sql(REC, uses_sql("p_name"), YEARS, REG, rcurve_sql(3), RTAKE, "o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY year, level DESC, region) AS k, count(*) OVER (PARTITION BY item) AS m FROM rtake)")
    + " SELECT item, max(region) FILTER (k = 1) AS origin, CAST(max(year) FILTER (k = 1) AS BIGINT) AS year, bool_or(established) FILTER (k = 1) AS established, round(quantile_cont(year, 0.5) FILTER (k > 1), 4) AS others, round(quantile_cont(year, 0.5) FILTER (k > 1) - max(year) FILTER (k = 1), 4) AS lead FROM o WHERE m >= 2 GROUP BY item"
)
def diffusion_origin(spark, d):
    return longs(rounded(R.origin(rtakes(spark, d)), "others", "lead"), "year")


@query(
    sql(REC, uses_sql("p_name"), REG, "y AS (SELECT region, item, count(DISTINCT entity) AS y FROM uses JOIN reg USING (entity) GROUP BY ALL)", "t AS (SELECT region, count(DISTINCT entity) AS n FROM rec JOIN reg USING (entity) GROUP BY ALL)",
        "s AS (SELECT y.region, y.item, y.y AS y1, tot - y.y AS y2, n, (SELECT sum(n) FROM t) - n AS n2, tot / (SELECT CAST(sum(y) AS DOUBLE) FROM y) * 50 AS a FROM y JOIN t USING (region) JOIN (SELECT item, CAST(sum(y) AS BIGINT) AS tot FROM y GROUP BY item) USING (item))",
        "z AS (SELECT *, (ln((y1 + a) / (n + 50 - y1 - a)) - ln((y2 + a) / (n2 + 50 - y2 - a))) / sqrt(1 / (y1 + a) + 1 / (y2 + a)) AS z, 100.0 * y1 / n AS share, 100.0 * y2 / n2 AS rest FROM s)")
    + " SELECT region, item, y1 AS n, round(CAST(share AS DOUBLE), 4) AS share, round(CAST(rest AS DOUBLE), 4) AS rest, round(z, 4) AS z FROM z WHERE y1 >= greatest(3, 0.015 * n) AND share >= 1.1 * rest AND z > 1.0"
)
def regional_distinct(spark, d):
    return rounded(R.distinctive(uses(spark, d, "p_name"), active(spark, d), regions(spark, d), 50.0, 3, 0.015, 1.1, 1.0), "share", "rest", "z")


@query(
    sql(REC, uses_sql("p_brand"), f"pool AS (SELECT entity FROM rec WHERE genre = '{FOCAL}' GROUP BY entity HAVING count(*) >= 14)", f"t AS (SELECT year, count(DISTINCT entity) AS n FROM rec SEMI JOIN pool USING (entity) WHERE genre = '{FOCAL}' GROUP BY year)")
    + f" SELECT item, CAST(u.year AS BIGINT) AS year, count(DISTINCT entity) AS entities, any_value(t.n) AS entities_tot, round(CAST(100.0 AS DOUBLE) * count(DISTINCT entity) / any_value(t.n), 4) AS pct FROM uses u SEMI JOIN pool USING (entity) JOIN t USING (year) WHERE genre = '{FOCAL}' GROUP BY ALL"
)
def pool_rates(spark, d):
    """Rates within the pool, from presence words of uses and of records."""
    a = active(spark, d)
    present = B.presence(uses(spark, d, "p_brand"), "genre", "year", "item")
    found = A.pool_shares(present, B.presence(a, "genre", "year"), L.pool(a, FOCAL, 14), FOCAL)
    return longs(rounded(found.select("item", "year", "entities", "entities_tot", "pct"), "pct"), "year")


@query(sql(REC, uses_sql("p_name")) + " SELECT item, count(*) AS records, count(DISTINCT entity) AS entities, count(DISTINCT entity) FILTER (year >= 1998) AS late FROM uses GROUP BY item")
def presence_totals(spark, d):
    """Distinct entities of an item over all years and over some, from one presence table by year."""
    table = B.presence(uses(spark, d, "p_name"), "year", "item")
    late = B.counted(table.where("year >= 1998"), "item").select("item", F.col("entities").alias("late"))
    return B.counted(table, "item").join(late, "item", "left").fillna({"late": 0}).select("item", "records", "entities", "late")


@query(
    """WITH span AS (SELECT o_custkey AS entity, min(year(o_orderdate) * 12 + month(o_orderdate)) AS lo, max(year(o_orderdate) * 12 + month(o_orderdate)) AS hi FROM orders GROUP BY o_custkey),
    m AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS month FROM orders) SELECT CAST(month AS BIGINT) AS month, count(*) AS entities, CAST(sum(hi - lo) AS BIGINT) AS months FROM m JOIN span ON month BETWEEN lo AND hi GROUP BY month"""
)
def interval_join(spark, d):
    """Entities between their first and last record in each month: months in intervals of a table, however many and however long."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), month.alias("month"))
    spans = o.groupBy("entity").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    inside = I.contained(o.select("month").distinct(), "month", spans, "lo", "hi")
    return inside.groupBy("month").agg(F.count("*").alias("entities"), F.sum(F.col("hi") - F.col("lo")).alias("months"))


@query(sql(*base()) + " SELECT genre, item, CAST(year AS BIGINT) AS year, round(100 * s / max(s) OVER (PARTITION BY genre, item), 4) AS idx FROM curve")
def index_to_peak(spark, d):
    return longs(rounded(V.index_to_peak(curves(spark, d)), "idx"), "year")


@query(sql(REC, uses_sql("p_name"), TOT, ADO) + " SELECT genre, CAST(year AS BIGINT) AS year, CAST(k AS BIGINT) AS rank, item FROM (SELECT *, row_number() OVER (PARTITION BY genre, year ORDER BY pct DESC, item) AS k FROM ado) WHERE k <= 5")
def topk_per_group(spark, d):
    from pyspark.sql import Window as W

    a = A.adoption(uses(spark, d, "p_name"), active(spark, d))
    order = W.partitionBy("genre", "year").orderBy(F.desc("pct"), "item")
    return longs(a.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("genre", "year", "rank", "item"), "year", "rank")


@query(sql(REC) + f" SELECT CAST(count(*) FILTER (genre = '{FOCAL}') AS BIGINT) AS focal_records, count(DISTINCT entity) FILTER (genre = '{FOCAL}') AS focal_entities, CAST(count(*) FILTER (genre <> '{FOCAL}') AS BIGINT) AS other_records, CAST(25 AS BIGINT) AS terms FROM rec")
def headline_stats(spark, d):
    return V.headline(active(spark, d), FOCAL, 25)


@query(sql(REC, uses_sql("p_brand"), YEARS, REG, rcurve_sql(0)) + " SELECT item, region, CAST(sum(active) AS BIGINT) AS entity_years FROM rcurve GROUP BY ALL HAVING sum(active) >= 1000")
def diffusion_regions(spark, d):
    return V.diffusion_regions(rcurves(spark, d, 0), 1000)


@query()
def profile_json(spark, d):
    from ..sources.tables import json_rows

    return json_rows(V.profiles(arrays(spark, d, "p_brand"), life(spark, d)))
