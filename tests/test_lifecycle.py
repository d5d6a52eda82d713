"""Life-cycle operators against loops over each curve."""

import random

import pytest
from pyspark.sql import functions as F

from wordtide.operators import adoption as A
from wordtide.operators import lifecycle as L
from wordtide.operators import people as P
from wordtide.operators import regional as R

Y0 = 1990


def curves(spark, series, users=10):
    """item -> raw rates, as a smoothed curve."""
    rows = [("g", k, Y0 + i, float(v), users) for k, c in series.items() for i, v in enumerate(c)]
    return A.smooth(spark.createDataFrame(rows, "genre string, item string, year int, r double, n int"), ["genre", "item"])


def exact(spark, series, users=10):
    rows = [("g", k, Y0 + i, float(v), float(v), users) for k, c in series.items() for i, v in enumerate(c)]
    return spark.createDataFrame(rows, "genre string, item string, year int, r double, s double, n int")


def walk_back(s, frac, base):
    py = max(range(len(s)), key=lambda i: (s[i], -i))
    level = base(s, py) + frac * (s[py] - base(s, py))
    y = py
    while y > 0 and s[y - 1] >= level:
        y -= 1
    return Y0 + py, (Y0 + y if s[py] > 0 else None)


@pytest.mark.parametrize("mode", ["pre_peak", "global"])
def test_walk_back_is_the_loop(spark, mode):
    r = random.Random(1)
    series = {f"i{k}": [r.choice([0, 0, 1, 2, 3, 5, 8]) * r.random() if r.random() < 0.7 else r.choice([0, 1, 2]) for _ in range(12)] for k in range(300)}
    base = (lambda s, py: min(s[:py], default=0.0)) if mode == "pre_peak" else (lambda s, py: min(s))
    got = {x["item"]: (x["py"], x["year"]) for x in L.rise_year(exact(spark, series), 0.25, 5, mode).collect()}
    assert got == {k: walk_back(s, 0.25, base) for k, s in series.items()}


def test_first_peak_wins_and_thin_peaks_are_null(spark):
    c = exact(spark, {"tie": [0, 0, 2, 4, 8, 8, 1]})
    assert L.rise_year(c, 0.25).first()["py"] == Y0 + 4
    assert L.rise_year(exact(spark, {"thin": [0, 1, 5]}, 4), 0.25).first()["year"] is None


def test_missing_years_are_zero_and_edges_average_two(spark):
    uses = spark.createDataFrame([(1, 1, "g", 2000, "x"), (2, 2, "g", 2002, "x")], "record int, entity int, genre string, year int, item string")
    active = spark.createDataFrame([(i, e, "g", y) for i, (e, y) in enumerate([(1, 2000), (1, 2001), (2, 2002), (3, 2002)])], "record int, entity int, genre string, year int")
    got = A.curve(A.adoption(uses, active), 2000, 2003).orderBy("year").collect()
    assert [r["r"] for r in got] == [100.0, 0.0, 50.0, 0.0] and [r["s"] for r in got] == [50.0, 50.0, pytest.approx(50 / 3), 25.0]


def test_stages_and_literal_stage(spark):
    c = exact(spark, {"staple": [5, 5, 5, 5, 6, 5], "faded": [5, 5, 5, 5, 6, 1, 1], "rise": [0, 0, 0, 0, 1, 9, 9], "cool": [0, 0, 0, 0, 9, 5, 5], "gone": [0, 0, 0, 0, 9, 1, 1], "none": [0] * 7})
    got = {r["item"]: r["stage"] for r in L.stage(c, rising_from=Y0 + 5).collect()}
    assert got == {"staple": "staple", "faded": "faded", "rise": "rising", "cool": "cooling", "gone": "faded"}
    assert "staple" not in {r["stage"] for r in L.stage(c, literal=True).collect()}


def test_bursts_and_cohorts(spark):
    c = exact(spark, {"burst": [0, 0, 1, 4, 8, 6, 4, 2], "old": [8, 8, 8, 8, 9, 8, 8, 8], "start": [9, 1, 1, 1, 1, 1, 1, 1]})
    b = L.bursts(c, back=3)
    [row] = b.collect()
    assert (row["item"], row["py"], row["rise"], row["keep"]) == ("burst", Y0 + 4, 2, 0.25)
    got = {r["offset"]: (r["n"], r["median"]) for r in L.cohorts(b, [(Y0, Y0 + 7)], (-5, 4), 1).collect()}
    assert got[0] == (1, 1.0) and got[-5] == (0, None) and got[3] == (1, 0.25) and got[4] == (0, None)


def test_churn_and_growth(spark):
    c = exact(spark, {"a": [3, 3, 1], "b": [2, 1, 2], "c": [2, 4, 3]})
    assert {r["year"]: r["kept"] for r in L.churn(c, 2, 1).collect()} == {Y0: 0.5, Y0 + 1: 0.5}
    g = L.growth(exact(spark, {"a": [0, 2, 4, 2]}), back=1).first()
    assert g["now"] == 3.0 and g["now_vs_peak"] == 0.75 and g["rise_x"] == pytest.approx(4 / 2.02)


def uses_of(spark, rows):
    return spark.createDataFrame([(i, e, "g", y, it, f"t{i}") for i, (e, y, it) in enumerate(rows)], "record int, entity int, genre string, year int, item string, title string")


def test_misdated_records_and_first_seen(spark):
    active = spark.createDataFrame([(i, 1, "g", 2000 + i) for i in range(11)], "record int, entity int, genre string, year int")
    got = P.guard(uses_of(spark, [(1, 1997, "x"), (1, 1998, "x")]), active).collect()  # the 10th percentile is 2001
    assert [r["year"] for r in got] == [1998]
    assert P.first_seen(uses_of(spark, [(1, 1990, "x"), (1, 1993, "x"), (2, 1993, "x")])).first()["first_seen"] == 1993
    assert P.first_seen(uses_of(spark, [(1, 1990, "x"), (2, 1991, "x")])).first()["first_seen"] == 1990


def test_takeoff_cannot_cross_thin_years(spark):
    rows = [("x", r, 2000 + i, s, s, 20, a, a >= 15) for r, act in (("N", [20] * 6), ("S", [20, 14, 20, 20, 20, 20])) for i, (s, a) in enumerate(zip([1.0, 3.0, 3.0, 6.0, 8.0, 8.0], act, strict=True))]
    c = spark.createDataFrame(rows, "item string, region string, year int, r double, s double, n int, active int, valid boolean")
    got = {r["region"]: (r["year"], r["established"]) for r in R.regional_takeoff(c).collect()}
    assert got == {"N": (2001, False), "S": (2002, True)}


def test_ties_go_to_the_heavier_user(spark):
    t = spark.createDataFrame([("x", "N", 2000, False, 1.0), ("x", "S", 2000, True, 5.0), ("x", "E", 2004, False, 9.0), ("y", "N", 2000, False, 1.0)], "item string, region string, year int, established boolean, level double")
    [row] = R.origin(t).collect()
    assert (row["item"], row["origin"], row["established"], row["lead"]) == ("x", "S", True, 2.0)


def test_category_uses_rounded_values(spark):
    grown = spark.createDataFrame([("a", 2010, 0.9, 0.3504, 5.0), ("b", 2010, 0.9, 0.351, 5.0), ("12", 2010, 0.9, 0.1, 5.0), ("n", 2010, 0.9, 0.1, 5.0)], "item string, py int, P double, now_vs_peak double, rise_x double")
    emerged = spark.createDataFrame([("a", 2000)], "item string, emerged int")
    ratios = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("12", 1.0)], "item string, ratio double")
    assert {r["item"]: r["category"] for r in L.category(grown, emerged, ratios).collect()} == {"a": "faded", "b": "other", "12": None, "n": None}


def test_adoption_never_exceeds_all(spark):
    d = "/root/testdata/sf0.001"
    from wordtide.plans import star

    bad = A.adoption(star.uses(spark, d), star.active(spark, d)).where((F.col("pct") > 100) | (F.col("entities") > F.col("entities_tot")))
    assert bad.count() == 0
