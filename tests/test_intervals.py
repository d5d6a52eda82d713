"""Points in intervals, eras that overlap, quantiles from counts: against loops."""

import random
import statistics

import pytest

from wordtide.functions.arrays import quantiles
from wordtide.operators import context as K
from wordtide.operators.intervals import contained


@pytest.mark.parametrize("seed", [1, 2])
def test_points_meet_the_intervals_around_them(spark, seed):
    rng = random.Random(seed)
    spans = [(i, a, a + rng.choice([0, 0, 1, 2, 3, 7, 8, 100, 5000])) for i in range(300) for a in [rng.randint(-50, 200)]]
    spans += [(900, 10, 9), (901, None, 5), (902, 5, None), (903, -(1 << 40), 1 << 40), (904, 3, 3), (905, 3, 3)]
    points = [rng.randint(-60, 210) for _ in range(200)] + [3, 3, None, 1 << 39, -(1 << 41)]
    p = spark.createDataFrame([(k, x) for k, x in enumerate(points)], "k int, x long")
    s = spark.createDataFrame(spans, "i int, lo long, hi long")
    want = sorted((k, i) for k, x in enumerate(points) for i, a, b in spans if None not in (x, a, b) and a <= x <= b)
    df = contained(p, "x", s, "lo", "hi")
    assert sorted((r["k"], r["i"]) for r in df.collect()) == want and df.columns == ["k", "x", "i", "lo", "hi"]
    plan = contained(p, "x", s, "lo", "hi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoopJoin") == 1 and plan.count("HashJoin") + plan.count("SortMergeJoin") == 1  # the one row of levels; the join
    assert contained(p.limit(0), "x", s, "lo", "hi").count() == 0 == contained(p, "x", s.limit(0), "lo", "hi").count()


def test_a_year_belongs_to_all_its_eras(spark):
    df = spark.createDataFrame([(y,) for y in (1990, 1995, 2000, None)], "year int")
    got = sorted(map(tuple, K.with_era(df, [("a", 1990, 1996), ("b", 1995, 1999)]).collect()))
    assert got == [(1990, "a"), (1995, "a"), (1995, "b")]


def test_quantiles_of_counted_values(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 5), rng.choice([None, *range(7)])) for _ in range(500)] + [(9, None), (10, 4)]
    got = {r["g"]: (r["a"], r["b"]) for r in quantiles(spark.createDataFrame(rows, "g int, v int"), ["g"], "v", {"a": 0.5, "b": 0.1}).collect()}
    assert 9 not in got and got[10] == (4.0, 4.0)
    for g in range(6):
        v = sorted(x for k, x in rows if k == g and x is not None)
        h = 0.1 * (len(v) - 1)
        assert got[g] == pytest.approx((statistics.median(v), v[int(h)] + (h - int(h)) * (v[int(h) + 1] - v[int(h)])))
