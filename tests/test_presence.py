"""Presence words against sets, and what plans read and shuffle."""

import random
from collections import defaultdict

import pytest

from wordtide.operators import presence as P
from wordtide.operators import regional as R
from wordtide.operators.adoption import pool_rates, pool_shares
from wordtide.plans import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(seed, n=2000):
    rng = random.Random(seed)
    who = [None, -1, -64, 0, 63, 64, 1 << 40, *range(100, 400)]
    return [(rng.choice(["a", "b", None]), rng.randint(2000, 2005), f"i{int(rng.paretovariate(1))}", rng.choice(who)) for _ in range(n)]


def test_counts_are_those_of_sets(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "genre string, year int, item string, entity long").repartition(3)
    table = P.presence(df, "genre", "year", "item")
    for keys in (("genre", "year", "item"), ("item",), ("genre", "year"), ()):
        n, who = defaultdict(int), defaultdict(set)
        for r in data:
            k = tuple(dict(zip(("genre", "year", "item"), r, strict=False))[c] for c in keys)
            n[k] += 1
            who[k].add(r[3])
        got = {tuple(r[c] for c in keys): (r["records"], r["entities"]) for r in P.counted(table, *keys).collect()}
        assert got == {k: (n[k], len(who[k] - {None})) for k in n}


def test_within_groups(spark):
    data = rows(2)
    of = {e: {"x"} if e % 2 else {"x", "y"} for e in [-1, 0, 63, 64, *range(100, 300)]}  # groups may overlap
    df = spark.createDataFrame(data, "genre string, year int, item string, entity long")
    members = P.presence(spark.createDataFrame([(e, g) for e, gs in of.items() for g in gs], "entity long, region string"), "region")
    want = defaultdict(set)
    for _, _, item, e in data:
        for g in of.get(e, ()):
            want[item, g].add(e)
    got = P.entities_within(P.presence(df, "year", "item"), members, "item")
    assert {(r["item"], r["region"]): r["entities"] for r in got.collect()} == {k: len(v) for k, v in want.items()}
    assert P.counted(P.presence(df.limit(0), "item"), "item").count() == 0 and P.entities_within(P.presence(df, "item"), members.limit(0), "item").count() == 0


def test_pool_shares_are_pool_rates(spark):
    data = [r for r in rows(3) if r[3] is not None and r[0]]
    df = spark.createDataFrame(data, "genre string, year int, item string, entity long")
    pool = spark.createDataFrame([(e,) for e in range(100, 250)], "entity long")
    counts = df.where("genre = 'a'").groupBy("entity", "year", "item").count().withColumnRenamed("count", "records")
    want = pool_rates(counts, df, pool, "a").select("year", "item", "entities", "entities_tot", "pct")
    got = pool_shares(P.presence(df, "genre", "year", "item"), P.presence(df, "genre", "year"), pool, "a").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_regional_arrays_on_rows_and_on_presence(spark):
    data = [r for r in rows(4) if r[3] is not None]
    df = spark.createDataFrame(data, "genre string, year int, item string, entity long")
    regions = spark.createDataFrame([(e, "x" if e % 3 else "y") for e in range(100, 400)] + [(0, None)], "entity long, region string")
    want, act = defaultdict(set), defaultdict(set)
    for _, y, item, e in data:
        if e in range(100, 400):
            g = "x" if e % 3 else "y"
            want[item, g, y].add(e)
            act[g, y].add(e)
    out = {}
    for table, active in ((df, df), (P.presence(df, "genre", "year", "item"), P.presence(df, "year"))):
        out[table] = sorted(map(tuple, R.regional_curves(table, active, regions, 2000, 2006, 5).collect()))
        for item, g, y, r, _, n, a, valid in out[table]:
            assert (n, a) == (len(want[item, g, y]), len(act[g, y])) and valid == (a >= 5)
            assert r == pytest.approx(100 * n / a if valid else 0)
    first, second = out.values()
    assert first == second and len(first) % 7 == 0


@pytest.mark.parametrize("name", ["doc_freq", "kwic_windows", "collocates_dirichlet", "genre_year_word"])
def test_the_token_pattern_stands_once_in_a_plan_of_one_text_scan(spark, name):
    text = plan(QUERIES[name](spark, DIR))
    scans = sum("text#" in line for line in text.splitlines() if "FileScan" in line)
    assert 0 < text.count("regexp_extract_all") <= scans


def test_uses_are_combined_before_their_only_shuffle(spark):
    text = plan(QUERIES["presence_totals"](spark, DIR))
    assert "distinct" not in text.lower() and "bit_or" in text


def test_regional_takeoff_scans_few_tables(spark):
    df = QUERIES["regional_takeoff"](spark, DIR)
    assert "Window" not in plan(df)
