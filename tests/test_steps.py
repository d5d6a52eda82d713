"""The steps from shards to documents, over shards made here and counted plainly."""

import json
import random
import re
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wordtide import steps
from wordtide.config import DEFAULT
from wordtide.operators.adoption import pool_rates
from wordtide.operators.corpus import entities
from wordtide.operators.lexicon import lexicon
from wordtide.sources.tables import document, json_rows

CFG = replace(DEFAULT, ingest_years=(1990, 2003), years=(1991, 2002), min_records=3, min_entity_years=2, ratio_from=1991, min_users=1, pool_records=4, name_records=5, top_k=3, gap=2, min_support=1, buckets=4, cohorts=((1992, 2002),))
SCHEMA = "tag string, artist string, title string, year int, lyrics string"


def songs():
    rng = random.Random(5)
    rows = []
    for k in range(600):
        year = rng.randint(1989, 2004)
        tag = rng.choice(["rap", "rap", "pop"])
        words = [rng.choice(["love", "night", "road", "don't"]) for _ in range(8)]
        if tag == "rap" and year >= 1995 and rng.random() < 0.6:
            words.append(f"drip{rng.choice(['', '', 'py'])}")
        if rng.random() < 0.2:
            words += ["word", "up"]
        rows.append((tag, f"Artist {rng.randint(1, 40)}", f"t{k}", year, "[Verse 1] " + " ".join(words).title()))
    return [*rows, ("rap", "Genius", "list", 1995, "drip drip"), ("rap", None, "x", 1995, "drip")]


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("steps")
    rows = songs()
    for i in range(2):
        spark.createDataFrame(rows[i::2], SCHEMA).coalesce(1).write.parquet(str(base / f"raw{i}"))
        [part] = (base / f"raw{i}").glob("part-*.parquet")
        (base / "data").mkdir(exist_ok=True)
        part.rename(base / "data" / f"train-{i:05d}-of-2.parquet")
    shards, to = str(base / "data" / "*.parquet"), str(base / "out")
    steps.build(spark, shards, to, "rap", CFG, account="^Genius")
    return shards, to


def kept():
    return [r for r in songs() if r[1] and r[1] != "Genius" and 1990 <= r[3] <= 2003]


def words(r):
    return set(re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)*", re.sub(r"\[[^\]]*\]", "", r[4]).lower()))


def read(to, name):
    [file] = [f for f in __import__("pathlib").Path(to, name).glob("part-*")]
    return json.loads(file.read_text())


def test_build_counts_as_plainly(spark, out):
    _, to = out
    assert spark.read.parquet(f"{to}/songs").count() == len(kept())
    n, who = defaultdict(int), defaultdict(set)
    for r in kept():
        for w in words(r):
            n[r[0], r[3], w] += 1
            who[r[0], r[3], w].add(r[1])
    total = defaultdict(int)
    for (_, _, w), c in n.items():
        total[w] += c
    got = {(r["genre"], r["year"], r["item"]): (r["records"], r["entities"]) for r in spark.read.parquet(f"{to}/genre_year_item").collect()}
    assert got == {k: (n[k], len(who[k])) for k in n if total[k[2]] >= CFG.min_records}
    names = sorted({r[1] for r in kept()})
    assert {r["name"]: r["entity"] for r in spark.read.parquet(f"{to}/artists").collect()} == {x: i + 1 for i, x in enumerate(names)}


def test_entities_are_numbered_over_ranges(spark):
    names = [f"n{i:03d}é" for i in range(300)] + ["Z", "a", "n001é"]
    got = entities(spark.createDataFrame([(x,) for x in [*names, None]], "artist string"), ranges=8)
    assert {r["name"]: r["entity"] for r in got.collect()} == {x: i + 1 for i, x in enumerate(sorted(set(names), key=str.encode))}
    assert entities(spark.createDataFrame([], "artist string")).count() == 0


def test_terms_are_rolled_up(spark, out):
    shards, to = out
    lex = lexicon(spark, [{"id": "drip", "tokens": ["drip", "drippy"]}, {"id": "wordup", "phrases": ["word up"]}])
    assert steps.match_terms(spark, shards, to, lex, "rap", CFG, account="^Genius").count() == 0
    want = defaultdict(int)
    for r in kept():
        text = re.sub(r"\[[^\]]*\]", "", r[4]).lower()
        for term, hit in (("drip", words(r) & {"drip", "drippy"}), ("wordup", re.search(r"\bword\s+up\b", text))):
            want[r[0], r[3], term] += bool(hit)
    got = {(r["genre"], r["year"], r["item"]): r["records"] for r in spark.read.parquet(f"{to}/term_genre_year").collect()}
    assert got == {k: c for k, c in want.items() if c}


def test_summary_and_documents(spark, out):
    shards, to = out
    summary = steps.discover(spark, to, "rap", ["pop"], spark.createDataFrame([("love",)], "word string"), CFG)
    rows = {r["word"]: r for r in summary.collect()}
    assert "drip" in rows and "love" not in rows and rows["drip"]["log_ratio"] > 1 and not rows["drip"]["in_dictionary"]
    steps.turnover(spark, to, "rap", churn_from=1992, cfg=CFG)
    got = read(to, "turnover.json")
    peaks = [w["peak"] for w in got["words"]]
    assert peaks == sorted(peaks, reverse=True) and [w["rank"] for w in got["words"]] == list(range(1, len(peaks) + 1))
    many = defaultdict(int)
    for r in kept():
        many[r[1]] += r[0] == "rap"
    assert got["pool"] == [{"entities": sum(c >= 4 for c in many.values())}] and {c["year"] for c in got["churn"]} == set(range(1992, 2001))
    lex = lexicon(spark, [{"id": "drip", "tokens": ["drip", "drippy"]}])
    steps.match_terms(spark, shards, to, lex, "rap", CFG, account="^Genius")
    mapped = spark.read.parquet(f"{to}/artists").select("entity", F.when(F.col("entity") % 2 == 0, "East").otherwise("West").alias("region"))
    eras = [("a", 1991, 1996), ("b", 1997, 2002)]
    steps.regions(spark, to, "rap", mapped, eras, lex, ["East", "West"], ["drip"], spark.createDataFrame([("Long Road, X",)], "place string"), valid_from=1, cfg=CFG)
    assert {(x["era"], x["region"]) for x in read(to, "regions.json")["active"]} == {(e, r) for e in "ab" for r in ("East", "West")}
    forms = spark.createDataFrame([("drip", "drip"), ("drip", "drippy")], "target string, form string")
    steps.meaning(spark, shards, to, "rap", forms, [("drip", "road", r"\broad\b")], eras, least=1, cfg=CFG, account="^Genius")
    got = read(to, "meaning.json")
    in_era = [r for r in kept() if r[0] == "rap" and 1991 <= r[3] <= 2002 and words(r) & {"drip", "drippy"}]
    assert sum(x["n"] for x in got["occurrences"]) == len(in_era) == sum(x["n"] for x in got["by_era"]) == sum(x["n"] for x in got["by_year"])
    assert {x["item"] for x in got["collocates"]} <= {"love", "night", "road", "don't", "word", "up"}
    steps.meta(spark, to, "rap", 1, CFG)
    got = read(to, "meta.json")
    assert got["headline"][0]["focal_records"] == sum(r[0] == "rap" for r in kept())
    assert sum(t["records"] for t in got["totals"]) == sum(1991 <= r[3] <= 2002 for r in kept())


def test_tables_by_item_join_without_an_exchange(spark, out):
    _, to = out
    steps.discover(spark, to, "rap", ["pop"], None, CFG)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [steps._laid(spark, to, name, CFG, "rap", (1995, 1999)) for name in ("genre_year_item", "entity_year_item", "curve")]
        a, b, c = (t.groupBy("item").agg(F.count("*").alias(x)) for t, x in zip(tables, "abc", strict=True))
        df = tables[0].join(a.where("a > 1"), "item", "left_semi").groupBy("item").agg(F.sum("records")).join(b, "item").join(c, "item")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SelectedBucketsCount: 4 out of 4") == 4
        assert plan.count("PartitionFilters: [isnotnull(genre") == 4 and df.count() > 0
        files = steps._laid(spark, to, "genre_year_item", CFG, "rap", (1991, 1999)).inputFiles()
        assert files and all("genre=rap/decade=1990" in f for f in files)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_laid_table_is_known_in_another_session(spark, out):
    _, to = out
    name = steps.open_laid(spark, f"{to}/presence", "item")
    other = spark.newSession()
    other.sql("DROP TABLE IF EXISTS " + __import__("wordtide.sources.tables", fromlist=["_"])._laid_name(f"{to}/presence"))  # external: files stay
    again = steps.open_laid(other, f"{to}/presence", "item")
    assert again.count() == name.count() > 0 and sorted(again.columns) == sorted(name.columns)


def test_windows_come_from_the_index(spark, out):
    shards, to = out
    forms = spark.createDataFrame([("drip", "drip"), ("drip", "drippy"), ("road", "road"), ("none", "unheard")], "target string, form string")
    rules, eras = [("drip", "road", r"\broad\b")], [("a", 1991, 1996), ("b", 1995, 2002)]
    steps.meaning(spark, shards, to, "rap", forms, rules, eras, least=1, cfg=CFG, account="^Genius")
    want, rows = read(to, "meaning.json"), sorted(map(str, spark.read.parquet(f"{to}/occurrences").collect()))
    steps.meaning(spark, None, to, "rap", forms, rules, eras, least=1, cfg=CFG)
    assert read(to, "meaning.json") == want
    assert sorted(map(str, spark.read.parquet(f"{to}/occurrences").collect())) == rows
    posted, toks = steps._laid(spark, to, "postings", CFG, "rap", CFG.years), steps._laid(spark, to, "tokens", CFG, "rap", CFG.years, "record")
    one = forms.where("form = 'road'")
    for few in (10_000, 0):
        df = steps.B.kwic(posted, toks, one, few=few)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "regexp" not in plan and plan.count("Exchange hashpartitioning(record") == 1  # the places travel, the words stay
        assert df.count() == sum(r[4].lower().split().count("road") for r in kept() if r[0] == "rap" and r[3] in range(1991, 2003))
    rare = steps.B.kwic(posted.where("pos = 8 and year = 1996"), toks, forms)  # few records: their numbers go into the plan
    assert re.search(r"Filter .*record#\d+L IN", rare._jdf.queryExecution().executedPlan().toString()) and rare.count() > 0


def test_profiles_hold_every_part(spark, out):
    shards, to = out
    lex = lexicon(spark, [{"id": "drip", "label": "Drip", "cat": "c", "gloss": "g", "tokens": ["drip", "drippy"], "region": "East"}, {"id": "wordup", "phrases": ["word up"], "poly": True}, {"id": "never", "tokens": ["unheard"]}])
    steps.match_terms(spark, shards, to, lex, "rap", CFG, account="^Genius")
    artists = spark.read.parquet(f"{to}/artists")
    known = artists.select("entity", (F.col("entity") % 3).cast("long").alias("sitelinks"), F.lit("Q").alias("base_id"), F.when(F.col("entity") % 2 == 0, "East").otherwise("West").alias("region"), F.lit(None).cast("string").alias("scene"))
    steps.profiles(spark, to, lex, "rap", ["pop"], known, cfg=CFG)
    got = {r["id"]: r for r in (json.loads(x[0]) for x in spark.read.text(f"{to}/terms.json").collect())}
    assert set(got) == {"drip", "wordup"}
    years = range(1991, 2003)
    ids = {r["name"]: r["entity"] for r in artists.collect()}
    rap = [r for r in kept() if r[0] == "rap"]
    for item, hit in (("drip", lambda r: words(r) & {"drip", "drippy"}), ("wordup", lambda r: "word up" in re.sub(r"\[[^\]]*\]", "", r[4]).lower())):
        x, n = got[item], {y: len({r[1] for r in rap if r[3] == y and hit(r)}) for y in years}
        assert x["focal_n"] == [n[y] for y in years]
        raw = [100 * n[y] / len({r[1] for r in rap if r[3] == y}) for y in years]
        smooth = [sum(raw[max(i - 1, 0) : i + 2]) / len(raw[max(i - 1, 0) : i + 2]) for i in range(len(raw))]
        assert x["focal_raw"] == pytest.approx(raw, abs=6e-4) and x["focal"] == pytest.approx(smooth, abs=6e-4)
        assert x["life"]["peak"] == max(x["focal"]) and x["life"]["peak_year"] == 1991 + smooth.index(max(smooth))
        assert set(x["genres"]) == {"pop"} and len(x["genres"]["pop"]) == len(years) and x["cross"]["pop"]["peak"] == max(x["genres"]["pop"])
        dated = {r[1]: sorted(s[3] for s in rap if s[1] == r[1]) for r in rap}
        p10 = {a: v[int(h)] + (h - int(h)) * (v[min(int(h) + 1, len(v) - 1)] - v[int(h)]) for a, v in dated.items() for h in [0.1 * (len(v) - 1)]}
        used = [r for r in rap if hit(r) and r[3] in years and r[3] >= p10[r[1]] - 3]
        assert x["life"]["total_entities"] == len({r[1] for r in used})
        by = {y: len({r[1] for r in used if r[3] == y}) for y in years}
        assert x["people"]["first_seen"] == min([y for y in years if by[y] >= 2], default=min(y for y in years if by[y]))
        some = {a for a, e in ids.items() if e % 3 > 0}  # notable
        assert {p["artist"] for k in ("early", "popularizers", "signature") for p in x["people"][k]} <= some
        many = sorted(((-sum(r[1] == a for r in used), ids[a]) for a in some if sum(r[1] == a for r in used) >= 5))[:5]
        assert [(-p["songs"], ids[p["artist"]]) for p in x["people"]["signature"]] == many
        for region, odd in (("East", 0), ("West", 1)):
            own = {a for a, e in ids.items() if e % 2 == odd}
            part = x["regions"][region]
            assert part["entity_years"] == sum(len({r[1] for r in rap if r[3] == y} & own) for y in years)
            assert part["ever"] == pytest.approx(100 * len({r[1] for r in used} & own) / len({r[1] for r in rap} & own), abs=6e-3) and len(part["curve"]) == len(years)
    assert got["drip"]["region_hint"] == "East" and got["wordup"]["poly"] and got["drip"]["label"] == "Drip"
    steps.profiles(spark, to, lex, "rap", ["pop"], None, cfg=CFG)
    bare = [json.loads(r[0]) for r in spark.read.text(f"{to}/terms.json").collect()]
    assert all(r["regions"] is None and r["people"]["signature"] == [] for r in bare) and len(bare) == 2


def test_totals_are_dense(spark, out):
    _, to = out
    steps.meta(spark, to, "rap", 1, replace(CFG, years=(1985, 2002)))
    got = read(to, "meta.json")["totals"]
    assert len(got) == 2 * 18 and {t["records"] for t in got if t["year"] < 1989} == {0}


def test_pool_rates_leave_others_out(spark):
    used = spark.createDataFrame([(1, 2000, "x", 2), (2, 2000, "x", 1), (3, 2000, "x", 1), (3, 2000, "y", 1)], "entity int, year int, item string, records int")
    active = spark.createDataFrame([("g", e, 2000) for e in (1, 1, 2, 3, 4)] + [("h", 1, 2000)], "genre string, entity int, year int")
    pool = spark.createDataFrame([(1,), (2,), (4,)], "entity int")
    got = {r["item"]: (r["records"], r["entities"], r["entities_tot"]) for r in pool_rates(used, active, pool, "g").collect()}
    assert got == {"x": (3, 2, 3)}


def test_documents_refuse_nan_at_any_depth(spark):
    fine = spark.createDataFrame([(2, None), (1, 0.5)], "a int, b double")
    assert json.loads(document(rows=fine, none=fine.limit(0)).first()[0]) == {"rows": [{"a": 1, "b": 0.5}, {"a": 2, "b": None}], "none": []}
    nan = F.lit(float("nan"))
    for bad in (F.struct(nan.alias("x")), F.create_map(F.lit("k"), F.array(nan)), F.array(F.struct(nan.alias("x"))), nan):
        with pytest.raises(Exception, match="NaN"):
            json_rows(fine.select(bad.alias("v"))).collect()
