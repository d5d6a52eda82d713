"""Readers, writers, fetchers, streaming, places."""

import json

import pytest
from pyspark.sql import functions as F

from wordtide.plans.places import PLACES, tables
from wordtide.operators import geo as G
from wordtide.sources import tables as T
from wordtide.sources.fetch import Cache, Fetcher, lucene_escape, search_url
from wordtide.streaming.adoption import read_events, run_to_end, streaming_adoption


def test_words_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([("nan", 1.5), ("null", None), ("NaN", 2.0)], "word string, x double")
    T.write_top_csv(df, str(tmp_path / "c"), [F.asc("word")], 300)
    assert sorted(map(str, (tuple(r) for r in T.read_csv(spark, str(tmp_path / "c"), "word string, x double").collect()))) == ["('NaN', 2.0)", "('nan', 1.5)", "('null', None)"]


def test_json_rejects_nan(spark, tmp_path):
    T.write_json(spark.createDataFrame([(1.0, [2.0])], "a double, b array<double>"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1.0,"b":[2.0]}'
    for bad in ((float("nan"), [1.0]), (1.0, [float("inf")])):
        with pytest.raises(Exception, match="NaN"):
            T.json_rows(spark.createDataFrame([bad], "a double, b array<double>")).collect()


def test_optional_tables_and_shards(spark, tmp_path):
    base = spark.createDataFrame([(1,), (2,)], "entity int")
    schema = "entity int, sitelinks long"
    assert T.try_read(spark, str(tmp_path / "none"), schema) is None
    assert [r["sitelinks"] for r in T.or_nulls(base, None, "entity", schema).collect()] == [None, None]
    T.write_parquet(spark.createDataFrame([(1, 9)], schema), str(tmp_path / "t"))
    assert {r["entity"]: r["sitelinks"] for r in T.or_nulls(base, T.try_read(spark, str(tmp_path / "t"), schema), "entity", schema).collect()} == {1: 9, 2: None}
    spark.createDataFrame([("g", "A", "t", 2000, "la")], T.SHARDS).coalesce(1).write.parquet(str(tmp_path / "s" / "train-0007-x.parquet"))
    got = T.with_provenance(T.read_shards(spark, str(tmp_path / "s" / "train-*.parquet"))).first()
    assert got["record"] == 7_000_000
    (tmp_path / "words").write_text("Alpha \n\nbeta\nALPHA\n")
    assert sorted(r[0] for r in T.read_words(spark, str(tmp_path / "words")).collect()) == ["alpha", "beta"]
    (tmp_path / "lex.json").write_text(json.dumps([{"id": "a", "label": "A", "tokens": ["x"], "phrases": [], "poly": True}]))
    assert T.read_lexicon(spark, str(tmp_path / "lex.json")).first()["tokens"] == ["x"]


def fetcher(tmp_path, answers, **options):
    calls, naps = [], []

    def transport(url, body, headers):
        calls.append(body.decode() if body else url)
        return answers(calls)

    return Fetcher(Cache(tmp_path), transport, sleep=naps.append, clock=lambda: 0.0, **options), calls, naps


def test_sparql_rows_retries_and_cache(tmp_path):
    data = json.dumps({"results": {"bindings": [{"item": {"type": "uri", "value": "http://kb/entity/Q1"}, "l": {"type": "literal", "value": "L", "xml:lang": "en"}}]}})
    f, calls, naps = fetcher(tmp_path, lambda c: (429, "", {"Retry-After": "7"}) if len(c) == 1 else (200, data, {}))
    want = [{"item": "Q1", "l": "L", "l_lang": "en"}]
    assert f.sparql("http://kb/sparql", "q", "t", "http://kb/") == want and naps == [7.0] and len(calls) == 2
    assert f.sparql("http://kb/sparql", "q", "t", "http://kb/") == want and len(calls) == 2
    [file] = (tmp_path / "sparql").iterdir()
    file.write_text("{broken")
    assert f.sparql("http://kb/sparql", "q", "t", "http://kb/") == want and len(calls) == 3


def test_batches_are_halved(tmp_path):
    empty = json.dumps({"results": {"bindings": []}})
    f, calls, _ = fetcher(tmp_path, lambda c: (400, "", {}) if "Q13" in c[-1].replace("+", " ").split() or "Q13" in c[-1].split("wd%3A")[-1] or "wd%3AQ13+" in c[-1] else (200, empty, {}))
    rows, lost = f.sparql_in_batches("http://kb", "{values} ", [f"Q{i}" for i in range(40)], "t", size=40, least=5)
    assert rows == [] and "Q13" in lost and len(lost) <= 5


def test_missing_pages_lag_and_cached_only(tmp_path):
    f, calls, naps = fetcher(tmp_path, lambda c: (404, "", {}), gap=1.1)
    assert f.fetch("mb", "u", "u") == {"_status": 404} and f.fetch("mb", "u", "u") == {"_status": 404} and len(calls) == 1
    f.fetch("mb", "v", "v")
    assert naps == [1.1]
    f.cached_only = True
    assert f.fetch("mb", "w", "w") is None and len(calls) == 2
    g, calls, naps = fetcher(tmp_path, lambda c: (200, '{"error": "maxlag"}' if len(c) == 1 else '{"ok": 1}', {}))
    assert g.wiki("http://w/api", {"a": "b"}, "t") == {"ok": 1} and naps == [5.0]
    assert lucene_escape("a/b&&c") == r"a\/b\&&c" and search_url("b", "x y").endswith("artist:%22x%20y%22&fmt=json&limit=5")


def climb(place, rows, seen=()):
    """The resolver's rule as a plain recursion along each way."""
    label, lat, lon, codes, own, parents = rows[place]
    code = next((c for c in codes if len(c) > 3 and c[2] == "-"), None)
    named = {c for r in rows.values() for c in r[4]}
    is_country = place in named and (not own or place in own)
    best = None
    for p in parents:
        if p in (*seen, place) or p in own or p not in rows:
            continue
        r = climb(p, rows, (*seen, place))
        if best is None or (r["state"] and not best["state"]) or (r["country"] == "US" and r["state"] and best["country"] != "US"):
            best = r
    state = best["state"] if best else None
    if state is None and code and not is_country:
        state = code[3:] if code.startswith("US-") else label
    country = place if is_country else "US" if "US" in own else own[0] if own else best["country"] if best else None
    hidden = is_country or (code and not (best and best["state"]) and code != "US-DC")
    at = None if hidden else (lat, lon) if lat is not None else best["at"] if best and best["usable"] else None
    if country == "US" and state and len(state) != 2:
        state = None
    return {"state": state, "country": country, "at": at, "usable": not code and not is_country and at is not None}


def test_places_resolve_as_the_recursion_does(spark):
    rows = {p: rest for p, *rest in PLACES}
    got = {r["place"]: (r["state"], r["country"], (r["lat"], r["lon"]) if r["lat"] is not None else None) for r in G.resolve(*tables(spark)).collect()}
    want = {p: (x["state"], x["country"], x["at"]) for p in rows for x in [climb(p, rows)]}
    assert got == want
    assert got["q2"][0] == "PA" and got["t1"][:2] == ("NJ", "US")  # a loop ends; a city takes its state


def test_regions_and_optional_scenes(spark):
    res = G.resolve(*tables(spark))
    states = spark.createDataFrame([("NJ", "East"), ("PA", "East")], "state string, region string")
    got = {r["place"]: r["region"] for r in G.region(res, states, {"GB": "UK"}).collect()}
    assert got["t1"] == "East" and got["e2"] == "UK" and got["k1"] == "Other" and got["o1"] is None and got["l1"] is None
    assigned = spark.createDataFrame([("a",)] * 3 + [("b",)], "scene string")
    assert [r[0] for r in G.kept_scenes(assigned, ["a", "b"], 2).collect()] == ["a"]


def test_stream_drains_closed_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = run_to_end(streaming_adoption(read_events(spark, "/root/testdata/sf0.001/events.parque[t]")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert 0 < got.count() and got.agg(F.sum("events")).first()[0] <= src.count()
    day = got.orderBy("start", "genre").first()
    exact = src.where((F.col("event_type") == day["genre"]) & (F.to_date("ts") == F.to_date(F.lit(day["start"]))))
    assert exact.count() == day["events"] and abs(exact.select("user_id").distinct().count() - day["entities"]) <= 2
