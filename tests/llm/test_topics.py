"""Topics and the whole of mixing against brute force over plain lists."""

import random

import numpy as np
import pytest

from wordtide.llm import topics as T
from wordtide.llm.mixing import _drawn, keep_mixed, mix
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, _mix_s int, topic string, weight int"
THEMES = {"x": [["apple", "pear", "plum", "fig"], ["bolt", "screw", "nail", "gear"]], "y": [["apfel", "birne", "feige"], ["mutter", "nagel", "rad"]]}


def rows_of(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice("xy")
        theme = THEMES[lang][r.random() < 0.3]
        text = " ".join(r.choice(theme + ["the", "of"]) + r.choice(["", "s", "er"]) for _ in range(r.randint(1, 60)))
        rows.append((i * 3 + 1, text, lang if r.random() < 0.9 else None, r.choice(["a", "a", "b", None]), 1, "q", 1))
    return rows + [(5, None, "x", "a", 1, "q", 1), (8, "12 !", None, None, 1, "q", 1), (4, "apple pear", "x", "b", 1, "q", 1)]


def brute_topics(rows, hashes):
    """Lloyd's rounds over lists; hashes: of ids, for the first centroids."""
    v = [T.term_vectors([t or ""])[0].astype(int) for _, t, *_ in rows]
    langs = [x[2] for x in rows]
    mean = {}
    for k in set(langs):
        own = [v[i] for i in range(len(rows)) if langs[i] == k and v[i].any()]
        mean[k] = np.rint(sum(own) / len(own)) if own else 0 * v[0]
    w = [v[i] - mean[langs[i]] for i in range(len(rows))]
    some = [i for i in range(len(rows)) if v[i].any()]
    first = sorted(some, key=lambda i: (hashes[rows[i][0]], langs[i] is not None, langs[i] or "", v[i].astype("<i2").tobytes()))[: T.TOPICS]
    cent = [w[i].astype(float) for i in first]
    near = lambda i: int(np.argmax([round(float(w[i] @ (c / max(1e-9, np.linalg.norm(c)))), 6) for c in cent]))
    for _ in range(T.ROUNDS):
        of = {i: near(i) for i in some}
        new = [sum(w[i] for i in some if of[i] == k) / sum(of[i] == k for i in some) if k in of.values() else cent[k] for k in range(len(cent))]
        if all((a == b).all() for a, b in zip(new, cent)):
            break
        cent = new
    return [f"t{near(i)}" if v[i].any() else "none" for i in range(len(rows))]


def brute_mix(rows, topics, keep):
    """Probability of every row: each category's factor in turn, found by halving, such that the capped cells of the category keep its goal."""
    n = [len((t or "").split()) for _, t, *_ in rows]
    keys = [(r[3], r[2], t) for r, t in zip(rows, topics)]
    tokens = {}
    for k, x in zip(keys, n):
        tokens[k] = tokens.get(k, 0) + x
    tokens = {k: x for k, x in tokens.items() if x}
    total = sum(tokens.values())
    goals = []
    for a, power in enumerate((0.5, 0.7, 0.7)):
        share = {}
        for k, x in tokens.items():
            share[k[a]] = share.get(k[a], 0) + x / total
        low, high = 0.0, 1e6  # no category is asked for more than it has
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(x / keep, mid * x**power) for x in share.values()) < 1 else (low, mid)
        goals.append({c: total * min(x, keep * high * x**power) for c, x in share.items()})
    w = {k: keep for k in tokens}
    for _ in range(200):
        for a in range(3):
            for c, goal in goals[a].items():
                low, high = 0.0, 1e6
                for _ in range(70):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(tokens[k] * min(1, mid * w[k]) for k in w if k[a] == c) < goal else (low, mid)
                w = {k: x * high if k[a] == c else x for k, x in w.items()}
    return [min(1.0, w[k]) if k in w else 0.0 for k in keys]


def test_mix_is_brute_force(spark):
    rows = rows_of(1, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    side = {r["doc_id"]: (r["h"], r["u"]) for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("h"), _drawn(F.col("doc_id"), 7).alias("u")).collect()}
    topics = brute_topics(rows, {k: h for k, (h, _) in side.items()})
    want = brute_mix(rows, topics, 0.3)
    got = {(r["doc_id"], r["source"], r["lang"]): r for r in mix(df.repartition(3), keep=0.3, topics="terms").collect()}
    assert len(got) == len(rows)
    for r, t, p in zip(rows, topics, want, strict=True):
        x = got[r[0], r[3], r[2]]
        assert x["topic"] == t and x["probability"] == pytest.approx(p, abs=2e-3) and x["n_tokens"] == len((r[1] or "").split())
        assert x["kept"] == (side[r[0]][1] < x["probability"])
    assert len(set(topics)) > 3 and any(p > 1 - 1e-6 for p in want)  # the bound binds
    kept = keep_mixed(df.repartition(2), keep=0.3, topics="terms")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k[0] for k, x in got.items() if x["kept"])


def test_topics_do_not_depend_on_partitions_and_cover_odd_tables(spark):
    rows = rows_of(2, 80)
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    a, b = (sorted((r["doc_id"], r["topic"], r["probability"]) for r in mix(df.repartition(k), topics="terms").collect()) for k in (1, 5))
    assert a == b and len(a) == len(rows) + 5
    assert mix(df.limit(0), topics="terms").count() == 0 and keep_mixed(df.limit(0), topics="terms").count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 1, "q", 1), (None, " ", "x", "a", 1, "q", 1)], SCHEMA)
    assert {(r["topic"], r["kept"]) for r in mix(blank, topics="terms").collect()} == {("none", False)}
    long = spark.createDataFrame([(1, "pear apple " * 300_000, "x", "a", 1, "q", 1), (2, "bolt", "x", "a", 1, "q", 1)], SCHEMA)
    assert {r["n_tokens"] for r in mix(long, topics="terms").collect()} == {600_000, 1}


BINDING = {"lang": {"en": 0.1, "de": 0.6, "fr": 0.2, "es": 0.1}}


def shares(rows, axis):
    out = {}
    for r in rows:
        out[r[axis]] = out.get(r[axis], 0) + r["n_tokens"] * r["probability"]
    return {k: v / sum(out.values()) for k, v in out.items()}


def spread(spark, r, n=600):
    langs = ["en"] * 6 + ["de", "de", "fr", "es"]
    rows = [(i, " ".join("w" * r.randint(1, 40)), r.choice(langs), r.choice("aab"), 1, "q", 1) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("cells", [100_000, 0])
def test_targets_hold_where_probabilities_reach_one(spark, monkeypatch, cells):
    from wordtide.llm import mixing

    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    df = spread(spark, random.Random(5)).coalesce(2)
    with pytest.warns(UserWarning, match="can't be met at keep=0.5"):
        got = mix(df, targets=BINDING, keep=0.5).collect()
    assert shares(got, "lang") == pytest.approx(BINDING["lang"], abs=1e-5)
    total = sum(r["n_tokens"] for r in got)
    have = sum(r["n_tokens"] for r in got if r["lang"] == "de") / total
    kept = sum(r["n_tokens"] * r["probability"] for r in got) / total
    assert kept == pytest.approx(got[0]["keep"], rel=1e-5) and max(r["probability"] for r in got) <= 1
    assert 0.9 * have / 0.6 < kept <= have / 0.6 + 1e-6  # German is nearly used up


def test_part_of_the_cells_capped_keeps_the_share_asked_for(spark):
    df = spread(spark, random.Random(6))
    got = mix(df, targets={"lang": {"en": 0.5, "de": 0.27, "fr": 0.13, "es": 0.1}}, keep=0.6).collect()
    assert shares(got, "lang") == pytest.approx({"en": 0.5, "de": 0.27, "fr": 0.13, "es": 0.1}, abs=1e-5)
    assert got[0]["keep"] == 0.6 and any(r["probability"] == 1 for r in got)


def test_targets_that_contradict_each_other_are_warned_of(spark):
    rows = [(i, "a b c", "xy"[i % 2], "ab"[i % 2], 1, "q", 1) for i in range(20)]  # x only in a, y only in b
    with pytest.warns(UserWarning, match="contradict"):
        got = mix(spark.createDataFrame(rows, SCHEMA), targets={"lang": {"x": 0.9, "y": 0.1}, "source": {"a": 0.2, "b": 0.8}}, keep=0.4).collect()
    assert len(got) == 20
    none = mix(spark.createDataFrame(rows, SCHEMA), targets={"lang": {"z": 1.0}}).collect()
    assert not any(r["kept"] for r in none)
