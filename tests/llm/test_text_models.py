"""Language identification on held-out documents, mixing against its targets, the pipeline against its parts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordtide.llm.language_id import identify, keep_identified
from wordtide.llm.mixing import cell_weights, keep_mixed, mix, largest_share, rake, rake_table, topic_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, weight int"
SYLLABLES = {"xx": ["ka", "to", "ri", "mu", "sen"], "yy": ["sch", "ung", "ver", "ge", "ö"], "zz": ["eau", "ment", "oi", "ç", "re"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def docs(spark, seed=1, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, prose(r, lang, r.randint(3, 80)), lang if r.random() < 0.9 else None, r.choice(["a", "a", "b", None]), 1, 0.0, 1))
    return spark.createDataFrame(rows, SCHEMA), rows


def test_held_out_accuracy_and_mixtures(spark):
    df, rows = docs(spark)
    r = random.Random(5)
    mixed = prose(r, "xx", 60) + " " + prose(r, "zz", 30)
    extra = [(1000, mixed, None, "a", 1, 0.0, 1), (1001, None, "xx", "a", 1, 0.0, 1), (1002, "12 34 !!", "xx", "a", 1, 0.0, 1), (1003, "", "yy", "a", 1, 0.0, 1), (None, "katori", None, "a", 1, 0.0, 1), (1004, "ka " * 200_000, None, "a", 1, 0.0, 1)]
    got = {x["doc_id"]: x for x in identify(df.unionByName(spark.createDataFrame(extra, SCHEMA)).repartition(3)).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert all(got[x[0]]["held_out"] == (x in held) for x in rows)
    right = np.mean([got[x[0]]["lang_pred"] == x[2] for x in held if x[2]])
    assert right > 0.97
    m = got[1000]
    assert m["lang_pred"] == "xx" and [p["lang"] for p in m["languages"]] == ["xx", "zz"] and abs(m["score"] - 2 / 3) < 0.1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1001, 1002, 1003))
    assert got[None]["lang_pred"] == "xx" and got[1004]["lang_pred"] == "xx" and not got[None]["held_out"]
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_labels_are_no_input_of_predictions(spark):
    df, _ = docs(spark, n=120)
    held = "pmod(crc32(cast(doc_id as string)), 5) = 0"
    changed = df.withColumn("lang", F.expr(f"case when {held} then 'qq' else lang end")).withColumn("source", F.lit("other"))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(x).collect()} for x in (df, changed))
    assert a == b


def test_no_labels_and_no_rows(spark):
    df, _ = docs(spark, n=10)
    assert {r["lang_pred"] for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0


def test_keep_identified(spark):
    df, _ = docs(spark, n=60)
    more = df.unionByName(spark.createDataFrame([(900, None, "xx", "a", 1, 0.0, 1), (901, "?!", "xx", "a", 1, 0.0, 1)], SCHEMA))
    kept = keep_identified(more)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(60))


def brute_rake(cells, targets, sweeps=500):
    w = {k: v / sum(cells.values()) for k, v in cells.items()}
    for _ in range(sweeps):
        for a in range(3):
            for c, want in targets[a].items():
                have = sum(v for k, v in w.items() if k[a] == c)
                w = {k: v * want / have if k[a] == c and have else v for k, v in w.items()}
    return w


def test_raking_meets_targets(spark):
    r = random.Random(2)
    cells = {(s, x, t): r.randint(1, 1000) for s in "abc" for x in "de" for t in "fgh"}
    targets = [{"a": 0.2, "b": 0.5, "c": 0.3}, {"d": 0.9, "e": 0.1}, {"f": 0.4, "g": 0.4, "h": 0.2}]
    keys = sorted(cells)
    members = [np.array([sorted(targets[a]).index(k[a]) for k in keys]) for a in range(3)]
    share = np.array([cells[k] for k in keys], float) / sum(cells.values())
    w, worst = rake(share, members, [np.array([targets[a][c] for c in sorted(targets[a])]) for a in range(3)])
    got, want = share * w, brute_rake(cells, targets)
    assert worst < 1e-9
    assert got == pytest.approx([want[k] for k in keys], rel=1e-6)
    table = spark.createDataFrame([(*k, v / sum(cells.values()), 1.0) for k, v in cells.items()], "source string, lang string, topic string, tokens double, w double")
    goals = {a: spark.createDataFrame(list(t.items()), f"{a} string, want double") for a, t in zip(["source", "lang", "topic"], targets, strict=True)}
    far = {(x["source"], x["lang"], x["topic"]): x["tokens"] * x["w"] for x in rake_table(table, ["source", "lang", "topic"], goals, 1.0, sweeps=12)[0].collect()}
    assert [far[k] for k in keys] == pytest.approx([want[k] for k in keys], rel=1e-3)


def test_bounded_raking_meets_marginals_and_bound():
    r = np.random.default_rng(4)
    for _ in range(20):
        members = [r.integers(0, k, 60) for k in (3, 4, 5)]
        tokens, some = r.random(60) + 0.01, r.random(60) ** 3
        some[:9] = 1.0  # cells that are kept whole
        goals = [np.bincount(of, weights=tokens * some, minlength=k) for of, k in zip(members, (3, 4, 5))]
        w, worst = rake(tokens, members, goals, 1.0, np.full(60, 0.5), sweeps=5000)
        assert worst < 1e-6
        for of, goal in zip(members, goals):
            assert np.bincount(of, weights=tokens * np.minimum(1, w), minlength=len(goal)) == pytest.approx(goal, abs=1e-5)


def test_largest_share_is_halved_to():
    dropped = []
    share, got = largest_share(lambda k: (k, 0.0 if k <= 0.3 else 1.0), 0.9, 0.1, dropped.append)
    assert 0.29 < share <= 0.3 and got == share and got not in dropped
    assert largest_share(lambda k: (k, 0.0), 0.9, 0.1) == (0.9, 0.9)


def test_mix_is_whole_and_follows_probabilities(spark):
    df, rows = docs(spark, n=1500)
    got = mix(df.repartition(4), keep=0.6).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_tokens"] == len(t.split()) for i, t, *_ in rows)
    expected = sum(r["n_tokens"] * r["probability"] for r in got)
    assert expected == pytest.approx(0.6 * sum(r["n_tokens"] for r in got), rel=1e-6)
    assert abs(sum(r["kept"] for r in got) - sum(r["probability"] for r in got)) < 4 * np.sqrt(1500 / 4)
    weighted = {}
    for r in got:
        weighted[r["source"]] = weighted.get(r["source"], 0) + r["n_tokens"] * r["weight"]
    shares = {k: v / sum(weighted.values()) for k, v in weighted.items()}
    raw = {}
    for r in got:
        raw[r["source"]] = raw.get(r["source"], 0) + r["n_tokens"]
    root = {k: (v / sum(raw.values())) ** 0.5 for k, v in raw.items()}
    assert shares == pytest.approx({k: v / sum(root.values()) for k, v in root.items()}, rel=1e-6)
    kept = keep_mixed(df, keep=0.6)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_mix_of_blank_and_empty_tables(spark):
    blank = spark.createDataFrame([(1, None, None, None, 0, 0.0, 1), (2, " ", "xx", "a", 0, 0.0, 1)], SCHEMA)
    assert [(r["n_tokens"], r["kept"]) for r in mix(blank).collect()] == [(0, False)] * 2
    assert mix(blank.limit(0)).count() == 0 and keep_mixed(blank.limit(0)).count() == 0
    one = blank.unionByName(spark.createDataFrame([(3, "a b", "xx", "a", 0, 0.0, 1)], SCHEMA))
    assert mix(one, keep=1.0, targets={"source": {"a": 1.0, "missing": 3.0}}).where("kept").count() >= 1
    assert cell_weights(blank, F.col("source"), F.col("lang"), F.col("text")) is None


def test_topics(spark):
    texts = ["| a | b |", "write to a@b.org", "The LICENSE", "prose", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(topic_of(F.col("t"))).collect()] == ["tabular", "contact", "license", "prose", "prose"]


def test_pipeline_is_its_stages(spark, tmp_path):
    r = random.Random(11)
    df, rows = docs(spark, seed=4, n=150)
    copies = [(500 + i, rows[i][1] if i % 2 else (rows[i][1] + " ka"), rows[i][2], rows[i][3], 1, 0.0, 1) for i in range(40)]
    junk = [(900, None, "xx", "a", 1, 0.0, 1), (901, "123 456", None, "b", 1, 0.0, 1), (902, prose(r, "xx", 3000), "xx", "b", 1, 0.0, 1)]
    df.unionByName(spark.createDataFrame(copies + junk, SCHEMA)).drop("score", "weight").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "x int")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "mixing", "packing"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert nxt.columns == at.columns
        nxt.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    ids = lambda name: {x["doc_id"] for x in spark.read.parquet(str(tmp_path / name)).select("doc_id").collect()}
    assert ids("documents.parquet") - ids("language_id") == {900, 901}
    from .test_join import brute

    kept = [(x["doc_id"], x["text"]) for x in spark.read.parquet(str(tmp_path / "language_id")).collect()]
    assert ids("ngram_jaccard") == {d for d, (_, c, _) in brute(kept, 5, 80, 100).items() if c == d}
    assert ids("mixing") < ids("ngram_jaccard") and ids("packing") == ids("mixing")
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, at.select("doc_id", "start", "length", "ids_crc32").collect()))


def invented(seed, n):
    """n languages of their own syllables."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñøåþ"
    return {f"l{k:03d}": ["".join(r.choice(letters) for _ in range(r.randint(2, 4))) for _ in range(12)] for k in range(n)}


def speech(r, syllables, n):
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_every_label_is_learnt(spark):
    r, langs = random.Random(3), invented(1, 520)
    rows = [(i, speech(r, s, 60), k) for i, (k, s) in enumerate((k, s) for k, s in langs.items() for _ in range(3))]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    learnt = {x[2] for x in rows if zlib.crc32(str(x[0]).encode()) % 5}
    assert len(learnt) > 512
    right = [x["lang_pred"] == rows[x["doc_id"]][2] for x in got if rows[x["doc_id"]][2] in learnt]
    assert np.mean(right) > 0.97


def test_as_many_languages_as_a_text_has(spark):
    r, langs = random.Random(4), invented(2, 9)
    rows = [(i, speech(r, s, 80), k) for i, (k, s) in enumerate((k, s) for k, s in langs.items() for _ in range(20))]
    many = list(langs)[:7]
    rows.append((10_000, " ".join(speech(r, langs[k], 100 - 5 * i) for i, k in enumerate(many)), None))
    got = {x["doc_id"]: x for x in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    found = got[10_000]["languages"]
    assert [x["lang"] for x in found] == many and sum(x["share"] for x in found) == pytest.approx(1, abs=1e-4)
    assert all(len(x["languages"]) == 1 for k, x in got.items() if k != 10_000)


def test_long_texts_are_scored_in_parts(monkeypatch):
    """Parts change nothing but the order of sums; runs of letters beyond the bound are words of that many bytes."""
    from wordtide.llm import language_id as L

    r, langs = random.Random(5), invented(6, 3)
    texts = [speech(r, s, 3000) + "x" * 5500 + " " + "é" * 4000 for s in langs.values()]
    counts = np.zeros((1 << L.SLOTS_BITS, 3)) + 0.1
    for k, s in enumerate(langs.values()):
        data, _, a, b, _, word, n = L._counted_words([speech(r, s, 5000)])
        slots, first = L.word_grams(data, a, b)
        np.add.at(counts[:, k], slots, np.repeat(n, np.diff(np.append(first, len(slots)))))
    logp = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    whole = L.mixtures(texts, L.Scores(logp))
    monkeypatch.setattr(L, "BYTES", 4000)
    monkeypatch.setattr(L, "MATRIX", 4000)
    parts = L.mixtures(texts, L.Scores(logp))
    assert [[k for k, _ in x] for x in whole] == [[k for k, _ in x] for x in parts] and all(len(x) >= 1 for x in whole)
    for a, b in zip(whole, parts, strict=True):
        assert [y for _, y in a] == pytest.approx([y for _, y in b], rel=1e-4)
