"""The automaton of a lexicon against one alternation of its phrases."""

import random
import re

import pytest

from wordtide.functions.phrases import Matcher, plainly
from wordtide.operators import lexicon as X


def vocabulary(rng, n):
    return ["".join(rng.choice("abc'") for _ in range(rng.randint(1, 3))) for _ in range(n)]


def text(rng, words, n=40):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", ", ", "", "!", "é", "_", "-"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_finds_what_the_alternation_finds(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "ab", "it's", "ca", "bc", "é", "a_b"]
    literal = lambda: " ".join(rng.choice(words[:7]) for _ in range(rng.randint(1, 4)))
    pattern = lambda: rng.choice([r"a ?b", r"(?:a|b) c", r"b(?:c|ca)?", "c!", r"a\w*", "ab ?c", r"[bc] a$", "it'?s a"])
    phrases = [[pattern() if seed % 2 and rng.random() < 0.3 else literal() for _ in range(rng.randint(0, 6))] for _ in range(6)]
    terms = [(f"t{i}", [], ps) for i, ps in enumerate(phrases)]
    m = Matcher(terms)
    for _ in range(60):
        t = text(rng, words)
        assert m.find(t)[0] == plainly(terms, t), (terms, t)


def test_overlaps_order_and_strings_within():
    terms = [("a", [], ["in the", "the end"]), ("b", [], ["the"]), ("c", [], ["in the end of"])]
    m = Matcher(terms)
    assert m.find("in the end of")[0] == {"a", "b"}  # the first in order wins, and hides what overlaps it
    assert m.find("at the end")[0] == {"a", "b"} and m.find("in, the") == ({"b"}, set()) and m.find("") == (set(), set())
    assert m.find("in\n the x_the")[0] == {"a", "b"}


def test_strings_that_no_single_phrase_knows():
    m = Matcher([("a", [], [r"x(?= y)"])])
    assert m.find("x y") == (set(), {"x"})


def test_spellings_belong_to_several_terms():
    m = Matcher([("a", ["don't", "x"], []), ("b", ["x"], [])])
    assert m.spellings("Don't don't x' x") == {"a", "b"} and m.spellings("don") == set()


def test_five_thousand_phrases_in_a_plan_of_fixed_size(spark):
    rng = random.Random(3)
    words = vocabulary(rng, 300)
    many = sorted({" ".join(rng.choice(words).strip("'") or "a" for _ in range(rng.randint(3, 4))) for _ in range(9000)})[:5000]
    assert len(many) == 5000
    terms = [{"id": f"t{i:04d}", "phrases": [p], "tokens": [words[i % 300]]} for i, p in enumerate(many)]
    rows = [(i, text(rng, words, 60)) for i in range(60)] + [(100, None), (101, "")]
    rows += [(200 + i, f"zz {many[rng.randint(0, 4999)]}, zz") for i in range(40)]
    df = spark.createDataFrame(rows, "record long, text string")
    found = X.match_phrases(df, X.lexicon(spark, terms))
    plan = len(found._jdf.queryExecution().executedPlan().toString())
    assert plan < 2000 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    every = re.compile("|".join(rf"(?<![0-9A-Za-z_]){p.replace(' ', r'\s+')}(?![0-9A-Za-z_])" for p in many), re.ASCII)
    known = {p: t["id"] for p, t in zip(many, terms, strict=True)}
    want = set()
    for r, x in rows:  # as plainly() does, for so many
        for hit in {" ".join(h.split()) for h in every.findall(x or "")}:
            want |= {(r, t) for p, t in known.items() if re.search(rf"(?<![0-9A-Za-z_]){p}(?![0-9A-Za-z_])", hit, re.ASCII)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 40


def test_terms_and_warnings_in_one_pass(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x z w"), (3, None)], "record long, text string")
    lex = X.lexicon(spark, [{"id": "a", "phrases": [r"x(?= y)", "z w"], "tokens": ["z"]}])
    scanned = X.scan(df, lex)
    assert [tuple(r) for r in X.warnings(scanned).collect()] == [("x", 1)] and [tuple(r) for r in X.terms_of(scanned).collect()] == [(2, "a")]
    assert scanned._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
