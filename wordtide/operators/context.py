"""Words in context: windows, senses by rule, collocates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.text import ascii_edges, tokens, windows


def kwic(records: DataFrame, forms: DataFrame, width: int = 8, text: str = "text") -> DataFrame:
    """record, genre, year, target, pos (0-based), form, window: every occurrence of a form(target, form), repeats counted, with width
    tokens on either side. All targets in one pass; records without a form are dropped before tokens are laid out. Records that have toks
    already keep them; else the pattern runs once a text."""
    listed = forms.select("target", F.col("form")).distinct()
    all_forms = F.array(*[F.lit(r[0]) for r in listed.select("form").distinct().orderBy("form").collect()])  # a hand-made list
    cols = [c for c in ("record", "genre", "year") if c in records.columns]
    rows = records.select(*cols, "toks") if "toks" in records.columns else once(records.select(*cols, text), "toks", tokens(F.col(text))).drop(text)
    rows = rows.where(F.arrays_overlap("toks", all_forms))
    hits = F.filter(F.transform("toks", lambda x, i: F.struct(i.alias("pos"), x.alias("form"))), lambda x: F.array_contains(all_forms, x.form))
    rows = rows.select(*cols, "toks", F.explode(hits).alias("hit"))
    rows = rows.select(*cols, F.col("hit.pos").alias("pos"), F.col("hit.form").alias("form"), windows(F.col("toks"), F.col("hit.pos"), width).alias("window"))
    return rows.join(F.broadcast(listed), "form").select(*cols, "target", "pos", "form", "window")


def classify(occurrences: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "unclear") -> DataFrame:
    """Adds sense: of the target's rules (target, sense, pattern), in order, the first that is found in the window's text."""
    text = F.array_join("window", " ")
    sense = F.lit(otherwise)
    for target, name, pattern in reversed(rules):
        sense = F.when((F.col("target") == target) & F.col("_text").rlike(ascii_edges(pattern)), F.lit(name)).otherwise(sense)
    return occurrences.withColumn("_text", text).withColumn("sense", sense).drop("_text")


def senses_by_year(classified: DataFrame, y0: int, y1: int) -> DataFrame:
    """target, sense, year, n on a dense grid of years."""
    n = classified.where(F.col("year").between(y0, y1)).groupBy("target", "sense", "year").agg(F.count("*").alias("n"))
    dense = n.select("target", "sense").distinct().withColumn("year", F.explode(F.sequence(F.lit(y0), F.lit(y1))))
    return dense.join(n, ["target", "sense", "year"], "left").fillna({"n": 0})


def with_era(df: DataFrame, eras: list[tuple[str, int, int]]) -> DataFrame:
    """Adds era by year: a row for each era that its year lies in, as eras may overlap; rows outside all eras go. For a few eras; a table of
    them goes through intervals.contained()."""
    listed = F.array(*[F.struct(F.lit(name).alias("era"), F.lit(a).alias("a"), F.lit(b).alias("b")) for name, a, b in eras])
    own = F.transform(F.filter(listed, lambda e: F.col("year").between(e.a, e.b)), lambda e: e.era)
    return df.select("*", F.explode(own).alias("era"))


def context_words(occurrences: DataFrame, forms: DataFrame, stop: DataFrame | None = None, blocked: str | None = None) -> DataFrame:
    """target, era (if there), record, pos, item: distinct words of each window but the target's forms, stop words (word), blocked
    ones, digits and single characters."""
    keys = [c for c in ("target", "era", "year", "record", "pos") if c in occurrences.columns]
    words = occurrences.select(*keys, F.explode(F.array_distinct("window")).alias("item"))
    words = words.where((F.length("item") > 1) & ~F.col("item").rlike(r"^[0-9]+\z"))
    if blocked:
        words = words.where(~F.col("item").rlike(rf"^(?:{blocked})\z"))
    words = words.join(F.broadcast(forms.select("target", F.col("form").alias("item")).distinct()), ["target", "item"], "left_anti")
    if stop is not None:
        words = words.join(F.broadcast(stop.select(F.col("word").alias("item")).distinct()), "item", "left_anti")
    return words.select(*keys, "item")


def log_odds(counts: DataFrame, strength: float, keys: list[str], group: str, least: int = 1, trials: DataFrame | None = None) -> DataFrame:
    """keys, group, item, y1, y2, z: log odds of an item in a group against all other groups, with an informative Dirichlet prior.

    counts: keys, group, item, y. The prior of an item is its share of all counts x strength. trials: keys, group, n of each group;
    without it they are the group's counts. Items with y1 < least are dropped after totals are formed."""
    item_total = counts.groupBy(*keys, "item").agg(F.sum("y").alias("total"))
    all_total = counts.groupBy(*keys).agg(F.sum("y").cast("double").alias("a0"))
    if trials is None:
        trials = counts.groupBy(*keys, group).agg(F.sum("y").alias("n"))
    whole = trials.groupBy(*keys).agg(F.sum("n").alias("n_all"))
    trials = trials.join(whole, keys) if keys else trials.crossJoin(F.broadcast(whole))
    df = counts.where(F.col("y") >= least).join(item_total, [*keys, "item"])
    df = df.join(all_total, keys) if keys else df.crossJoin(F.broadcast(all_total))
    df = df.join(trials.select(*keys, group, F.col("n").cast("double").alias("n1"), (F.col("n_all") - F.col("n")).cast("double").alias("n2")), [*keys, group])
    y1, y2 = F.col("y").cast("double"), (F.col("total") - F.col("y")).cast("double")
    a, k = F.col("total").cast("double") / F.col("a0") * strength, F.lit(float(strength))
    d = F.ln((y1 + a) / (F.col("n1") + k - y1 - a)) - F.ln((y2 + a) / (F.col("n2") + k - y2 - a))
    z = d / F.sqrt(F.lit(1.0) / (y1 + a) + F.lit(1.0) / (y2 + a))
    return df.select(*keys, group, "item", F.col("y").alias("y1"), (F.col("total") - F.col("y")).alias("y2"), "n1", "n2", z.alias("z"))


def top_ranked(scored: DataFrame, keys: list[str], k: int = 14, score: str = "z") -> DataFrame:
    """keys, rank and the columns of scored(keys, item, n, score): each group's k highest by (score, item, n), all falling, so a tie goes to
    the item that sorts last."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), F.desc("item"), F.desc("n"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def senses_by_era(classified: DataFrame, eras: list[tuple[str, int, int]]) -> DataFrame:
    """target, era, sense, n; zeros for senses that an era lacks."""
    n = with_era(classified, eras).groupBy("target", "era", "sense").agg(F.count("*").alias("n"))
    listed = F.explode(F.array(*[F.lit(e) for e, _, _ in eras]))
    dense = n.select("target", "sense").distinct().withColumn("era", listed)
    return dense.join(n, ["target", "era", "sense"], "left").fillna({"n": 0}).select("target", "era", "sense", "n")
