"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Token weights of the cells are raked until their marginals meet the targets;
documents are then sampled with probabilities in proportion to their cell's weight, so that the expected tokens kept are the asked share.
Where that would take a probability above 1, probabilities are raked on with 1 as their bound, so that marginals and bound hold together;
where they can't at the asked share, the share is lowered to the largest at which they do, which is returned (`keep`) and warned of.
A document's draw is a hash of its id, so it is the same wherever and however often it is made.

Topics are clusters of hashed term vectors (topics="terms", see topics.py) or forms of text by rule (topics="form"). Tokens and vectors
of a document are computed once and kept as a table; clusters, raking and the draw read that table."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import topics as T
from .common import Temporaries, bounded_batches, forget, free_name, spill

#: Cells that are raked on the driver and broadcast (a few MB); more are raked as a table and joined, by the same rules.
DRIVER_CELLS = 100_000
SWEEPS, TOLERANCE = 200, 1e-10
#: Marginals that miss their goal by no more than this share of what is kept are met; the largest feasible share is found by so many halvings.
MET, HALVINGS = 1e-6, 8
CELL = "source string, lang string, topic string"
#: Topics by the form of a text, the first that fits; the rest is prose.
TOPICS = [("tabular", r"\|[^\n|]*\|"), ("contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"), ("license", r"(?i)licen[sc]e|copyright")]
NULL = "\x00null"
#: Powers of the corpus' shares that make the default targets: below 1 they raise what is rare.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.7}
KEEP = 0.5


def topic_of(text: Column, rules: list[tuple[str, str]] = TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def n_words(text: Column) -> Column:
    """Whitespace-separated words, without a list of them being kept: starts of runs."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _axis(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL))


def flattened(sums_at) -> float:
    """c such that shares of min(share / keep, c * share**power) add up to 1: no category is asked for more than it has.
    sums_at(c): the sum of what is bounded at c, and of share**power of the rest."""
    c, last = 0.0, -1.0
    while c > last:
        bounded, free = sums_at(c)
        c, last = max(c, (1 - bounded) / free if free > 0 else c), c
    return c


def _stuck(misses: list[float], cap: float | None) -> bool:
    """Whether raking against a bound has come to a stand short of its goals: a feasible share would have gained more by now."""
    return cap is not None and len(misses) > 12 and misses[-1] > 0.9 * misses[-9]


def rake(tokens: np.ndarray, members: list[np.ndarray], goals: list[np.ndarray], cap: float | None = None, start: np.ndarray | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights of the cells at which the marginals of tokens * min(cap, weight) meet the goals, and the worst miss as a share of what is
    asked in all. members: each cell's category on each axis; goals: amounts of tokens by category.

    A category's weights are multiplied by what its uncapped cells need, so that without a cap this is plain proportional fitting. Where
    capped cells alone reach the goal, weights fall to what would do without a cap, and rise again from there."""
    w = np.ones(len(tokens)) if start is None else start.astype(float)
    asked, misses = max(float(goals[0].sum()), 1e-300), []
    for _ in range(sweeps):
        worst = 0.0
        for of, want in zip(members, goals, strict=True):
            full, x = (np.zeros(len(w), dtype=bool) if cap is None else w >= cap), tokens * w
            sums = lambda v: np.bincount(of, weights=v, minlength=len(want))  # noqa: B023, E731
            capped, free, both = (sums(np.where(full, tokens * (cap or 0), 0)), sums(np.where(full, 0, x)), sums(x))
            worst = max(worst, float(np.abs(capped + free - want).max()) / asked)
            up = np.divide(want - capped, free, out=np.ones_like(want), where=free > 0)
            down = np.divide(want, both, out=np.zeros_like(want), where=both > 0)
            w = np.minimum(w * np.where(want > capped, up, down)[of], 1e150)
        misses.append(worst)
        if worst < tolerance or _stuck(misses, cap):
            break
    return w, worst


def rake_table(cells: DataFrame, axes: list[str], goals: dict[str, DataFrame], asked: float, cap: float | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """rake() for more cells than the driver should hold, by the same rule: cells have w to begin with and come back with w fitted; goals
    are tables (axis, want); asked is the sum of an axis' goals."""
    held, misses, full = None, [], (F.lit(False) if cap is None else F.col("w") >= F.lit(float(cap)))
    for _ in range(sweeps):
        worst, factors = 0.0, []
        for a in axes:
            x = F.col("tokens") * F.col("w")
            sums = cells.groupBy(a).agg(F.sum(F.when(full, F.col("tokens") * F.lit(float(cap or 0))).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(x)).alias("free"), F.sum(x).alias("both"))
            up = F.when(F.col("free") > 0, (F.col("want") - F.col("capped")) / F.col("free")).otherwise(1.0)
            down = F.when(F.col("both") > 0, F.col("want") / F.col("both")).otherwise(0.0)
            factor = sums.join(goals[a], a, "left").withColumn("want", F.coalesce("want", F.lit(0.0)))
            factor = spill(factor.select(a, F.abs(F.col("capped") + F.col("free") - F.col("want")).alias("miss"), F.when(F.col("want") > F.col("capped"), up).otherwise(down).alias("f")), "mix-factors")
            factors.append(factor)
            worst = max(worst, (factor.agg(F.max("miss")).first()[0] or 0.0) / asked)
            cells = cells.join(factor.select(a, "f"), a).withColumn("w", F.least(F.col("w") * F.col("f"), F.lit(1e150))).drop("f")
        cells = spill(cells, "mix-cells")
        for x in (*factors, *([held] if held is not None else [])):
            forget(x)
        held = cells
        misses.append(worst)
        if worst < tolerance or _stuck(misses, cap):
            break
    return cells, worst


def largest_share(fit, keep: float, floor: float, drop=lambda got: None):
    """(share, fitted) for the largest share up to keep at which fit(share) -> (fitted, worst miss) meets its goals within MET, found by
    halving between floor, which is known to do, and keep; drop() gets what isn't used."""
    got, worst = fit(keep)
    if worst <= MET or keep <= floor:
        return keep, got
    drop(got)
    low, high, best = floor, keep, None
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        got, worst = fit(mid)
        if worst <= MET:
            if best is not None:
                drop(best)
            low, best = mid, got
        else:
            drop(got)
            high = mid
    return (low, best) if best is not None else (floor, fit(floor)[0])


def _counted(docs: DataFrame, id_: Column, source: Column, lang: Column, text: Column, count: str, topics: str = "form") -> tuple[DataFrame, T.TopicModel | None]:
    """doc_id, source, lang, topic, n_tokens of every row, and the model of topics="terms". count: "words" (runs of \\S+) or "bpe" (tokens
    of the shared encoder, which are counted once and kept as a table)."""
    bounded_batches(docs.sparkSession)
    form = topic_of(F.coalesce(text, F.lit(""))) if topics == "form" else F.lit(None).cast("string")
    n = n_words(text) if count == "words" else F.lit(0).cast("long")
    rows = docs.select(id_.cast("long").alias("doc_id"), source.cast("string").alias("source"), lang.cast("string").alias("lang"), form.alias("topic"), n.alias("n_tokens"), text.alias("text"))
    if count == "words" and topics == "form":
        return rows.drop("text"), None
    sent = bpe.shipped(docs.sparkSession) if count == "bpe" else None

    def tokens(batches):
        enc = bpe.worker_encoder(sent) if sent is not None else None
        for b in batches:
            texts = bpe.texts_of(b.column(5))
            for i, j in bpe.chunks(texts):
                part = b.slice(i, j - i).remove_column(5)
                if enc is not None:
                    n, _ = enc.encode(texts[i:j], with_ids=False)
                    part = part.set_column(4, "n_tokens", pa.array(n.astype(np.int64)))
                if topics == "terms":
                    v = [T.term_vectors(texts[i + x : i + x + len(t)]) for x, t in T._batches(b.column(5).slice(i, j - i))]
                    part = part.append_column("vector", T.packed(np.concatenate(v)))
                yield part

    schema = "doc_id long, source string, lang string, topic string, n_tokens long"
    if topics == "form":
        return spill(rows.mapInArrow(tokens, schema), "mix-counts"), None
    counted = spill(rows.mapInArrow(tokens, schema + ", vector binary"), "mix-vectors")
    model = T.fit(counted.select("doc_id", "lang", "vector"))
    told = docs.sparkSession.sparkContext.broadcast(model)

    def named(batches):
        for b in batches:
            names = told.value.names(T.unpacked(b.column(5), T.DIMENSIONS), b.column(2).to_pylist())
            yield b.remove_column(5).set_column(3, "topic", pa.array(names, pa.string()))

    out = spill(counted.mapInArrow(named, schema), "mix-counts")
    forget(counted)
    return out, model


def cell_weights(docs: DataFrame, source: Column, lang: Column, text: Column, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, count: str = "words") -> DataFrame | None:
    """(source, lang, topic, tokens, weight, probability, keep) of every cell; None without tokens. weight: raked over actual tokens;
    keep: the share of all tokens that probabilities keep in expectation, which is the one asked for unless that one is out of reach.
    Targets of categories that the corpus lacks are left out, and categories without a target, on an axis that has some, get weight 0;
    where that leaves an axis nothing, nothing is kept. Targets that contradict each other on the cells there are warned of, and what
    raking makes of them is met."""
    return _weights(_counted(docs, F.lit(None), source, lang, text, count)[0], targets, keep)[0]


def _warn_of(miss: float, keep: float, share: float) -> None:
    if miss > MET:
        warnings.warn(f"targets contradict each other on these cells: a share of {miss:.2g} of the tokens is off target", stacklevel=3)
    if share < keep * (1 - 1e-9):
        warnings.warn(f"targets can't be met at keep={keep}, since documents are kept once at most: {share:.6g} of the tokens are kept", stacklevel=3)


def _weights(counted: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float) -> tuple[DataFrame | None, float]:
    """Cells as cell_weights() gives them, and the share kept."""
    rows = counted.select(_axis(F.col("source")).alias("source"), _axis(F.col("lang")).alias("lang"), "topic", F.col("n_tokens").alias("tokens"))
    axes = ["source", "lang", "topic"]
    cells = spill(rows.groupBy(*axes).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "mix-cells")
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return None, 0.0
    if n > DRIVER_CELLS:
        return _weights_table(cells, axes, targets, keep, float(total))
    table = cells.toPandas().sort_values(axes).reset_index(drop=True)
    share = table["tokens"].to_numpy(float) / total
    members, wanted = [], []
    for a in axes:
        names, of = np.unique(table[a].to_numpy(object), return_inverse=True)
        given, have = (targets or {}).get(a), np.bincount(of, weights=share)
        if given:
            t = np.array([float(given.get(k, 0.0)) for k in names])
        else:
            raised, bound = have ** FLATTEN[a], have / min(keep, 1.0)
            c = flattened(lambda c: (bound[c * raised >= bound].sum(), raised[c * raised < bound].sum()))  # noqa: B023
            t = np.minimum(bound, c * raised)
        members.append(of)
        wanted.append(t / (t.sum() or 1.0))
    w, _ = rake(share, members, wanted)
    w = w / ((share * w).sum() or 1.0)
    # From here on the marginals that raking reached are the goals: the targets, if the cells allow them.
    goals = [np.bincount(of, weights=share * w, minlength=len(t)) for of, t in zip(members, wanted, strict=True)]
    miss = max(float(np.abs(g - t).max()) for g, t in zip(goals, wanted, strict=True))
    most = min(float((np.bincount(of, weights=share)[g > 0] / g[g > 0]).min(initial=1.0)) for of, g in zip(members, goals, strict=True))
    fit = lambda k: rake(share, members, [k * g for g in goals], 1.0, k * w, tolerance=MET / 10)
    kept, fitted = largest_share(fit, min(keep, most), min(keep, 1 / max(float(w.max()), 1.0)))
    _warn_of(miss, keep, kept)
    table["weight"], table["probability"], table["keep"] = w, np.minimum(1.0, fitted), kept
    return F.broadcast(rows.sparkSession.createDataFrame(table, f"{CELL}, tokens long, weight double, probability double, keep double")), kept


def _weights_table(cells: DataFrame, axes: list[str], targets: dict[str, dict[str, float]] | None, keep: float, total: float) -> tuple[DataFrame, float]:
    """_weights() for more cells than the driver should hold; categories stay in tables as well."""
    spark = cells.sparkSession
    with Temporaries() as held:
        shares, wanted = cells.select(*axes, F.col("tokens").alias("count"), (F.col("tokens") / F.lit(total)).alias("tokens"), F.lit(1.0).alias("w")), {}
        for a in axes:
            given, of = (targets or {}).get(a), shares.groupBy(a).agg(F.sum("tokens").alias("have"))
            if given:
                named = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{a} string, want double")
                of = of.join(named, a, "left").withColumn("want", F.coalesce("want", F.lit(0.0)))
            else:
                of = held.spill(of, "mix-wanted")
                raised, bound = F.pow("have", F.lit(FLATTEN[a])), F.col("have") / F.lit(min(keep, 1.0))

                def sums_at(c, of=of, raised=raised, bound=bound):
                    over = F.lit(c) * raised >= bound
                    return of.agg(F.sum(F.when(over, bound).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(raised))).first()

                of = of.withColumn("want", F.least(bound, F.lit(flattened(sums_at)) * raised))
            of = held.spill(of, "mix-wanted")
            wanted[a] = of.select(a, "have", (F.col("want") / F.lit(of.agg(F.sum("want")).first()[0] or 1.0)).alias("want"))
        raked, _ = rake_table(shares, axes, {a: t.select(a, "want") for a, t in wanted.items()}, 1.0)
        norm = raked.agg(F.sum(F.col("tokens") * F.col("w"))).first()[0] or 1.0
        weighed = held.spill(raked.withColumn("weight", F.col("w") / F.lit(norm)), "mix-weighed")
        forget(raked)
        goals, miss, most = {}, 0.0, 1.0
        for a in axes:
            goal = weighed.groupBy(a).agg(F.sum(F.col("tokens") * F.col("weight")).alias("goal"))
            goals[a] = held.spill(goal.join(wanted[a], a), "mix-goals")
            off, room = goals[a].agg(F.max(F.abs(F.col("goal") - F.col("want"))), F.min(F.when(F.col("goal") > 0, F.col("have") / F.col("goal")))).first()
            miss, most = max(miss, off), min(most, room if room is not None else 1.0)

        def fit(k: float):
            start = weighed.withColumn("w", F.col("weight") * F.lit(k))
            return rake_table(start, axes, {a: t.select(a, (F.col("goal") * F.lit(k)).alias("want")) for a, t in goals.items()}, k, 1.0, tolerance=MET / 10)

        top = max(weighed.agg(F.max("weight")).first()[0], 1.0)
        kept, fitted = largest_share(fit, min(keep, most), min(keep, 1 / top), forget)
        _warn_of(miss, keep, kept)
    return fitted.select(*axes, F.col("count").alias("tokens"), "weight", F.least(F.lit(1.0), F.col("w")).alias("probability"), F.lit(kept).alias("keep")), kept


def _drawn(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id; null ids share one."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = 7, count: str = "words", topics: str = "form") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept, keep for every row of docs; keep is the share of all tokens that
    probabilities keep in expectation: the one asked for, or the largest that the targets allow.

    count: "words" or "bpe", what tokens are; topics: "form" or "terms". targets: shares by axis ("source", "lang", "topic") and category; an axis without is the corpus' shares, raised to a power
    below 1, but no category is asked for more than it has. A null source or
    language is a category of its own ("\\x00null" in targets); a null or blank text has no tokens, weight and probability 0 if its
    cell has no tokens at all, and is prose ("none" with topics="terms"); rows of one id share one draw; an empty table gives an empty result; other columns are not
    read."""
    c = lambda name: F.col(f"`{name}`")
    text = c(text_col).cast("string")
    rows, _ = _counted(docs, c(id_col), c(source_col), c(lang_col), text, count, topics)
    cells, share = _weights(rows, targets, keep)
    if cells is None:
        return rows.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"), F.lit(False).alias("kept"), F.lit(0.0).alias("keep"))
    cells = cells.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), "weight", "probability")
    out = rows.join(cells, (_axis(F.col("source")) == F.col("_s")) & (_axis(F.col("lang")) == F.col("_l")) & (F.col("topic") == F.col("_t")), "left")
    probability = F.coalesce("probability", F.lit(0.0))
    return out.select(*rows.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"), probability.alias("probability"), (_drawn(F.col("doc_id"), seed) < probability).alias("kept"), F.lit(share).alias("keep"))


def keep_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = 7, count: str = "words", topics: str = "form") -> DataFrame:
    """The rows of docs that mix() keeps, all columns as they are. Nulls, repeated and blank rows as in mix(): rows of one id share a
    draw; without any token nothing is kept; an empty table gives an empty result."""
    c = lambda name: F.col(f"`{name}`")
    counted, model = _counted(docs, c(id_col), c(source_col), c(lang_col), c(text_col).cast("string"), count, topics)
    cells, _ = _weights(counted, targets, keep)
    if cells is None:
        return docs.limit(0)
    s, l, t, p = (free_name(docs, f"_mix_{x}") for x in "sltp")
    cells = cells.select(F.col("source").alias(s), F.col("lang").alias(l), F.col("topic").alias(t), F.col("probability").alias(p))
    own = free_name(docs, "_mix_topic")
    rows = docs.withColumn(own, topic_of(F.coalesce(c(text_col).cast("string"), F.lit("")))) if model is None else T.with_topics(docs, text_col, lang_col, model, own)
    on = (_axis(c(source_col)) == F.col(s)) & (_axis(c(lang_col)) == F.col(l)) & (F.col(own) == F.col(t))
    return rows.join(cells, on).where(_drawn(c(id_col).cast("long"), seed) < F.col(p)).select(*[c(x) for x in docs.columns])
