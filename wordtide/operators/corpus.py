"""Base tables from raw shards: entities, records, words of records, vocabulary, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.text import ACCOUNT, is_account, normalise, tokens


def raw(shards: DataFrame, years: tuple[int, int], account: str = ACCOUNT) -> DataFrame:
    """record (if there), genre, artist, year, title, text of the records in range that aren't an account's; year filters reach the scan."""
    rows = shards.where(F.col("year").between(*years) & F.coalesce(~is_account(F.col("artist"), account), F.lit(False)))
    title = F.col("title") if "title" in shards.columns else F.lit(None).cast("string")
    key = ["record"] if "record" in shards.columns else []
    return rows.select(*key, F.col("tag").alias("genre"), "artist", F.col("year").cast("smallint").alias("year"), title.alias("title"), normalise(F.col("lyrics")).alias("text"))


def entities(names: DataFrame, name: str = "artist", ranges: int = 256) -> DataFrame:
    """entity (1, 2, ... in binary order of the name), name. Distinct names are cut into ranges at a hashed draw of them, numbered within
    their range and moved on by the sizes of the ranges before, so no task orders them all."""
    d = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    drawn = [r[0] for r in d.orderBy(F.xxhash64("name"), "name").limit(ranges - 1).collect()]
    cuts = F.array(*map(F.lit, drawn)) if drawn else F.array().cast("array<string>")
    d = d.withColumn("part", F.size(F.filter(cuts, lambda c: c <= F.col("name"))))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = d.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # `ranges` rows
    own = F.row_number().over(W.partitionBy("part").orderBy("name"))
    return d.withColumn("own", own).join(F.broadcast(sizes), "part").select((F.col("before") + F.col("own")).cast("int").alias("entity"), "name")


def tokenise(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds toks, words (distinct) and n_tokens (with repeats); the pattern runs once a text, whatever is asked of its tokens later."""
    t = once(texts, "toks", tokens(F.col(text)))
    return t.withColumn("words", F.array_distinct("toks")).withColumn("n_tokens", F.size("toks"))


def uses_of(records: DataFrame) -> DataFrame:
    """record, entity, genre, year, item: one row a record and distinct word."""
    return records.select("record", "entity", "genre", "year", F.explode("words").alias("item"))


def vocabulary(uses: DataFrame, min_records: int = 10) -> DataFrame:
    return uses.groupBy("item").agg(F.count("*").alias("records")).where(F.col("records") >= min_records)


def entity_year_word(uses: DataFrame, vocab: DataFrame, focal: str) -> DataFrame:
    rows = uses.where(F.col("genre") == focal).join(vocab, "item", "left_semi")
    return rows.groupBy("entity", "year", "item").agg(F.count("*").cast("int").alias("records"))


def genre_year_word(uses: DataFrame, vocab: DataFrame) -> DataFrame:
    rows = uses.join(vocab, "item", "left_semi")
    return rows.groupBy("genre", "year", "item").agg(F.count("*").cast("int").alias("records"), F.count_distinct("entity").cast("int").alias("entities"))
