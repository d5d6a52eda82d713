"""A positional index of words: where each word stands, and windows around any words without looking at texts again.

postings() has a row for every word of every record with its place; laid out by word, the places of some words are in their buckets alone.
tokens() has each record's words in order; laid out by record, windows are cut where the words lie, and only the places travel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import windows

KEYS = ("record", "genre", "year")


def postings(records: DataFrame) -> DataFrame:
    """item, record, genre, year, pos (0-based) of records(record, genre, year, toks)."""
    return records.select(*KEYS, F.posexplode("toks").alias("pos", "item")).select("item", *KEYS, "pos")


def tokens(records: DataFrame) -> DataFrame:
    """record, genre, year, toks."""
    return records.select(*KEYS, "toks")


def kwic(posted: DataFrame, toks: DataFrame, forms: DataFrame, width: int = 8, few: int = 1000) -> DataFrame:
    """record, genre, year, target, pos, form, window: what context.kwic() gives, from postings() and tokens().

    forms(target, form) are written by hand: their words go into the plan, so that only their buckets are read. Places are gathered by record
    and meet the records' words there. If `few` records have them all, their numbers go into the plan too, and only their buckets and row
    groups of words are read; else the join leaves out the others."""
    listed = forms.select("target", F.col("form").alias("item")).distinct()
    words = [r[0] for r in listed.select("item").distinct().orderBy("item").collect()]
    hits = posted.where(F.col("item").isin(words)).groupBy("record").agg(F.collect_list(F.struct("pos", "item")).alias("hits"))  # a record's places
    which = [r[0] for r in hits.select("record").limit(few + 1).collect()]
    if len(which) <= few:
        toks = toks.where(F.col("record").isin(which))
    rows = toks.join(hits, "record").select(*KEYS, "toks", F.explode("hits").alias("hit"))
    rows = rows.select(*KEYS, F.col("hit.pos").alias("pos"), F.col("hit.item").alias("item"), windows(F.col("toks"), F.col("hit.pos"), width).alias("window"))
    return rows.join(listed, "item").select(*KEYS, "target", "pos", F.col("item").alias("form"), "window")
