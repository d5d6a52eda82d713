"""Exact distinct entities from presence words: who used an item, as bits of 64 neighbouring entities.

A presence table has a row for each combination of its keys and `word` = entity div 64: records, and `bits` with one bit for each entity
that is there. It is built by one aggregation of the uses, combined before the shuffle; whatever is counted afterwards - over fewer keys,
within regions, in a pool - ORs and ANDs those numbers and counts bits, and no use is looked at again. Entities are whole numbers,
best dense ones (corpus.entities), so that neighbours share words; a rare item then costs a row for each of its entities, as a
distinct count does, and a common one a row for 64. Bitmaps of 4 KB a group, which Spark builds too, would be mostly zeros here.

Null entities are present nowhere, but their records count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, word, records, bits of rows(keys, entity)."""
    e = F.col("entity").cast("long")
    bit = F.expr("shiftleft(1L, cast(pmod(cast(entity as bigint), 64) as int))")
    return rows.select(*keys, F.shiftright(e, 6).alias("word"), F.when(e.isNotNull(), bit).alias("bit")).groupBy(*keys, "word").agg(F.count("*").alias("records"), F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("bits"))


def joined(table: DataFrame, *keys: str) -> DataFrame:
    """A presence table over fewer keys."""
    return table.groupBy(*keys, "word").agg(F.sum("records").alias("records"), F.bit_or("bits").alias("bits"))


def counted(table: DataFrame, *keys: str) -> DataFrame:
    """keys, records, entities: distinct entities over everything else."""
    own = set(table.columns) == {*keys, "word", "records", "bits"}
    return (table if own else joined(table, *keys)).groupBy(*keys).agg(F.sum("records").alias("records"), F.sum(F.bit_count("bits")).cast("long").alias("entities"))


def within(table: DataFrame, members: DataFrame) -> DataFrame:
    """The presence table among the entities of members(groups, word, bits), a presence table of groups: their keys come with each row.
    records are left out, since a row's can't be told apart by entity."""
    groups = [c for c in members.columns if c not in ("word", "records", "bits")]
    other = members.select(*groups, "word", F.col("bits").alias("_bits"))
    own = [c for c in table.columns if c not in ("word", "records", "bits")]
    both = F.col("bits").bitwiseAND(F.col("_bits"))
    return table.join(other, "word").select(*own, *groups, "word", both.alias("bits")).where("bits <> 0")


def entities_within(table: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """keys, groups, entities: distinct entities of each group of members. Rows are ORed over what isn't asked for before they meet the
    members, so that a table of years costs its words once."""
    own = [c for c in table.columns if c not in ("word", "records", "bits")]
    table = table if set(own) == set(keys) else joined(table, *keys)
    groups = [c for c in members.columns if c not in ("word", "records", "bits")]
    return within(table, members).groupBy(*keys, *groups).agg(F.sum(F.bit_count("bits")).cast("long").alias("entities"))
