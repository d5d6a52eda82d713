"""A lexicon of terms (id, label, cat, gloss, tokens, phrases, poly, region) matched against records."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phrases import Matcher

SCHEMA = "id string, label string, cat string, gloss string, tokens array<string>, phrases array<string>, poly boolean, region string"


def lexicon(spark: SparkSession, terms: Iterable[dict]) -> DataFrame:
    rows = [(t["id"], t.get("label", t["id"]), t.get("cat"), t.get("gloss"), list(t.get("tokens", ())), list(t.get("phrases", ())), bool(t.get("poly", False)), t.get("region")) for t in terms]
    return spark.createDataFrame(rows, SCHEMA)


def scan(records: DataFrame, lex: DataFrame, text: str = "text", spellings: bool = True, phrases: bool = True) -> DataFrame:
    """record, term, unmapped: terms of each record by either route, and (without a term) strings that the phrases find together but that
    no single phrase matches, to be warned about. One pass over the texts, without a shuffle, whatever the size of the lexicon: it goes to
    workers as an automaton of its words (functions/phrases), not into the plan. A lexicon is written by hand and fits a worker."""
    spark = records.sparkSession
    terms = [(r["id"], list(r["tokens"] or ()) if spellings else [], list(r["phrases"] or ()) if phrases else []) for r in lex.select("id", "tokens", "phrases").orderBy("id").toLocalIterator()]
    held = spark.sparkContext.broadcast(terms)
    key = records.select("record")

    def run(batches):
        matcher = Matcher(held.value)
        for batch in batches:
            at, term, unmapped = [], [], []
            for k, t in enumerate(batch.column(1)):
                value = t.as_py()
                if value is None:
                    continue
                found, unknown = matcher.find(value) if phrases else (set(), ())
                found = sorted(found | matcher.spellings(value))
                at += [k] * (len(found) + len(unknown))
                term += [*found, *[None] * len(unknown)]
                unmapped += [*[None] * len(found), *unknown]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(term, pa.string()), pa.array(unmapped, pa.string())], ["record", "term", "unmapped"])

    return records.select("record", F.col(text).alias("text")).mapInArrow(run, f"record {key.schema[0].dataType.simpleString()}, term string, unmapped string")


def terms_of(scanned: DataFrame) -> DataFrame:
    """record, term of what scan() found."""
    return scanned.where("term is not null").select("record", "term")


def warnings(scanned: DataFrame) -> DataFrame:
    """m, records: strings of scan() that no single phrase matches."""
    return scanned.where("unmapped is not null").groupBy(F.col("unmapped").alias("m")).agg(F.count("*").alias("records"))


def match_tokens(records: DataFrame, lex: DataFrame, text: str = "text") -> DataFrame:
    """record, term: a spelling may belong to several terms, and a term counts once a record. records: one row each."""
    return terms_of(scan(records, lex, text, phrases=False))


def match_phrases(records: DataFrame, lex: DataFrame, text: str = "text") -> DataFrame:
    """record, term, as match_tokens() does."""
    return terms_of(scan(records, lex, text, spellings=False))


def match(records: DataFrame, lex: DataFrame, text: str = "text") -> DataFrame:
    """record, term by either route."""
    return terms_of(scan(records, lex, text))


def term_uses(matched: DataFrame, records: DataFrame, title: bool = False) -> DataFrame:
    """record, entity, genre, year, item (and title): matches as uses, for adoption()."""
    cols = ["record", "entity", "genre", "year", *["title"] * title]
    return matched.select("record", F.col("term").alias("item")).join(records.select(*cols), "record")


def rollup(uses: DataFrame) -> DataFrame:
    """genre, year, item, records, entities."""
    return uses.groupBy("genre", "year", "item").agg(F.count("*").cast("int").alias("records"), F.count_distinct("entity").cast("int").alias("entities"))


def entity_rollup(uses: DataFrame, focal: str) -> DataFrame:
    return uses.where(F.col("genre") == focal).groupBy("entity", "year", "item").agg(F.count("*").cast("int").alias("records"))
