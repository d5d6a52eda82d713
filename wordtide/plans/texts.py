"""Text queries over documents: a document is a record, its source the entity, its language the genre; the year is made up from its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..operators import adoption as A
from ..operators import context as K
from ..operators import corpus as C
from ..operators import lexicon as X
from ..operators import lifecycle as L
from ..operators import postings as I
from ..operators import presence as B
from ..operators import views as V
from .registry import longs, query, rounded, table

Y0, Y1 = 2000, 2009
TERMS = [
    {"id": "art", "label": "Article", "cat": "grammar", "tokens": ["the", "der", "el"], "poly": True},
    {"id": "and", "label": "And", "cat": "grammar", "tokens": ["and", "und"], "phrases": ["of (?:the|and)"]},
    {"id": "the", "label": "The", "cat": "word", "tokens": ["the"], "phrases": ["in the", "on ?the"]},
    {"id": "of", "label": "Of", "cat": "word", "phrases": ["of the", "de la", "de les"]},
    {"id": "ride", "label": "Ride", "cat": "word", "phrases": ["thea of", "is a"], "region": "North"},
]
FORMS = [("the", "the"), ("the", "thea"), ("und", "und")]
RULES = [("the", "of", r"\bof the\b"), ("the", "conj", r"\b(?:and|in) \w+\b"), ("und", "art", r"\b(?:der|die|das)\b")]
STOP = ["of", "and", "in", "is", "der", "die"]


def plain(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("record"), F.col("source").alias("entity"), F.col("lang").alias("genre"), (F.lit(2000) + F.col("doc_id") % 10).cast("int").alias("year"), normalise(F.col("text")).alias("text"))


def records(spark: SparkSession, d: str) -> DataFrame:
    return C.tokenise(plain(spark, d))


RECT = r"""rect AS (SELECT doc_id AS record, source AS entity, lang AS genre, CAST(2000 + doc_id % 10 AS INTEGER) AS year,
  lower(replace(replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '’', ''''), '‘', '''')) AS text FROM documents),
rec AS (SELECT *, regexp_extract_all(text, '[a-z0-9]+(?:''[a-z0-9]+)*') AS toks FROM rect)"""
USES = "uses AS (SELECT record, entity, genre, year, unnest(list_distinct(toks)) AS item FROM rec)"


def lex_sql() -> str:
    tokens = ", ".join(f"('{t['id']}', '{w}')" for t in TERMS for w in t.get("tokens", ()))
    return f"spell(term, word) AS (VALUES {tokens})"


def _wrapped(p: str) -> str:
    return rf"\b(?:{p.replace(' ', chr(92) + 's+')})\b"


def phrase_sql() -> str:
    rows = [(t["id"], _wrapped(p)) for t in TERMS for p in t.get("phrases", ())]
    every = "|".join(f"(?:{p})" for _, p in sorted(rows, key=lambda r: r[0]))
    values = ", ".join(f"('{t}', '{p}')" for t, p in rows)
    return f"phr(term, rx) AS (VALUES {values}), raw AS (SELECT record, unnest(list_distinct(regexp_extract_all(text, '{every}'))) AS m FROM rec), hit AS (SELECT DISTINCT record, term FROM raw JOIN phr ON regexp_matches(m, rx))"


TOKEN_HIT = "tok AS (SELECT DISTINCT record, term FROM (SELECT record, unnest(list_distinct(toks)) AS word FROM rec) JOIN spell USING (word))"


def lex(spark: SparkSession) -> DataFrame:
    return X.lexicon(spark, TERMS)


@query(f"WITH {RECT} SELECT record, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(list_distinct(toks)) AS BIGINT) AS n_words, array_to_string(toks, ' ') AS joined FROM rec")
def normalise_tokens(spark, d):
    return longs(records(spark, d).select("record", "n_tokens", F.size("words").alias("n_words"), F.array_join("toks", " ").alias("joined")), "n_tokens", "n_words")


@query(f"WITH {RECT}, {USES} SELECT genre, item, count(*) AS records, count(DISTINCT entity) AS entities FROM uses GROUP BY ALL")
def doc_freq(spark, d):
    """Sources are numbered by C.entities, and counted as presence words."""
    r = records(spark, d)
    ids = C.entities(table(spark, d, "documents"), "source").withColumnRenamed("name", "source")
    uses = C.uses_of(r.withColumnRenamed("entity", "source").join(ids, "source", "left"))
    return B.counted(B.presence(uses, "genre", "item"), "genre", "item")


@query(f"WITH {RECT}, {USES} SELECT item, count(*) AS records FROM uses GROUP BY item HAVING count(*) >= 10")
def vocab_min_songs(spark, d):
    return C.vocabulary(C.uses_of(records(spark, d)), 10)


@query(f"WITH {RECT}, {USES}, v AS (SELECT item FROM uses GROUP BY item HAVING count(*) >= 10) SELECT genre, CAST(year AS BIGINT) AS year, item, count(*) AS records, count(DISTINCT entity) AS entities FROM uses SEMI JOIN v USING (item) GROUP BY ALL")
def genre_year_word(spark, d):
    u = C.uses_of(records(spark, d))
    return longs(C.genre_year_word(u, C.vocabulary(u, 10)), "year", "records", "entities")


@query(f"WITH {RECT}, {USES}, v AS (SELECT item FROM uses GROUP BY item HAVING count(*) >= 10) SELECT entity, CAST(year AS BIGINT) AS year, item, count(*) AS records FROM uses SEMI JOIN v USING (item) WHERE genre = 'en' GROUP BY ALL")
def entity_year_word(spark, d):
    u = C.uses_of(records(spark, d))
    return longs(C.entity_year_word(u, C.vocabulary(u, 10), "en"), "year", "records")


@query("SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS entity, name FROM (SELECT DISTINCT source AS name FROM documents)")
def entity_ids(spark, d):
    return longs(C.entities(table(spark, d, "documents"), "source"), "entity")


@query(
    f"""WITH {RECT}, {USES}, a AS (SELECT item, year, genre, count(*) AS records FROM uses GROUP BY ALL), t AS (SELECT genre, year, count(*) AS records FROM rec GROUP BY ALL)
    SELECT item, round(ln((coalesce(sum(records) FILTER (genre = 'en'), 0) + 5.0) / (SELECT sum(records) FILTER (genre = 'en') FROM t WHERE year >= 2002))
      - ln((coalesce(sum(records) FILTER (genre IN ('de', 'fr')), 0) + 5.0) / (SELECT sum(records) FILTER (genre IN ('de', 'fr')) FROM t WHERE year >= 2002)), 4) AS ratio FROM a WHERE year >= 2002 GROUP BY item"""
)
def log_ratio(spark, d):
    r = records(spark, d)
    n = C.uses_of(r).groupBy("item", "genre", "year").agg(F.count("*").alias("records"))
    return rounded(L.log_ratio(n, A.totals(r), "en", ["de", "fr"], 2002), "ratio")


@query(f"WITH {RECT}, {lex_sql()}, {TOKEN_HIT} SELECT record, term FROM tok")
def token_lexicon_match(spark, d):
    return X.match_tokens(plain(spark, d), lex(spark))


@query(f"WITH {RECT}, {phrase_sql()} SELECT record, term FROM hit")
def phrase_match(spark, d):
    return X.match_phrases(plain(spark, d), lex(spark))


@query(f"WITH {RECT}, {lex_sql()}, {TOKEN_HIT}, {phrase_sql()} SELECT record, term FROM tok UNION SELECT record, term FROM hit")
def song_terms_union(spark, d):
    return X.match(plain(spark, d), lex(spark))


@query(f"WITH {RECT}, {lex_sql()}, {TOKEN_HIT}, {phrase_sql()}, b AS (SELECT record, term FROM tok UNION SELECT record, term FROM hit) SELECT genre, CAST(year AS BIGINT) AS year, term AS item, count(*) AS records, count(DISTINCT entity) AS entities FROM b JOIN rec USING (record) GROUP BY ALL")
def term_rollup(spark, d):
    r = plain(spark, d)
    return longs(X.rollup(X.term_uses(X.match(r, lex(spark)), r)), "year", "records", "entities")


@query(f"WITH {RECT}, {lex_sql()}, {TOKEN_HIT}, {phrase_sql()}, b AS (SELECT record, term FROM tok UNION SELECT record, term FROM hit) SELECT entity, CAST(year AS BIGINT) AS year, term AS item, count(*) AS records FROM b JOIN rec USING (record) WHERE genre = 'en' GROUP BY ALL")
def term_entity_rollup(spark, d):
    r = plain(spark, d)
    return longs(X.entity_rollup(X.term_uses(X.match(r, lex(spark)), r), "en"), "year", "records")


FORM_SQL = "form(target, form) AS (VALUES " + ", ".join(f"('{t}', '{f}')" for t, f in FORMS) + ")"
KWIC = f"""{FORM_SQL}, spots AS (SELECT record, genre, year, toks, unnest(range(1, len(toks) + 1)) AS i FROM rec),
occ AS (SELECT record, genre, year, target, CAST(i - 1 AS BIGINT) AS pos, form, toks[greatest(i - 8, 1):least(i + 8, len(toks))] AS win FROM spots JOIN form ON form.form = toks[i]),
cls AS (SELECT *, array_to_string(win, ' ') AS t, CASE WHEN target = 'the' AND regexp_matches(array_to_string(win, ' '), '\\bof the\\b') THEN 'of'
  WHEN target = 'the' AND regexp_matches(array_to_string(win, ' '), '\\b(?:and|in) \\w+\\b') THEN 'conj'
  WHEN target = 'und' AND regexp_matches(array_to_string(win, ' '), '\\b(?:der|die|das)\\b') THEN 'art' ELSE 'unclear' END AS sense FROM occ)""".replace("\\\\", "\\")


def forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMS, "target string, form string")


def occurrences(spark, d):
    return K.classify(K.kwic(records(spark, d), forms(spark), 8), RULES)


@query(f"WITH {RECT}, {KWIC} SELECT record, target, pos, form, t AS window_text FROM cls")
def kwic_windows(spark, d):
    return longs(occurrences(spark, d).select("record", "target", "pos", "form", F.array_join("window", " ").alias("window_text")), "pos")


@query(f"WITH {RECT}, {KWIC.replace(FORM_SQL, FORM_SQL.replace('thea', 'of'))} SELECT record, target, pos, form, t AS window_text FROM cls")
def kwic_postings(spark, d):
    """Windows of other words, from postings and tokens instead of texts."""
    r = records(spark, d)
    other = spark.createDataFrame([(t, "of" if f == "thea" else f) for t, f in FORMS], "target string, form string")
    return longs(I.kwic(I.postings(r), I.tokens(r), other, 8).select("record", "target", "pos", "form", F.array_join("window", " ").alias("window_text")), "pos")


DENSE = "n AS (SELECT target, sense, year, count(*) AS n FROM cls GROUP BY ALL), dn AS (SELECT target, sense, year, coalesce(n, 0) AS n FROM (SELECT DISTINCT target, sense FROM n) CROSS JOIN (SELECT CAST(unnest(range(2000, 2010)) AS INTEGER) AS year) LEFT JOIN n USING (target, sense, year))"


@query(f"WITH {RECT}, {KWIC}, {DENSE} SELECT target, sense, CAST(year AS BIGINT) AS year, n FROM dn")
def sense_by_year(spark, d):
    return longs(K.senses_by_year(occurrences(spark, d), Y0, Y1), "year")


@query(
    f"""WITH {RECT}, {KWIC}, {DENSE}, w AS (SELECT *, sum(n) OVER (PARTITION BY target, sense ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM dn WHERE sense <> 'unclear'),
    t AS (SELECT *, sum(m) OVER (PARTITION BY target, year) AS total FROM w) SELECT target, sense, CAST(year AS BIGINT) AS year, round(CAST(m AS DOUBLE) / CAST(total AS DOUBLE), 4) AS share FROM t WHERE total >= 40"""
)
def sense_share_smoothed(spark, d):
    return longs(rounded(V.sense_shares(K.senses_by_year(occurrences(spark, d), Y0, Y1)), "share"), "year")


@query(f"WITH {RECT}, {KWIC} SELECT target, round(CAST(count(*) FILTER (sense = 'unclear') AS DOUBLE) / count(*), 4) AS unclear FROM cls GROUP BY target")
def unclear_share(spark, d):
    return rounded(V.unclear_share(K.senses_by_year(occurrences(spark, d), Y0, Y1)), "unclear")


ERAS = [("early", 2000, 2004), ("late", 2005, 2009)]


def contexts(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    return K.context_words(K.with_era(K.kwic(records(spark, d), forms(spark), 8), ERAS), forms(spark), stop, "e[nr]")


@query(
    f"""WITH {RECT}, {KWIC}, c AS (SELECT target, CASE WHEN year <= 2004 THEN 'early' ELSE 'late' END AS era, record, pos, unnest(list_distinct(win)) AS item FROM occ),
    f AS (SELECT * FROM c WHERE length(item) > 1 AND NOT regexp_full_match(item, '[0-9]+') AND NOT regexp_full_match(item, 'e[nr]') AND (target, item) NOT IN (SELECT target, form FROM form) AND item NOT IN ('of', 'and', 'in', 'is', 'der', 'die')),
    y AS (SELECT target, era, item, count(*) AS y FROM f GROUP BY ALL), n AS (SELECT target, era, sum(y) AS n FROM y GROUP BY ALL), a0 AS (SELECT target, CAST(sum(y) AS DOUBLE) AS a0 FROM y GROUP BY ALL),
    t AS (SELECT target, item, sum(y) AS tot FROM y GROUP BY ALL),
    s AS (SELECT y.target, y.era, y.item, CAST(y.y AS DOUBLE) AS y1, CAST(tot - y.y AS DOUBLE) AS y2, CAST(n AS DOUBLE) AS n1, a0 - n AS n2, tot / a0 * 500 AS a FROM y JOIN n USING (target, era) JOIN a0 USING (target) JOIN t USING (target, item) WHERE y.y >= 15),
    z AS (SELECT *, (ln((y1 + a) / (n1 + 500 - y1 - a)) - ln((y2 + a) / (n2 + 500 - y2 - a))) / sqrt(1 / (y1 + a) + 1 / (y2 + a)) AS z FROM s)
    SELECT target, era, item, CAST(y1 AS BIGINT) AS n, round(z, 3) AS z FROM z"""
)
def collocates_dirichlet(spark, d):
    y = contexts(spark, d).groupBy("target", "era", "item").agg(F.count("*").alias("y"))
    return rounded(K.log_odds(y, 500.0, ["target"], "era", 15).select("target", "era", "item", F.col("y1").alias("n"), "z"), "z", digits=3)


@query(
    f"""WITH {RECT}, {KWIC}, c AS (SELECT target, CASE WHEN year <= 2004 THEN 'early' ELSE 'late' END AS era, record, pos, unnest(list_distinct(win)) AS item FROM occ),
    f AS (SELECT * FROM c WHERE length(item) > 1 AND NOT regexp_full_match(item, '[0-9]+') AND NOT regexp_full_match(item, 'e[nr]') AND (target, item) NOT IN (SELECT target, form FROM form) AND item NOT IN ('of', 'and', 'in', 'is', 'der', 'die')),
    y AS (SELECT target, era, item, count(*) AS y FROM f GROUP BY ALL), n AS (SELECT target, era, sum(y) AS n FROM y GROUP BY ALL), a0 AS (SELECT target, CAST(sum(y) AS DOUBLE) AS a0 FROM y GROUP BY ALL),
    t AS (SELECT target, item, sum(y) AS tot FROM y GROUP BY ALL),
    s AS (SELECT y.target, y.era, y.item, CAST(y.y AS DOUBLE) AS y1, CAST(tot - y.y AS DOUBLE) AS y2, CAST(n AS DOUBLE) AS n1, a0 - n AS n2, tot / a0 * 500 AS a FROM y JOIN n USING (target, era) JOIN a0 USING (target) JOIN t USING (target, item) WHERE y.y >= 15),
    z AS (SELECT *, (ln((y1 + a) / (n1 + 500 - y1 - a)) - ln((y2 + a) / (n2 + 500 - y2 - a))) / sqrt(1 / (y1 + a) + 1 / (y2 + a)) AS z FROM s)
    SELECT target, era, rank, item, n, z FROM (SELECT target, era, item, CAST(y1 AS BIGINT) AS n, round(z, 3) AS z, row_number() OVER (PARTITION BY target, era ORDER BY round(z, 3) DESC, item DESC, y1 DESC) AS rank FROM z) WHERE rank <= 14"""
)
def collocates_top(spark, d):
    y = contexts(spark, d).groupBy("target", "era", "item").agg(F.count("*").alias("y"))
    scored = rounded(K.log_odds(y, 500.0, ["target"], "era", 15).select("target", "era", "item", F.col("y1").alias("n"), "z"), "z", digits=3)
    return longs(K.top_ranked(scored, ["target", "era"], 14), "rank").select("target", "era", "rank", "item", "n", "z")


@query(
    f"""WITH {RECT}, {KWIC}, n AS (SELECT target, CASE WHEN year <= 2004 THEN 'early' ELSE 'late' END AS era, sense, count(*) AS n FROM cls GROUP BY ALL)
    SELECT target, era, sense, coalesce(n, 0) AS n FROM (SELECT DISTINCT target, sense FROM n) CROSS JOIN (VALUES ('early'), ('late')) e(era) LEFT JOIN n USING (target, era, sense)"""
)
def sense_by_era(spark, d):
    return K.senses_by_era(occurrences(spark, d), ERAS)


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') NOT LIKE '%zzz%' AS kept, NOT regexp_matches(text, '(^(The )?In\\b)|(\\bin$)') AS not_account FROM documents")
def account_filter_whole(spark, d):
    """Which texts a name filter for accounts keeps, judged on whole texts."""
    t = table(spark, d, "documents")
    from ..functions.text import is_account

    words = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), " ")
    return t.select("doc_id", (~words.contains("zzz")).alias("kept"), (~is_account(F.col("text"), r"(^(The )?In\b)|(\bin\z)")).alias("not_account"))


@query("SELECT era, count(*) AS n FROM (SELECT 2000 + doc_id % 10 AS year FROM documents) JOIN (VALUES ('a', 2000, 2003), ('b', 2004, 2005), ('c', 2007, 2009)) e(era, lo, hi) ON year BETWEEN lo AND hi GROUP BY era")
def era_join(spark, d):
    t = table(spark, d, "documents").select((F.lit(2000) + F.col("doc_id") % 10).alias("year"))
    return K.with_era(t, [("a", 2000, 2003), ("b", 2004, 2005), ("c", 2007, 2009)]).groupBy("era").agg(F.count("*").alias("n"))


@query(f"WITH {RECT}, {lex_sql()}, {TOKEN_HIT}, {phrase_sql()}, b AS (SELECT record, term FROM tok UNION SELECT record, term FROM hit), n AS (SELECT term, count(*) AS n FROM b GROUP BY term), l(id, cat, poly) AS (VALUES " + ", ".join(f"('{t['id']}', '{t['cat']}', {str(bool(t.get('poly'))).lower()})" for t in TERMS) + "), r AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY poly, n DESC NULLS LAST, id) AS k FROM l LEFT JOIN n ON id = term) SELECT cat, count(*) AS terms, max(id) FILTER (k = 1) AS top FROM r GROUP BY cat")
def category_counts(spark, d):
    n = X.match(plain(spark, d), lex(spark)).groupBy("term").agg(F.count("*").alias("P")).withColumnRenamed("term", "item")
    return V.category_tops(lex(spark), n)


@query("SELECT 'p' || p_partkey AS id, p_name AS label FROM part WHERE lower(p_name) = 'blue rod' OR p_partkey = 7")
def term_lookup(spark, d):
    """Parts by their label in any case, and one by its id."""
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    return V.lookup(parts, "BLUE Rod").unionByName(V.lookup(parts, "p7")).distinct()


@query()
def peak_calendar(spark, d):
    r = plain(spark, d)
    u = X.term_uses(X.match(r, lex(spark)), r)
    return V.peak_calendar(A.curve(A.adoption(u, r), Y0, Y1, r.select("genre").distinct()).where("genre = 'en'"), lex(spark))


@query("SELECT doc_id, CAST(file_row_number + 1000000 AS BIGINT) AS record FROM (SELECT doc_id, row_number() OVER () - 1 AS file_row_number FROM documents)")
def provenance_key(spark, d):
    """Records keyed by shard and row; the table is shard 1, in one file or many."""
    from ..sources.tables import with_provenance

    return with_provenance(table(spark, d, "documents").select("doc_id", "_metadata"), whole=1).select("doc_id", "record")


WORDS_SQL = "w AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents), k AS (SELECT lang, w, count(*) AS n, replace(strip_accents(lower(w)), 'ß', 'ss') AS k FROM w GROUP BY lang, w)"


def _spellings(spark, d):
    t = table(spark, d, "documents")
    return t.select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("name"))


@query(f"WITH {WORDS_SQL} SELECT min(w) AS name, count(*) AS variants, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT w, k, sum(n) AS n FROM k GROUP BY w, k) GROUP BY k HAVING count(*) >= 2")
def spelling_variants(spark, d):
    """Words of the texts that differ in case and accents only, by collation."""
    from ..operators.matching import spelling_variants

    return spelling_variants(_spellings(spark, d))


@query(f"WITH {WORDS_SQL} SELECT a.w AS name, b.w AS label, CAST(a.n AS BIGINT) AS n, CAST(b.n AS BIGINT) AS m FROM k a JOIN k b ON a.k = b.k WHERE a.lang = 'fr' AND b.lang = 'es'")
def collated_match(spark, d):
    """French words that are Spanish words but for case and accents."""
    from ..operators.matching import collated_match

    n = _spellings(spark, d).groupBy("lang", "name").agg(F.count("*").alias("n"))
    other = n.where("lang = 'es'").select(F.col("name").alias("label"), F.col("n").alias("m"))
    return collated_match(n.where("lang = 'fr'").select("name", "n"), other)
