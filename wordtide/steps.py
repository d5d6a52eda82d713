"""The runnable steps: each reads shards or the tables of earlier steps under `out`, and writes its own there.

    build -> artists, songs, entity_year_item, genre_year_item, presence, active, totals, postings, tokens
    discover -> curve, summary (CSV, sorted by peak)          from build
    match_terms -> song_terms, term_genre_year, term_entity_year   from shards and build
    profiles -> terms.json, a line an item                     from match_terms
    turnover, regions, meaning, meta -> one JSON document each

Every table is a Parquet folder that later steps reopen, so a step can be run again by itself. The tables by item are laid out alike: a folder
for each genre and decade, and in it the same buckets of items, so that steps join and group them by item without an exchange and read only
the folders of their genres and years. presence has the distinct entities of every item, year and genre as bits (operators/presence): what
steps count of distinct entities they take from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .functions.arrays import half_even
from .functions.text import ACCOUNT
from .operators import adoption as A
from .operators import context as C
from .operators import corpus as K
from .operators import lexicon as X
from .operators import lifecycle as L
from .operators import people as H
from .operators import postings as B
from .operators import presence as P
from .operators import profiles as T
from .operators import regional as R
from .operators import views as V
from .sources.tables import open_laid, read_csv, read_shards, with_provenance, write_document, write_json, write_laid, write_parquet

Eras = list[tuple[str, int, int]]


def _records(spark: SparkSession, shards: str, cfg: Config, account: str) -> DataFrame:
    return K.raw(with_provenance(read_shards(spark, shards)), cfg.ingest_years, account)


def _open(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def build(spark: SparkSession, shards: str, out: str, focal: str, cfg: Config = DEFAULT, account: str = ACCOUNT) -> None:
    """artists(entity, name); songs(record, entity, genre, year, title, n_tokens); counts of the words of cfg.min_records records."""
    rows = _records(spark, shards, cfg, account)
    write_parquet(K.entities(rows), f"{out}/artists")
    songs = K.tokenise(rows.join(_open(spark, out, "artists").withColumnRenamed("name", "artist"), "artist"))
    words = f"{out}/song_words"
    write_parquet(songs.select("record", "entity", "genre", "year", "title", "n_tokens", "words", "toks"), words)  # texts are tokenised once
    songs = spark.read.parquet(words)
    write_parquet(songs.drop("words", "toks"), f"{out}/songs")
    _lay(B.postings(songs), out, "postings", cfg)
    _lay(B.tokens(songs), out, "tokens", cfg, "record")
    uses = K.uses_of(songs)
    write_parquet(K.vocabulary(uses, cfg.min_records), f"{out}/vocabulary")
    vocab = _open(spark, out, "vocabulary")
    _lay(K.entity_year_word(uses, vocab, focal).withColumn("genre", F.lit(focal)), out, "entity_year_item", cfg)
    present = _lay(P.presence(uses.join(vocab, "item", "left_semi"), "genre", "year", "item"), out, "presence", cfg)
    counts = P.counted(present, "genre", "year", "item")
    _lay(counts.select("genre", "year", "item", F.col("records").cast("int").alias("records"), F.col("entities").cast("int").alias("entities")), out, "genre_year_item", cfg)
    write_parquet(P.presence(_open(spark, out, "songs"), "genre", "year"), f"{out}/active")
    write_parquet(P.counted(_open(spark, out, "active"), "genre", "year"), f"{out}/totals")


def _lay(df: DataFrame, out: str, name: str, cfg: Config, on: str = "item") -> DataFrame:
    """Write a table by genre, year and item (or record) in the steps' layout."""
    decade = (F.floor(F.col("year") / cfg.decade) * cfg.decade).cast("int")
    return write_laid(df.withColumn("decade", decade), f"{out}/{name}", ["genre", "decade"], on, cfg.buckets)


def _laid(spark: SparkSession, out: str, name: str, cfg: Config, genre: str | None = None, years: tuple[int, int] | None = None, on: str = "item") -> DataFrame:
    """A table of _lay(), of one genre and some years, whose folders alone are read."""
    df = open_laid(spark, f"{out}/{name}", on)
    if genre is not None:
        df = df.where(F.col("genre") == genre)
    if years is not None:
        low, high = (y // cfg.decade * cfg.decade for y in years)
        df = df.where(F.col("decade").between(low, high) & F.col("year").between(*years))
    return df.drop("decade")


def discover(spark: SparkSession, out: str, focal: str, others: list[str], dictionary: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """curve of the focal genre's words, and the summary of those that get a category; returns the summary. dictionary: word."""
    counts, whole = _laid(spark, out, "genre_year_item", cfg), _open(spark, out, "totals")
    own = _laid(spark, out, "genre_year_item", cfg, focal, cfg.years)
    heavy = own.groupBy("item").agg(F.sum("entities").alias("m")).where(F.col("m") >= cfg.min_entity_years)
    only = spark.createDataFrame([(focal,)], "genre string")
    _lay(A.curve(A.rates(own.join(heavy, "item", "left_semi"), whole), *cfg.years, only), out, "curve", cfg)
    curve = _laid(spark, out, "curve", cfg)
    grown = L.growth(curve, cfg.window).drop("genre")
    emerged = L.emergence(curve, cfg.emerge, cfg.min_users)
    ratios = L.log_ratio(counts, whole, focal, others, cfg.ratio_from, cfg.ratio_add)
    label = L.category(grown, emerged, ratios).where("category is not null")
    years = curve.groupBy("item").agg(F.sum("n").cast("int").alias("total_entity_years"))
    rows = grown.join(label, "item").join(emerged.select("item", "emerged"), "item").join(ratios, "item").join(years, "item")
    known = F.lit(False)
    if dictionary is not None:
        rows = rows.join(dictionary.select(F.col("word").alias("item")).distinct().withColumn("known", F.lit(True)), "item", "left")
        known = F.coalesce("known", F.lit(False))
    summary = rows.select(
        F.col("item").alias("word"), F.col("emerged").cast("double").alias("emerged"), F.col("py").alias("peak_year"), half_even(F.col("P"), 3).alias("peak_pct"),
        half_even(F.col("now"), 3).alias("pct_now"), half_even(F.col("now_vs_peak"), 3).alias("now_vs_peak"), half_even(F.col("rise_x"), 1).alias("rise_x"),
        "total_entity_years", F.col("ratio").alias("log_ratio"), known.alias("in_dictionary"), "category",
    )
    summary.orderBy(F.desc("peak_pct"), "word").write.mode("overwrite").csv(f"{out}/summary", header=True)
    return read_csv(spark, f"{out}/summary")


def match_terms(spark: SparkSession, shards: str, out: str, lex: DataFrame, focal: str, cfg: Config = DEFAULT, account: str = ACCOUNT) -> DataFrame:
    """song_terms(record, term), its roll-ups by genre and by entity; returns strings that only the joint pattern found (m, records)."""
    rows = _records(spark, shards, cfg, account).select("record", "text")
    write_parquet(X.scan(rows, lex), f"{out}/term_scan")  # terms and warnings in one pass over the texts
    found = _open(spark, out, "term_scan")
    write_parquet(X.terms_of(found), f"{out}/song_terms")
    uses = X.term_uses(_open(spark, out, "song_terms"), _open(spark, out, "songs"))
    write_parquet(X.rollup(uses), f"{out}/term_genre_year")
    write_parquet(X.entity_rollup(uses, focal), f"{out}/term_entity_year")
    return X.warnings(found)


def _names(spark: SparkSession, out: str, focal: str, least: int) -> DataFrame:
    """name of the focal genre's entities with a real catalogue, in lower case."""
    n = _open(spark, out, "songs").where(F.col("genre") == focal).join(_open(spark, out, "artists"), "entity").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least).select("name")


def turnover(spark: SparkSession, out: str, focal: str, fame: DataFrame | None = None, blocked: str | None = None, churn_from: int = 1992, words: int = 600, cfg: Config = DEFAULT) -> None:
    """turnover.json: the pool's size, cohorts of bursts with their median courses, churn, and the highest bursts. fame: entity, sitelinks.
    Rates are those within the pool: others are neither users nor active."""
    songs = _open(spark, out, "songs").where(F.col("genre") == focal)
    pool = L.pool(songs, focal, cfg.pool_records, fame)
    spec = read_csv(spark, f"{out}/summary")
    known = spec.where("in_dictionary").select("word")
    cand = L.candidates(spec.select(F.col("word").alias("item"), F.col("log_ratio").alias("ratio")), _names(spark, out, focal, cfg.name_records), known, blocked=blocked)
    used = _laid(spark, out, "presence", cfg, focal, cfg.years).join(cand, "item", "left_semi")
    shares = A.pool_shares(used, _open(spark, out, "active").where(F.col("year").between(*cfg.years)), pool, focal)
    write_parquet(A.curve(shares, *cfg.years, spark.createDataFrame([(focal,)], "genre string")), f"{out}/pool_curve")
    curve = _open(spark, out, "pool_curve")
    write_parquet(L.bursts(curve), f"{out}/bursts")
    burst = _open(spark, out, "bursts")
    # the highest bursts only, a list of a bounded length
    top = burst.orderBy(F.desc("P"), "item").limit(words).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("P"), "item")))
    top = top.select("rank", "item", "py", half_even(F.col("P"), 2).alias("peak"), "rise", half_even(F.col("keep"), 3).alias("keep"))
    write_document(
        f"{out}/turnover.json",
        pool=pool.agg(F.count("*").alias("entities")),
        cohorts=L.cohort_facts(burst, list(cfg.cohorts)),
        courses=L.cohorts(burst, list(cfg.cohorts), cfg.offsets, cfg.min_support),
        churn=L.churn(curve, cfg.top_k, cfg.gap).where(F.col("year") >= churn_from).select("year", half_even(F.col("kept"), 3).alias("kept")),
        words=top,
    )


def regions(spark: SparkSession, out: str, focal: str, mapped: DataFrame, eras: Eras, lex: DataFrame, timed: list[str], featured: list[str], places: DataFrame, dictionary: DataFrame | None = None, blocked: str | None = None, valid_from: int = 15, cfg: Config = DEFAULT) -> None:
    """regions.json: active entities by era, each era's own words and places of every region, and how the terms of the lexicon spread
    among the timed regions. mapped: entity, region; places: place."""
    songs = _open(spark, out, "songs").where(F.col("genre") == focal)
    active = C.with_era(_open(spark, out, "active").where(F.col("genre") == focal), eras)
    uses = C.with_era(_laid(spark, out, "presence", cfg, focal, (min(e[1] for e in eras), max(e[2] for e in eras))), eras)
    found = R.distinctive(uses, active, mapped).where(~F.col("item").rlike(r"^[0-9]+\z"))
    if blocked:
        found = found.where(~F.col("item").rlike(rf"^(?:{blocked})\z"))
    names = _names(spark, out, focal, cfg.name_records)
    whole = names.select(F.col("name").alias("word"))
    if dictionary is not None:
        whole = whole.join(dictionary, "word", "left_anti")
    shown = R.split_places(found, R.place_words(places), whole.unionByName(R.name_tokens(names, dictionary)))
    some = mapped.where(F.col("region").isin(timed))
    plain = lex.where(~F.col("poly")).select(F.col("id").alias("item"))
    terms = _open(spark, out, "term_entity_year").join(F.broadcast(plain), "item", "left_semi")
    write_parquet(R.regional_arrays(terms, songs.select("entity", "year"), some, *cfg.years, valid_from), f"{out}/regional_curve")
    takeoffs = R.regional_takeoff(_open(spark, out, "regional_curve"), min_users=cfg.min_users, frac=cfg.takeoff)
    chosen = R.diffusion_choice(R.origin(takeoffs), featured)
    write_document(
        f"{out}/regions.json",
        active=P.entities_within(active, R.members(mapped), "era"),
        distinctive=shown.select("era", "region", "is_place", "rank", "item", half_even(F.col("share"), 2).alias("share"), half_even(F.col("rest"), 2).alias("rest"), half_even(F.col("z"), 1).alias("z")),
        diffusion=chosen,
        takeoffs=takeoffs.join(chosen.select("item"), "item", "left_semi").select("item", "region", "year", "established"),
    )


def meaning(spark: SparkSession, shards: str | None, out: str, focal: str, forms: DataFrame, rules: list[tuple[str, str, str]], eras: Eras, stop: DataFrame | None = None, blocked: str | None = None, prior: float = 500.0, least: int = 15, cfg: Config = DEFAULT, account: str = ACCOUNT) -> None:
    """meaning.json: occurrences of every target(target, form) by era, their collocates, and their senses by year and era. Without shards
    (and account), windows come from the postings and tokens of build, and no text is read."""
    if shards is None:
        seen = B.kwic(_laid(spark, out, "postings", cfg, focal, cfg.years), _laid(spark, out, "tokens", cfg, focal, cfg.years, "record"), forms, cfg.window)
    else:
        seen = C.kwic(_records(spark, shards, cfg, account).where((F.col("genre") == focal) & F.col("year").between(*cfg.years)), forms, cfg.window)
    write_parquet(C.classify(seen, rules), f"{out}/occurrences")
    seen = _open(spark, out, "occurrences")
    by_era = C.with_era(seen, eras)
    counts = C.context_words(by_era, forms, stop, blocked).groupBy("target", "era", "item").agg(F.count("*").alias("y"))
    scored = C.log_odds(counts, prior, ["target"], "era", least).withColumnRenamed("y1", "n")
    ruled = seen.where(F.col("target").isin([t for t, _, _ in rules]))
    write_document(
        f"{out}/meaning.json",
        occurrences=by_era.groupBy("target", "era").agg(F.count("*").alias("n")),
        collocates=C.top_ranked(scored, ["target", "era"]).select("target", "era", "rank", "item", "n", half_even(F.col("z"), 1).alias("z")),
        by_year=C.senses_by_year(ruled, *cfg.years),
        by_era=C.senses_by_era(ruled, eras),
    )


def profiles(spark: SparkSession, out: str, lex: DataFrame, focal: str, others: list[str], known: DataFrame | None = None, leagues: str = "(?!)", cfg: Config = DEFAULT) -> None:
    """terms.json: a line for each item of the lexicon that the focal genre used: label, curves of every genre, life, crossover, people and
    regions. known: entity, sitelinks, base_id, region, scene; without it nobody is notable and there are no regions. leagues: a pattern
    of the names of accounts that publish for others, none without it."""
    songs = _open(spark, out, "songs").where(F.col("year").between(*cfg.years))
    own = _open(spark, out, "songs").where(F.col("genre") == focal)
    counts = _open(spark, out, "term_genre_year").withColumnRenamed("term", "item")
    genres = spark.createDataFrame([(g,) for g in [focal, *others]], "genre string")
    curves = A.curve_arrays(A.rates(counts.join(F.broadcast(genres), "genre"), _open(spark, out, "totals")), *cfg.years, genres)
    write_parquet(curves, f"{out}/term_curve")
    curves = _open(spark, out, "term_curve")
    attrs = H.notable(H.attributes(_open(spark, out, "songs"), _open(spark, out, "artists"), focal, known), cfg.pool_records, leagues)
    uses = X.term_uses(_open(spark, out, "song_terms"), songs.where(F.col("genre") == focal), title=True)
    write_parquet(H.guard(uses, own), f"{out}/term_uses")
    uses = _open(spark, out, "term_uses")
    regions = None if known is None else known.select("entity", "region").where("region is not null")
    life = T.life(curves, focal, lex, cfg.takeoff, cfg.emerge, cfg.min_users)
    people = T.people(uses, attrs, life)
    spread = None if regions is None else T.regions(uses, songs.where(F.col("genre") == focal).select("entity", "year"), own.select("entity"), regions, *cfg.years)
    write_json(T.profiles(lex, curves, life, focal, cfg.takeoff, cfg.min_users, people, spread), f"{out}/terms.json")


def meta(spark: SparkSession, out: str, focal: str, terms: int, cfg: Config = DEFAULT) -> None:
    """meta.json: records and entities of every genre in every year, 0 where there are none, and what a page's head says."""
    write_document(f"{out}/meta.json", totals=A.dense_totals(_open(spark, out, "totals"), *cfg.years), headline=V.headline(_open(spark, out, "songs"), focal, terms))
