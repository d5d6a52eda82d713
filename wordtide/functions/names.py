"""Names and places: folding of names, great circles, parsing of points, codes and years."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _squeezed(s: pd.Series) -> pd.Series:
    """Compatibility form in folded case, blanks squeezed."""
    return s.str.normalize("NFKC").str.casefold().str.replace(r"\s+", " ", regex=True).str.strip()


def _letters(s: pd.Series) -> pd.Series:
    """Letters and digits of the folded, decomposed name: accents and punctuation go, an ampersand is a word."""
    return s.str.casefold().str.normalize("NFKD").str.replace("&", "and", regex=False).str.replace(r"[\W_]+", "", regex=True)


def _letters_of_dollars(s: pd.Series) -> pd.Series:
    return _letters(s.str.replace("$", "s", regex=False))


KEYS = {"exact": _squeezed, "plain": _letters, "dollar": _letters_of_dollars}


def keyed(name: Column, kind: str) -> Column:
    """A key that spellings of one name share, by kind: "exact" (case, width and blanks folded), "plain" (letters and digits only) or
    "dollar" (plain, with $ for s). Unicode folding has no native expression, so a batch of names goes through vectorised string methods."""
    fold = KEYS[kind]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return fold(s)

    return run(name)


def exact_key(name: str) -> str:
    return _squeezed(pd.Series([name], dtype=object))[0]


def plain_key(name: str) -> str:
    return _letters(pd.Series([name], dtype=object))[0]


def dollar_key(name: str) -> str:
    return _letters_of_dollars(pd.Series([name], dtype=object))[0]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along the great circle."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def point(wkt: Column) -> Column:
    """struct(lat, lon) of "Point(lon lat)"; null for other text, such as points on other globes."""
    rx = r"^Point\(([-\d.eE]+) ([-\d.eE]+)\)"
    part = lambda i: F.nullif(F.regexp_extract(wkt, rx, i), F.lit("")).cast("double")
    return F.when(wkt.rlike(rx) & ~wkt.contains("<"), F.struct(part(2).alias("lat"), part(1).alias("lon")))


def year_of(date: Column) -> Column:
    """The year of a partial date such as 1987-00-00 or -0044-03-15."""
    return F.nullif(F.regexp_extract(date, r"^(-?\d{1,4})-", 1), F.lit("")).cast("int")


def entity_id(uri: Column) -> Column:
    return F.when(uri.rlike(r"^https?://www\.wikidata\.org/"), F.substring_index(uri, "/", -1)).otherwise(uri)


def subdivision(codes: Column) -> Column:
    """The first code of the form XX-YYY of an array."""
    return F.get(F.filter(codes, lambda x: x.rlike(r"^[A-Z]{2}-[A-Z0-9]{1,3}\z")), F.lit(0))


def infobox_field(wikitext: Column, field: str) -> Column:
    """A field of an infobox as plain text: comments, references, tags and link targets dropped."""
    raw = F.regexp_extract(wikitext, rf"(?is)\|\s*{field}\s*=\s*(.*?)(?=\n\s*\||\n\s*\}}\}}|\z)", 1)
    text = F.regexp_replace(raw, r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref.*?</ref>", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", ", ")
    text = F.regexp_replace(text, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    text = F.regexp_replace(text, r"<[^>]*>|\{\{[^}]*\}\}|'{2,}", "")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def collated(name: Column, collation: str = "UNICODE_CI_AI") -> Column:
    """A name that equals all its spellings in other case and with other accents, for grouping, joining and comparing; it keeps its own
    spelling. Unlike folded names it needs no Python, and no second column: Spark compares and hashes by the collation."""
    return F.collate(F.trim(name), collation)
