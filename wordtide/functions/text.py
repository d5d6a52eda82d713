"""Text: normalisation, tokens, patterns with ASCII word boundaries, windows around words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)*"
HEADER = r"\[[^\]]*\]"
#: Names that are accounts rather than entities; a parameter wherever it is used.
ACCOUNT = r"(^(Rap )?Genius\b)|(\bGenius\z)"
# Java's \b knows all letters; patterns here mean ASCII words.
WORD_START, WORD_END = r"(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])", r"(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])"
EDGE = f"(?:{WORD_START}|{WORD_END})"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with every \b outside a class meaning an edge of an ASCII word."""
    return re.sub(r"(\\.)|(\[(?:\\.|[^\]\\])*\])", lambda m: EDGE if m[0] == r"\b" else m[0], pattern)


def normalise(text: Column) -> Column:
    """Headers in brackets go, curly apostrophes become straight, lower case."""
    return F.lower(F.translate(F.regexp_replace(text, HEADER, ""), "’‘", "''"))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits with apostrophes inside; a trailing apostrophe is dropped."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_account(name: Column, pattern: str = ACCOUNT) -> Column:
    return name.rlike(ascii_edges(pattern))


def wrap_phrase(pattern: str) -> str:
    """A phrase as a pattern: spaces match any blanks, word edges around, but not behind ! or $."""
    body = pattern.replace(" ", r"\s+")
    return ascii_edges(rf"\b(?:{body})" + ("" if body.endswith(("!", "$")) else r"\b"))


def any_phrase(patterns: list[str]) -> str:
    """One pattern for what wrap_phrase() finds of any of the phrases, in their order. Phrases that begin and end with a plain word
    character share one look behind and have a short look ahead; the others keep edges of their own."""
    inner, outer = [], []
    for p in patterns:
        body = p.replace(" ", r"\s+")
        starts = re.match(r"[0-9A-Za-z_](?![?*{])", body) and "|" not in re.sub(r"\(.*?\)|\[.*?\]", "", body)
        ends = re.search(r"(?<!\\)[0-9A-Za-z_]\Z", body)
        if not starts:
            outer.append(f"(?:{wrap_phrase(p)})")
        elif ends:
            inner.append(f"{body}(?![0-9A-Za-z_])")
        else:
            inner.append(f"(?:{body})" + ("" if body.endswith(("!", "$")) else EDGE))
    # A group keeps the order of its phrases only among themselves; with both kinds, all keep edges of their own.
    if outer:
        return "|".join(f"(?:{wrap_phrase(p)})" for p in patterns)
    return rf"(?<![0-9A-Za-z_])(?:{ascii_edges('|'.join(inner))})"


def windows(toks: Column, index: Column, width: int) -> Column:
    """Tokens from width before to width behind a 0-based index, clipped at the ends."""
    lo, hi = F.greatest(index - width, F.lit(0)), F.least(index + width, F.size(toks) - 1)
    return F.slice(toks, lo + 1, hi - lo + 1)
