"""A lexicon as one automaton: spellings in a hash table, literal phrases in a trie of pieces, and only real patterns as patterns.

find() gives what one alternation of all phrases would find from left to right - at each place the first phrase in order that matches, and
then on behind it - but walks the trie from the pieces at hand, so its cost doesn't grow with the number of literal phrases."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .text import TOKEN, any_phrase, ascii_edges, wrap_phrase

#: What a text is cut into: words, and other characters one by one; blanks lie between.
PIECE = re.compile(r"[0-9A-Za-z_]+|[^\s0-9A-Za-z_]", re.ASCII)
WORD = re.compile(TOKEN, re.ASCII)
LITERAL = re.compile(r"[0-9A-Za-z_](?:[0-9A-Za-z_' ]*[0-9A-Za-z_])?", re.ASCII)
#: Strings of patterns whose terms are remembered.
REMEMBERED = 1 << 16


def _gaps(spans: list[tuple[int, int]], i: int, n: int) -> tuple[bool, ...]:
    """Whether blanks lie before each of n pieces from i on but the first."""
    return tuple(spans[k][0] > spans[k - 1][1] for k in range(i + 1, i + n))


def _scanned(pattern: str) -> str:
    """wrap_phrase() for a search from left to right: a pattern that begins with a plain character does so here too, and looks back from
    behind it, so that the search can skip to that character."""
    wrapped, body = wrap_phrase(pattern), pattern.replace(" ", r"\s+")
    if not re.match(r"[0-9A-Za-z_](?![?*+{])", body) or "|" in re.sub(r"\(.*?\)|\[.*?\]", "", body):
        return f"(?:{wrapped})"
    end = wrapped[wrapped.index(f"(?:{ascii_edges(body)})") + len(f"(?:{ascii_edges(body)})") :]
    return f"{body[0]}(?<![0-9A-Za-z_]{body[0]}){ascii_edges(body[1:])}{end}"


class Matcher:
    """terms: (id, spellings, phrases) in the order of their ids, which is the order in which phrases are tried."""

    def __init__(self, terms: Iterable[tuple[str, list[str], list[str]]]):
        self.spelled: dict[str, set[str]] = {}
        self.root: dict = {}
        self.size: list[int] = []  # pieces of each literal phrase, by number; 0 for patterns
        self.text: list[str] = []
        self.of: list[set[str]] = []
        self.patterns: list[tuple[int, re.Pattern]] = []
        seen: dict[str, int] = {}
        for term, tokens, phrases in terms:
            for w in tokens:
                self.spelled.setdefault(w, set()).add(term)
            for p in phrases:
                if p in seen:
                    self.of[seen[p]].add(term)
                    continue
                seen[p] = len(self.of)
                self.of.append({term})
                self.text.append(p)
                if LITERAL.fullmatch(p) and "  " not in p:
                    spans = [m.span() for m in PIECE.finditer(p)]
                    self.size.append(len(spans))
                    node = self.root
                    for a, b in spans:
                        node = node.setdefault(p[a:b], {})
                    node.setdefault(None, {})[_gaps(spans, 0, len(spans))] = seen[p]
                else:
                    self.size.append(0)
                    self.patterns.append((seen[p], re.compile(wrap_phrase(p), re.ASCII)))
        self.joint = re.compile("|".join(_scanned(self.text[k]) for k, _ in self.patterns), re.ASCII) if self.patterns else None
        self.within: dict[int, frozenset[str]] = {}
        self.remembered: dict[str, frozenset[str]] = {}

    def _literals(self, text: str, pieces: list[str], i: int, spans: list) -> list[int]:
        """All literal phrases that the pieces from i on begin with. spans: of the pieces, filled in when first needed."""
        node, out, j = self.root.get(pieces[i]), [], i + 1
        while node is not None:
            if None in node:
                if j - i > 1 and not spans:
                    spans += [m.span() for m in PIECE.finditer(text)]
                number = node[None].get(_gaps(spans, i, j - i))
                if number is not None:
                    out.append(number)
            node = node.get(pieces[j]) if j < len(pieces) else None
            j += 1
        return out

    def _pattern(self, match: re.Match) -> int:
        """Which pattern the joint one found."""
        return next(number for number, p in self.patterns if p.match(match.string, match.start()))

    def terms_in(self, text: str) -> frozenset[str]:
        """Terms of all phrases that are anywhere in a string."""
        pieces, spans, out = PIECE.findall(text), [], set()
        for i in range(len(pieces)):
            for number in self._literals(text, pieces, i, spans):
                out |= self.of[number]
        for number, p in self.patterns:
            if not self.of[number] <= out and p.search(text):
                out |= self.of[number]
        return frozenset(out)

    def _known(self, found: str) -> frozenset[str]:
        if found not in self.remembered:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[found] = self.terms_in(found)
        return self.remembered[found]

    def find(self, text: str) -> tuple[set[str], set[str]]:
        """Terms of the strings that the phrases find in a text together, and strings of which no single phrase knows."""
        out: set[str] = set()
        unknown: set[str] = set()
        pieces = PIECE.findall(text) if self.root else []
        spans: list[tuple[int, int]] = []
        literals = []  # (piece, first in order of those that match there)
        for i, p in enumerate(pieces):
            if p in self.root and (here := self._literals(text, pieces, i, spans)):
                literals.append((i, min(here)))
        if self.joint is None:
            skip = 0
            for i, number in literals:
                if i >= skip:
                    out |= self._within(number)
                    skip = i + self.size[number]
            return out, unknown
        if literals and not spans:
            spans = [m.span() for m in PIECE.finditer(text)]
        at, k, match = 0, 0, self.joint.search(text)
        while match or k < len(literals):
            if k < len(literals) and spans[literals[k][0]][0] < at:
                k += 1
                continue
            begin = spans[literals[k][0]][0] if k < len(literals) else len(text) + 1
            if match and (match.start() < begin or match.start() == begin and self._pattern(match) < literals[k][1]):
                known = self._known(match[0])
                out |= known
                if not known:
                    unknown.add(match[0])
                at = max(match.end(), match.start() + 1)
            else:
                i, number = literals[k]
                out |= self._within(number)
                at = spans[i + self.size[number] - 1][1]
            if match and match.start() < at:
                match = self.joint.search(text, at)
        return out, unknown

    def _within(self, number: int) -> frozenset[str]:
        if number not in self.within:
            self.within[number] = self.terms_in(self.text[number])
        return self.within[number]

    def spellings(self, text: str) -> set[str]:
        """Terms of the words of a text."""
        hit = self.spelled.keys() & set(WORD.findall(text)) if self.spelled else ()
        return set().union(*[self.spelled[w] for w in hit])


def plainly(terms: list[tuple[str, list[str], list[str]]], text: str) -> set[str]:
    """What find() must give, by one alternation; for tests."""
    phrases = [(t, p) for t, _, ps in terms for p in ps]
    found = {m[0] for m in re.finditer(any_phrase([p for _, p in phrases]), text, re.ASCII)} if phrases else set()
    return {t for t, p in phrases for m in found if re.search(wrap_phrase(p), m, re.ASCII)}
