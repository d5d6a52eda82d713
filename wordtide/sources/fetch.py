"""Fetchers of external knowledge bases, outside the engine: they run on the driver and leave tables that the operators read.

Transport is a parameter (request -> (status, text, headers)), so that tests and offline runs need no network."""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

Transport = Callable[[str, bytes | None, dict], tuple[int, str, dict]]
RETRY = {429, 500, 502, 503, 504}


def http(url: str, body: bytes | None, headers: dict) -> tuple[int, str, dict]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers), timeout=90) as r:
            return r.status, r.read().decode(), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace"), dict(e.headers)


@dataclass(frozen=True)
class Retry:
    """What is tried again, how often, and after how many seconds, unless the server names a time."""

    statuses: frozenset[int] = frozenset(RETRY)
    attempts: int = 6
    first: float = 5.0
    factor: float = 2.0

    def pauses(self):
        """Seconds before each further attempt."""
        return (self.first * self.factor**k for k in range(self.attempts - 1))


@dataclass(frozen=True)
class Split:
    """How ids are dealt into requests: `size` at once; a request that fails is cut in two while it has more than `least`."""

    size: int
    least: int

    def deal(self, ids: Iterable[str]) -> list[list[str]]:
        known = sorted(set(ids), key=lambda q: (len(q), q))
        return [known[i : i + self.size] for i in range(0, len(known), self.size)]

    def cut(self, ids: list[str]) -> list[list[str]]:
        """Nothing where it is given up."""
        half = len(ids) // 2
        return [ids[:half], ids[half:]] if len(ids) > self.least else []


@dataclass(frozen=True)
class Term:
    """A bound value of a result set: its text, whether it names something, and its language."""

    text: str
    is_uri: bool = False
    lang: str | None = None

    @classmethod
    def read(cls, raw: dict) -> Term:
        return cls(raw["value"], raw["type"] == "uri", raw.get("xml:lang"))

    def columns(self, name: str, prefix: str) -> dict[str, str]:
        short = self.is_uri and prefix and self.text.startswith(prefix)
        own = {name: self.text.rpartition("/")[2] if short else self.text}
        return own if self.lang is None else own | {f"{name}_lang": self.lang}


@dataclass
class Cache:
    """Answers as files that are named by a SHA-1 of kind, tag and request."""

    folder: Path

    def file(self, kind: str, request: str, tag: str) -> Path:
        name = hashlib.sha1("\n".join((kind, tag, request)).encode()).hexdigest()
        return self.folder / kind / f"{name}.json"

    def load(self, file: Path):
        """None for what isn't there; a file that is no JSON goes."""
        if file.is_file():
            with contextlib.suppress(ValueError):
                return json.loads(file.read_text())
            file.unlink()
        return None

    def store(self, file: Path, answer) -> None:
        file.parent.mkdir(parents=True, exist_ok=True)
        part = file.with_suffix(".part")
        part.write_text(json.dumps(answer))
        part.replace(file)


@dataclass
class Fetcher:
    cache: Cache
    transport: Transport = http
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    retry: Retry = Retry()
    cached_only: bool = False
    gap: float = 0.0  # seconds between two requests, at least
    _last: float = field(default=float("-inf"), repr=False)

    def fetch(self, kind: str, request: str, url: str, body: bytes | None = None, headers: dict | None = None, tag: str = "", busy: Callable[[str], bool] = lambda _: False):
        """Parsed JSON; {"_status": 404} for what isn't there, which is cached too; None with cached_only and no entry."""
        file = self.cache.file(kind, request, tag)
        answer = self.cache.load(file)
        if answer is None and not self.cached_only:
            answer = self._ask(url, body, headers or {}, busy)
            self.cache.store(file, answer)
        return answer

    def _ask(self, url: str, body: bytes | None, headers: dict, busy: Callable[[str], bool]):
        pauses = self.retry.pauses()
        while True:
            if (wait := self.gap - (self.clock() - self._last)) > 0:
                self.sleep(wait)
            self._last = self.clock()
            status, text, got = self.transport(url, body, headers)
            if status == 404:
                return {"_status": 404}
            if status not in self.retry.statuses and not busy(text):
                if status >= 400:
                    raise OSError(f"{url}: {status}")
                return json.loads(text)
            pause = next(pauses, None)
            if pause is None:
                raise OSError(f"{url}: {status}")
            self.sleep(float(got.get("Retry-After", pause)))

    def sparql(self, endpoint: str, query: str, tag: str, prefix: str = "") -> list[dict[str, str]]:
        """Rows of strings: entities below prefix as their ids, languages as <name>_lang."""
        headers = {"Accept": "application/sparql-results+json"}
        answer = self.fetch("sparql", query, endpoint, urllib.parse.urlencode({"query": query}).encode(), headers, tag) or {}
        bound = answer.get("results", {}).get("bindings", [])
        return [{c: x for name, raw in row.items() for c, x in Term.read(raw).columns(name, prefix).items()} for row in bound]

    def sparql_in_batches(self, endpoint: str, template: str, ids: Iterable[str], tag: str, prefix: str = "", size: int = 400, least: int = 25) -> tuple[list[dict[str, str]], list[str]]:
        """Rows of template with {values} filled in, request by request, and the ids of requests that were given up."""
        rows: list[dict[str, str]] = []
        lost: list[str] = []
        split = Split(size, least)
        waiting = deque(split.deal(ids))
        while waiting:
            some = waiting.popleft()
            named = " ".join(f"wd:{x}" for x in some)
            try:
                rows.extend(self.sparql(endpoint, template.replace("{values}", named), tag, prefix))
            except (OSError, ValueError):
                smaller = split.cut(some)
                waiting.extendleft(reversed(smaller))
                lost.extend([] if smaller else some)
        return rows, lost

    def wiki(self, api: str, params: dict[str, str], tag: str):
        """A wiki API call that waits while the servers lag."""
        params = params | {"format": "json", "formatversion": "2", "maxlag": "5"}
        return self.fetch("wiki", json.dumps(params, sort_keys=True), f"{api}?{urllib.parse.urlencode(params)}", tag=tag, busy=lambda t: "maxlag" in t[:200])


def lucene_escape(text: str) -> str:
    out = "".join(f"\\{c}" if c in '+-!(){}[]^"~*?:\\/' else c for c in text)
    return out.replace("&&", r"\&&").replace("||", r"\||")


def search_url(base: str, name: str, limit: int = 5) -> str:
    return f"{base}/artist/?query=artist:%22{urllib.parse.quote(lucene_escape(name))}%22&fmt=json&limit={limit}"
