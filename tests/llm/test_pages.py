"""WARC round trips and URL decisions."""

import gzip
import hashlib

import pytest

from wordtide.llm.url_filters import RULES, judge_urls
from wordtide.llm.warc import _File, read_warc, warc_digest, write_warc

SCHEMA = "page_id long, url string, html string, digest string, first long, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


BIG = "é" * 60
PAGES = [(3, "http://a/1", BIG), (1, "http://a/2", BIG), (7, None, BIG), (2, "http://a b\r\nc", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "x" * 300_000), (8, "u", "y" * 100), (9, "u", "y" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99)]


def test_warc_digest_is_exact(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in warc_digest(pages(spark, PAGES).repartition(3)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    first = {}
    for p, _, h in sorted(PAGES):
        first.setdefault(h, p)
    for p, _, h in PAGES:
        data = (h or "").encode()
        revisit = len(data) >= 100 and first[h] != p
        assert got[p] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None)
    assert warc_digest(pages(spark, [])).count() == 0


def test_null_and_repeated_page_ids(spark):
    got = warc_digest(pages(spark, [(None, "u", BIG), (4, "u", BIG), (4, "u", BIG), (5, "u", BIG)])).collect()
    assert sorted((r["page_id"] or -1, r["record_type"], r["payload_bytes"]) for r in got) == [(-1, "revisit", 120), (4, "response", 120), (4, "response", 120), (5, "revisit", 120)]


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path):
    write_warc(pages(spark, PAGES).coalesce(1), str(tmp_path))
    [file] = [str(x) for x in tmp_path.iterdir() if x.name.endswith(".gz")]
    whole = read_warc(spark, file)
    assert whole.count() == len(PAGES) + 1
    one = whole.where("record_type = 'response' and record_id = '<urn:x-page:6>'")
    assert [len(r["payload"]) for r in one.collect()] == [300_000]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (record" not in plan.replace("isnotnull(record_type#", "")
    assert whole.where("record_type in ('revisit')").count() == 3
    f = _File(file)
    seen = list(f.records(lambda h: h.get("warc-record-id") == "<urn:x-page:6>"))
    assert len(seen) == len(PAGES) + 1 and f.skipped == len(PAGES)
    assert read_warc(spark, file, payload="none").where("payload is null").count() == len(PAGES) + 1


@pytest.mark.parametrize("form", ["plain", "without lengths"])
def test_other_writers_files_are_read(spark, tmp_path, form):
    write_warc(pages(spark, PAGES).coalesce(1), str(tmp_path / "a"))
    [file] = [x for x in (tmp_path / "a").iterdir() if x.name.endswith(".gz")]
    data, parts = file.read_bytes(), []
    records = gzip.decompress(data).split(b"WARC/1.1\r\n")[1:]
    for r in records:
        parts.append(b"WARC/1.1\r\n" + r if form == "plain" else gzip.compress(b"WARC/1.1\r\n" + r))
    out = tmp_path / ("b.warc" if form == "plain" else "b.warc.gz")
    out.write_bytes(b"".join(parts))
    assert sorted(tuple(r) for r in read_warc(spark, str(out)).select("record_id", "payload_bytes").collect()) == sorted(tuple(r) for r in read_warc(spark, str(file)).select("record_id", "payload_bytes").collect())


def decide(spark, rows, **options):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages(spark, rows), **options).collect()}


URLS = [
    (1, "http://x.example.net/de/1", None), (2, "HTTP://Example.NET/en/1?q#f", None), (3, "http://www.example.com/de", None), (4, "http://www.example.com/de/a", None), (5, "http://a.org/fr/x", None), (6, "http://a.org/en/x", None),
    (7, None, None), (8, "no scheme", None), (9, "http://notexample.com/de/", None), (10, "http://net", None), (11, "http://net/", None), (12, "ftp://user@H.Net:80/x", None), (13, "http://É.net/ü?x", None), (14, "http://example.net.evil.org/en/", None),
]


def test_rules_fit_hosts_and_paths(spark):
    want = {
        1: ("x.example.net", "/de/1", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"), 3: ("www.example.com", "/de", None, "allow"), 4: ("www.example.com", "/de/a", "example.com/de/", "block"),
        5: ("a.org", "/fr/x", "org/fr/", "allow"), 6: ("a.org", "/en/x", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("notexample.com", "/de/", None, "allow"), 10: ("net", "", None, "allow"),
        11: ("net", "/", "net/", "block"), 12: ("user@h.net:80", "/x", None, "allow"), 13: ("É.net", "/ü", "net/", "block"), 14: ("example.net.evil.org", "/en/", None, "allow"),
    }
    assert decide(spark, URLS) == want
    assert decide(spark, URLS, rules=spark.createDataFrame(RULES, "host string, path string, action string")) == want
    assert decide(spark, []) == {}


def test_blocks_spread_over_aliases_and_allows_stop_them(spark):
    link = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head>'
    rows = [
        (1, "http://a.org/en/1", link("http://bad.net/x")), (2, "http://b.org/en/1", '<meta http-equiv="Refresh" content="0; url=http://a.org/en/1#top">'), (3, "http://c.org/en/1", link("/2")), (4, "http://c.org/2", "<a href='http://bad.net/'>"),
        (5, "http://d.org/en/1", link("http://bad.net/y")), (6, "http://d.org/en/1", link("http://example.net/en/ok")), (7, "http://e.org/fr/1", link("http://bad.net/z")), (8, "http://f.org/en/1", "<!-- " + link("http://bad.net/q") + " -->"), (9, "http://g.org/x/y", link("z")), (10, "http://g.org/x/z", link("//bad.net/w")),
    ]
    got = {k: v[3] for k, v in decide(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block"}
    extra = spark.createDataFrame([("http://h.org/1", "http://bad.net/h")], "from_url string, to_url string")
    assert decide(spark, [(1, "http://h.org/1", None)], redirects=extra)[1][3] == "block"


def test_members_of_any_size_without_lengths(tmp_path):
    """Incompressible payloads whose members end all around the sizes that are read at once."""
    import random

    from wordtide.llm import warc

    r, records = random.Random(1), []
    for k, size in enumerate([*range(8_000, 40_000, 1_500), *range(16_200, 16_500, 20), 0, 1, 300_000]):
        body = r.randbytes(size)
        records.append((k, body, b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n" % (k, size) + body + b"\r\n\r\n"))
    out = tmp_path / "others.warc.gz"
    out.write_bytes(b"".join(gzip.compress(x) for _, _, x in records))
    for keep in (lambda h: True, lambda h: False, lambda h: h["warc-record-id"].endswith("7>")):
        got = list(warc._File(str(out)).records(keep))
        assert [h["warc-record-id"] for h, _ in got] == [f"<urn:x:{k}>" for k, _, _ in records]
        assert all(c == (b if keep(h) else None) for (h, c), (_, b, _) in zip(got, records, strict=True))
    for bad in (b"no archive at all", gzip.compress(b"neither this"), gzip.compress(records[0][2])[:5000], b"WARC/1.0\r\nContent-Length: x\r\n\r\n"):
        out.write_bytes(bad)
        with pytest.raises(ValueError, match="others.warc.gz"):
            list(warc._File(str(out)).records(lambda h: True))
