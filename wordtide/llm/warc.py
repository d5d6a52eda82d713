"""WARC files: a writer, and a PySpark Python data source that reads them.

Archives are members of gzip, one a record, whose header carries the record's compressed length ("sl" extra field), so a reader parses
a record's header from its first bytes and, if filters don't want it, steps over the payload without decoding it. Files without that
field, and plain ones, are read too. The source plans one partition a file and takes equality and IN filters on record type and headers
(with spark.sql.python.filterPushdown.enabled)."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import scratch, spill
from .files import list_files, make_folder, open_read, open_write

LEAST_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = 1 << 14
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_type string, headers map<string, string>, payload binary, payload_bytes long, file string"
_FIELDS = {"record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}


def member(record: bytes, level: int) -> bytes:
    """One gzip member with the skip lengths of the record."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl\x08\x00" + size.to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 6) -> DataFrame:
    """One record a row of pages, payload the html in UTF-8 (null: empty); returns the manifest (part, uri, records).

    Of records with equal payloads of at least LEAST_SHARED bytes, those of the smallest page_id are responses and the others revisit
    it. Every attempt of a task writes files of its own name, and the manifest lists those of attempts that ended well, so a half-written
    file is never read, on any store. A null url gives a record without one; a null page_id a random record id; repeated rows are records
    each on its own; an empty table gives an empty manifest; other columns are not read."""
    make_folder(folder)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    # Digests of more than one row, with the smallest id: combined before the shuffle, and a table of its own, so that the join below
    # can split a hot digest.
    firsts = rows.where(F.octet_length("html") >= LEAST_SHARED).groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = spill(firsts, "warc-firsts")
    rows = rows.withColumn("digest", digest).join(firsts, "digest", "left")

    def write(batches):
        part, n, out = TaskContext.get().partitionId(), 0, None
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for digest, page, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = open_write(uri)
                    info = member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nformat: WARC File1.1\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode()), level)
                    out.write(info)
                revisit = first is not None and (page is None or page > first)
                out.write(member(record("revisit" if revisit else "response", page_urn(page), url, html.encode(), digest, page_urn(first) if revisit else None), level))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "uri": pa.array([uri]), "records": pa.array([n])})

    return spill(rows.select("digest", "page_id", "url", "html", "first").mapInArrow(write, "part long, uri string, records long"), "warc-manifest")


class _File:
    """A file of records, read forwards; .skipped counts payloads that were never decoded."""

    def __init__(self, uri: str):
        self.uri, self.f, self.skipped = uri, open_read(uri), 0
        self.gz = self.f.read(2) == b"\x1f\x8b"
        self.f.seek(0)

    def records(self, wanted):
        """(headers, content or None): wanted(headers) tells whether to decode the content."""
        return self._members(wanted) if self.gz else self._plain(wanted)

    def _plain(self, wanted):
        at = 0
        while True:
            self.f.seek(at)
            head = b""
            while b"\r\n\r\n" not in head and (more := self.f.read(HEAD)):
                head += more
            if not head.strip():
                return
            lead = len(head) - len(head.lstrip(b"\r\n"))
            while b"\r\n\r\n" not in head[lead:] and (more := self.f.read(HEAD)):
                head += more
            headers, end = self._head(head[lead:], at)
            end += lead
            size = int(headers["content-length"])
            content = None
            if wanted(headers):
                self.f.seek(at + end)
                content = self.f.read(size)
            else:
                self.skipped += 1
            yield headers, content
            at += end + size + 4

    def _head(self, data: bytes, at: int) -> tuple[dict[str, str], int]:
        """Headers and their size; an error that names the place where there is no record."""
        cut = data.find(b"\r\n\r\n") + 4
        headers = _parse(data[:cut])
        size = headers.setdefault("content-length", "0")
        if cut < 4 or not headers["version"].startswith("WARC/") or not size.isdigit():
            raise ValueError(f"{self.uri} has no record at byte {at}")
        return headers, cut

    def _members(self, wanted):
        at, end = 0, self.f.seek(0, 2)
        while at < end:
            self.f.seek(at)
            raw = self.f.read(HEAD)
            if raw[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"{self.uri} has no record at byte {at}")
            start, size = _gzip_start(raw)
            inflate, got = zlib.decompressobj(-15), b""
            feed, fed = raw[start:], len(raw) - start  # fed: bytes of deflated data read so far
            while b"\r\n\r\n" not in got and not inflate.eof:
                got += inflate.decompress(feed, HEAD)
                feed = inflate.unconsumed_tail
                if not feed and not inflate.eof:
                    feed = self.f.read(HEAD)
                    fed += len(feed)
                    if not feed:
                        raise ValueError(f"{self.uri} ends within the record at byte {at}")
            headers, cut = self._head(got, at)
            if not wanted(headers) and size:
                self.skipped += 1
                yield headers, None
                at += size
                continue
            parts = [got]
            while not inflate.eof:
                parts.append(inflate.decompress(feed))
                if not inflate.eof:
                    feed = self.f.read(1 << 18)
                    fed += len(feed)
                    if not feed:
                        raise ValueError(f"{self.uri} ends within the record at byte {at}")
            content = b"".join(parts)[cut:]
            yield headers, content[: int(headers.get("content-length", 0))] if wanted(headers) else None
            if size:
                at += size
            else:  # behind what the inflater took, and the checksum and length
                at += start + fed - len(inflate.unused_data) + 8


def _gzip_start(raw: bytes) -> tuple[int, int]:
    """Where the deflated data of a member begins, and the member's length if it is given."""
    flags, at, size = raw[3], 10, 0
    if flags & 4:
        n = int.from_bytes(raw[at : at + 2], "little")
        extra, at = raw[at + 2 : at + 2 + n], at + 2 + n
        while len(extra) >= 4:
            m = int.from_bytes(extra[2:4], "little")
            if extra[:2] == b"sl":
                size = int.from_bytes(extra[4:8], "little")
            extra = extra[4 + m :]
    for bit in (8, 16):
        if flags & bit:
            at = raw.index(b"\x00", at) + 1
    return at + (2 if flags & 2 else 0), size


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def payload_of(content: bytes, headers: dict[str, str]) -> bytes:
    """Of an HTTP message, what follows its header."""
    if headers.get("content-type", "").startswith("application/http"):
        return content.partition(b"\r\n\r\n")[2]
    return content


class WarcPartition(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.options, self.names = options, schema.fieldNames()
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name == "record_type" or name in _FIELDS:
                self.tests.append((_FIELDS.get(name, "warc-type"), frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self):
        if "files" in self.options:
            return [WarcPartition(u) for u in self.options["files"].split("\n") if u]
        return [WarcPartition(u) for u in list_files(self.options["path"], self.options.get("suffix", ""))]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) in v for k, v in self.tests)

    def read(self, partition):
        if partition is None:  # how Spark asks a source without partitions
            return
        keep = self.options.get("payload", "full")
        rows, size = [], 0
        for headers, content in _File(partition.value).records(lambda h: self.wanted(h) and keep != "none"):
            if not self.wanted(headers):
                continue
            body = payload_of(content, headers) if content is not None else None
            digest = headers.get("warc-payload-digest")
            if keep == "digest" and body is not None:  # computed, not believed
                digest = f"sha256:{hashlib.sha256(body).hexdigest()}" if headers.get("warc-type") != "revisit" else digest
            row = {"record_type": headers.get("warc-type"), "headers": list(headers.items()), "payload": body if keep == "full" else None, "payload_bytes": len(body) if body is not None else None, "file": partition.value, **{k: headers.get(v) for k, v in _FIELDS.items()}, "payload_digest": digest}
            rows.append(row)
            size += len(body or b"")
            if len(rows) >= 2000 or size > 16 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        kinds = {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names})


class WarcSource(DataSource):
    """spark.read.format("warc"), options: path (a file or folder), suffix of file names, payload: full, digest (hashed while it is
    read, not returned) or none (never decoded)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)


def read_warc(spark: SparkSession, path: str, payload: str = "full", suffix: str = "", manifest: DataFrame | None = None) -> DataFrame:
    """The records of a file or of all files of a folder, of one file each task; with a manifest of write_warc, of the files that it lists.
    What is no record is an error that names the file and the byte. Absent headers are null; a folder without files is empty."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", payload).option("suffix", suffix)
    if manifest is not None:  # a row a file; the list is read where partitions are planned
        reader = reader.option("files", "\n".join(sorted(r[0] for r in manifest.select("uri").collect())))
    return reader.load(path)


def warc_digest(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write pages as WARC and digest what is read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Ties: all rows of the smallest page_id of a payload are responses. A null html is empty; a null page_id can't be revisited and
    comes back as null; repeated rows are records each on its own; an empty table gives an empty result; other columns are not read."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    manifest = write_warc(pages, folder, **options)
    records = read_warc(spark, folder, payload="digest", manifest=manifest).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    number_or_null = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rows = spill(records.select(number_or_null("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number_or_null("refers_to").alias("refers_to")), "warc-read")
    # A revisit has no payload of its own: its length is that of the response it names.
    sizes = rows.where("record_type = 'response' and page_id is not null").join(rows.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    sizes = spill(sizes.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes")), "warc-sizes")
    return rows.join(sizes, ["refers_to", "payload_digest"], "left").select("page_id", F.when(F.col("record_type") == "revisit", F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
