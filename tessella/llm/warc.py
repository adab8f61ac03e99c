"""WARC archives with payload de-duplication, and their merged capture index.

Writing: of the records with equal payloads (SHA-1 of at least `least` bytes)
the one with the largest page_id is a response, the others are revisits that
refer to it. Each task writes its records as gzip members into archives of
about ARCHIVE bytes; a row (archive, content) is one archive, so any store that
Spark can write holds them, and `export` copies them out as .warc.gz files.

Reading: an archive is parsed record by record (payload digests are checked),
and its captures, sorted by (URL key, time, page), are one run of the index.
The runs are cut by range, and the runs in a range are merged by a tournament
of losers, so the index is in one global order and one URL's captures are its
history. A URL with any number of captures is cut by time.

Defined cases: null html is an empty payload, a null url an empty one; line
breaks in URLs are percent-encoded; a null page_id is a response of its own and
is not referred to; repeated rows with the largest page_id of their payload are
all responses; empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import spread as S

ARCHIVE = 4 << 20
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
PAGE = "urn:tessella:page:"


def url_key(url: str) -> str:
    """Sort-friendly URL: host labels reversed, no scheme, no www, no default port, no fragment, all lower case."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]*)(?::(\d*))?([^#]*)", url.strip(), re.S)
    host, port, rest = m[1].lower(), m[2], m[3] or "/"
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in (None, "", "80", "443") else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (rest if rest.startswith("/") else f"/{rest}").lower()


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha1 hex, refers_to) of the pages whose payload a later page also has."""
    html = F.coalesce(F.col("html"), F.lit(""))
    x = pages.where("page_id is not null").where(F.octet_length(html) >= least).select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("_sha"))
    last = S.cut(x.groupBy("_sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return x.join(last, "_sha").where("page_id < refers_to").distinct()


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def record(page: int | None, url: str, payload: bytes, refers: int | None) -> bytes:
    """One record as bytes."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    when = EPOCH + timedelta(seconds=(page or 0) % 10**9)
    block = b"" if refers is not None else http_block(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{PAGE}{'' if page is None else page}>",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <{PAGE}{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """(archive, content): all pages as WARC archives."""
    html = F.coalesce(F.col("html"), F.lit(""))
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("_sha"))
    x = x.join(revisits(pages, least), ["page_id", "_sha"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.gz"]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page, url, text, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                member = gzip_member(record(page, url, text.encode(), refers))
                held.append(member)
                size += len(member)
                if size >= ARCHIVE:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return S.map_arrow(x, write, "archive string, content binary")


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, block) of each record of an archive."""
    view, at = memoryview(content), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        out, to, step = [], at, 1 << 14
        while not z.eof:
            if to >= len(view):
                raise ValueError("a record of the archive is cut short")
            out.append(z.decompress(view[to : to + step]))
            to += step
            step = min(2 * step, 1 << 22)
        size = min(to, len(view)) - at - len(z.unused_data)
        data = b"".join(out)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield at, size, fields, rest[: int(fields["content-length"])]
        at += size


CAPTURE = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def captures(archive: str, content: bytes) -> list[tuple]:
    """The captures of an archive in the order of the index."""
    rows = []
    page = lambda x: int(x[len(PAGE) + 1 : -1]) if x and x[len(PAGE) + 1 : -1] else None
    for offset, size, head, block in parse(content):
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        n = int(head["x-payload-length"])
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{archive}: the payload at {offset} doesn't match its digest")
        rows.append((url_key(head.get("warc-target-uri", "")), head["warc-date"], page(head["warc-record-id"]), n, digest, kind, page(head.get("warc-refers-to", "")), archive, offset, size))
    return sorted(rows, key=order)


def order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8]


def runs(files: DataFrame) -> DataFrame:
    """The captures of all archives; those of one archive are a sorted run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield as_batch(captures(archive, content.as_py()))

    return S.map_arrow(files.select("archive", "content"), read, CAPTURE)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in CAPTURE.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], NAMES)


class LoserTree:
    """k-way merge: inner nodes hold losers, so the next row costs one comparison a level."""

    def __init__(self, sorted_runs: list[list[tuple]]):
        self.runs = [iter(r) for r in sorted_runs]
        k = len(self.runs)
        self.k = k
        self.head = [next(r, None) for r in self.runs]
        self.key = [None if h is None else order(h) for h in self.head]
        self.tree = [-1] * k  # tree[0]: the winner
        for i in range(k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        if self.key[a] is None:
            return False
        return self.key[b] is None or (self.key[a], a) < (self.key[b], b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # first one here while building: waits for its rival
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.key[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            self.key[i] = None if self.head[i] is None else order(self.head[i])
            self._replay(i)


def index(found: DataFrame) -> DataFrame:
    """All captures in one order: partitions are ranges of (url_key, captured_at, page_id), merged within."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(row[7], []).append(row)
        out: list[tuple] = []
        for row in LoserTree([sorted(r, key=order) for r in held.values()]):  # a run that came in order is only looked through
            out.append(row)
            if len(out) == 8192:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    n = S.parts(found.sparkSession)
    return found.repartitionByRange(n, "url_key", "captured_at", "page_id").mapInArrow(merge, CAPTURE)


def export(files: DataFrame, folder: str) -> int:
    """Write the archives as files of a folder that all executors share; the number of files."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with open(f"{folder}/.{name}", "wb") as f:
                    f.write(content.as_buffer())
                os.replace(f"{folder}/.{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return S.map_arrow(files, put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def history(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages, read the archives back, and merge their index."""
    files = S.cut(archives(pages, least))
    return index(S.cut(runs(files)))
