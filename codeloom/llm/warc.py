"""WARC archives with records compressed one by one under a dictionary in a leading skippable frame.

Each task writes its pages to archives of about `ARCHIVE_BYTES`: the first records of
an archive (at most `SAMPLE_BYTES`) train a Zstandard dictionary, which is stored in a
skippable frame (magic 0x184D2A5D) at the archive's start; each record is a frame of
its own, so one can be read without the others. A task names its archives at random
and returns them as manifest rows; only archives in a finished task's manifest are
read, so a lost executor or a second attempt leaves at most an unread file.

Records with equal payloads of `MIN_REVISIT` bytes or more: the one with the smallest
id is a response, the others are revisits that name its page and address and hold no
payload. Record ids are random, so repeated rows have their own; the page's id is a field.
Frames have checksums and payloads are compared with their digests when they are read.

Defined results: a null html is an empty payload; a null url is written empty; repeated
rows each give a record; among rows with the smallest id all are responses; a null
id is never the one referred to unless the group has no other, and then its group is
all responses; an empty table gives no rows and no archives.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import KeyFilter, materialize, scratch_dir

ARCHIVE_BYTES = 64 << 20  # of payload, before compression
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
MIN_REVISIT = 100
BROADCAST_ROWS = 100_000  # of digests and urls
#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "archive string, n_records long, n_bytes long, dictionary_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean"


def _escaped(uri: str | None) -> bytes:
    return (uri or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").encode()


def _unescaped(uri: bytes) -> str:
    return uri.decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record, a revisit if it refers to a page; that one carries the HTTP head of the full payload only."""
    kind = "response" if refers_to is None else "revisit"
    body = HTTP_HEAD % n + (payload if kind == "response" else b"")
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid4()).encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + _escaped(url)]
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Bytes: %d" % n]
    if page_id is not None:
        head.append(b"X-Page-ID: %d" % page_id)
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To-Target-URI: " + _escaped(refers_url), b"WARC-Refers-To-Date: " + date.encode(), b"X-Refers-To-Page-ID: %d" % refers_to]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(body)]
    return CRLF.join(head) + CRLF * 2 + body + CRLF * 2


def parse(data: bytes) -> dict:
    """A record's fields; bytes and digest of a response are those of its payload, `intact` if its head says the same."""
    head, _, rest = data.partition(CRLF * 2)
    fields = dict(line.split(b": ", 1) for line in head.split(CRLF)[1:] if b": " in line)
    body = rest[: int(fields[b"Content-Length"])]
    kind = fields[b"WARC-Type"].decode()
    number = lambda name: int(fields[name]) if name in fields else None
    digest, n = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"), int(fields[b"X-Payload-Bytes"])
    payload = body.partition(CRLF * 2)[2] if kind == "response" else None
    own = (len(payload), hashlib.sha256(payload).hexdigest()) if payload is not None else (n, digest)
    return {
        "page_id": number(b"X-Page-ID"), "url": _unescaped(fields.get(b"WARC-Target-URI", b"")), "payload_bytes": own[0], "payload_digest": own[1],
        "record_type": kind, "refers_to": number(b"X-Refers-To-Page-ID"), "payload": payload, "intact": own == (n, digest) and rest[len(body):] == CRLF * 2,
    }


def train(samples: list[bytes]):
    """A dictionary from an archive's first records; a raw one where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive: records wait until the sample is full, then each becomes a frame."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.fs, at = fs.FileSystem.from_uri(self.path)
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(at, compression=None)
        self.waiting, self.n, self.raw, self.size, self.dictionary, self.compressor = [], 0, 0, 0, b"", None

    def add(self, data: bytes) -> None:
        self.n, self.raw = self.n + 1, self.raw + len(data)
        if self.compressor:
            self._put(self.compressor.compress(data))
        else:
            self.waiting.append(data)
            if self.raw >= SAMPLE_BYTES:
                self._start()

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def _start(self) -> None:
        import zstandard

        d = train(self.waiting)
        self.dictionary = d.as_bytes()
        self._put(struct.pack("<II", SKIPPABLE, len(self.dictionary)) + self.dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True)
        for data in self.waiting:
            self._put(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int, int]:
        if not self.compressor:
            self._start()
        self.file.close()
        return self.path, self.n, self.size, len(self.dictionary)


def records_of(path: str) -> Iterator[bytes]:
    """The records of an archive, one after another; holds one record and a read buffer."""
    import zstandard
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} does not start with a dictionary frame")
        raw = f.read(size)
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        left = b""
        while True:
            frame, out = d.decompressobj(), []
            while not frame.eof:
                chunk = left or f.read(1 << 16)
                if not chunk:
                    if out:
                        raise ValueError(f"{path} ends inside a record")
                    return
                out.append(frame.decompress(chunk))
                left = frame.unused_data
            yield b"".join(out)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the manifest, itself a written table."""
    folder = folder or f"{scratch_dir(pages.sparkSession)}/archives"
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    first = rows.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("copies"))
    first = materialize(first.filter("copies > 1 and first is not null").select("digest", "first", "first_url"), "copied-payloads")
    # Only ids, urls and digests of copied pages are shuffled; a page's bytes stay in the
    # task that reads it unless it is the response that others revisit.
    copies, stays = KeyFilter(first, F.col("digest")), KeyFilter(first, F.struct("digest", "first"))
    marked = stays.mark(copies.mark(rows, F.col("digest"), "maybe"), F.struct("digest", F.col("page_id").alias("first")), "stays")
    slim = marked.filter("maybe").withColumn("payload", F.when(F.col("stays") | (F.col("n") < MIN_REVISIT), F.col("payload")))
    copied = slim.join(F.broadcast(first) if copies.count <= BROADCAST_ROWS else first, "digest", "left")
    single = marked.filter("not maybe").withColumns({"first": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    cols = ["page_id", "url", "payload", "digest", "n", "first", "first_url"]
    typed = single.select(cols).unionByName(copied.select(cols))
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in cols), strict=True):
                page_id, url, payload, digest, n, at, at_url = (x.as_py() for x in row)
                revisit = at is not None and n >= MIN_REVISIT and at != page_id
                archive = archive or Archive(folder)
                archive.add(record(page_id, url, payload, n, digest, at if revisit else None, at_url, date))
                if archive.raw >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("archive", "n_records", "n_bytes", "dictionary_bytes"), x, strict=True)) for x in done])

    return materialize(typed.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True, damaged: str = "fail") -> DataFrame:
    """One row a record of the manifest's archives.

    `intact` tells whether a payload is what its record's head says. damaged: "fail" on the
    first record that is not, or "keep" it; a damaged frame or archive fails always.
    """
    if damaged not in ("fail", "keep"):
        raise ValueError(f"damaged: {damaged}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows, held = [], 0
                for data in records_of(path):
                    row = parse(data)
                    if damaged == "fail" and not row["intact"]:
                        raise ValueError(f"{path}: the record of page {row['page_id']} is damaged")
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = manifest.select("archive").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "archive")
    return spread.mapInArrow(read, RECORD)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
