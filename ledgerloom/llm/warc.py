"""WARC archives as a table of chunks.

Payloads are cut into chunk rows (record, chunk number, bytes) before they reach a writer or leave a reader, so no task holds
more of a record than one chunk. A writer task streams its chunk rows into archives of bounded size in the shared folder, one
gzip member per record; what it wrote is a manifest row per archive, and readers open only archives in the manifest, so files
of attempts that died are never read. A reader streams each archive and emits a row per chunk with the SHA-1 and the length
of the payload so far; the row of the last chunk has the whole payload's.

Of records with equal payloads of at least ``revisit_from`` bytes one is a response; the others are written as revisits
without a payload, which name the response and carry the full payload's digest and length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import durable, scratch

CHUNK = 1 << 18
ROLL = 1 << 28  # bytes of payload after which a writer starts another archive
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "path string, record long, record_id string, record_type string, target_uri string, refers_to string, "
    "chunk_no long, last boolean, payload binary, bytes_so_far long, sha1_so_far string, header_digest string, header_bytes long"
)
_URN = "urn:page:"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a plain path."""
    return fs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def header(kind: str, record_id: str, url: str, size: int, digest: str, payload_bytes: int, refers: str | None) -> bytes:
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{b32}",
        f"X-Payload-Length: {payload_bytes}",
        "Content-Type: text/html",
        f"Content-Length: {size}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 1000) -> DataFrame:
    """Each page with its payload, digest, length and type: (page_id, url, payload, digest, payload_bytes, kind, refers).

    Of equal payloads of at least ``revisit_from`` bytes the record with the largest id is the response (rows that share that
    id all are; null ids only where no other is left). A null payload is empty, a null url is an empty target.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    groups = durable(
        rows.filter(F.col("payload_bytes") >= revisit_from)
        .groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n"),
        "warc-groups",
    )
    other = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return rows.join(groups, ["digest", "payload_bytes"], "left").select(
        "page_id",
        "url",
        "digest",
        "payload_bytes",
        F.when(other, "revisit").otherwise("response").alias("kind"),
        F.when(other, F.col("newest")).alias("refers"),
        F.when(~other, F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8")).alias("payload"),
    )


def chunked(rows: DataFrame, payload: str = "payload", chunk: int = CHUNK) -> DataFrame:
    """One row per ``chunk`` bytes of ``payload`` (one for an empty payload), in order: chunk_no, last, payload."""
    size = F.length(payload)
    count = F.greatest(F.lit(1), F.ceil(size / F.lit(chunk)).cast("int"))
    rest = [c for c in rows.columns if c != payload]
    return rows.select(
        *rest, F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"), F.col(payload).alias("_whole"), count.alias("_n")
    ).select(
        *rest,
        "chunk_no",
        (F.col("chunk_no") == F.col("_n") - 1).alias("last"),
        F.substring("_whole", F.col("chunk_no") * F.lit(chunk) + 1, F.lit(chunk)).alias("payload"),
        F.length("_whole").alias("size"),
    )


def write(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the planned ``pages`` (see :func:`plan`) below ``folder``; the manifest, itself durable.

    Chunk rows of a record follow each other in one task, because they are cut there.
    """

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = None
        records = held = 0
        try:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    if r.chunk_no == 0:
                        if out is None:
                            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                            store, at = open_store(path)
                            out, records, held = store.open_output_stream(at, compression=None), 0, 0
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        who = "null" if pd.isna(r.page_id) else int(r.page_id)
                        refers = None if pd.isna(r.refers) else f"{_URN}{int(r.refers)}"
                        out.write(gz.compress(header(r.kind, f"{_URN}{who}", r.url, r.size, r.digest, r.payload_bytes, refers)))
                    out.write(gz.compress(r.payload))
                    held += len(r.payload)
                    if r.last:
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                        records += 1
                        if held >= ROLL:
                            out.close()
                            yield pd.DataFrame({"path": [path], "records": [records], "bytes": [held]})
                            out = None
            if out is not None:
                out.close()
                yield pd.DataFrame({"path": [path], "records": [records], "bytes": [held]})
                out = None
        finally:
            if out is not None:
                out.close()

    store, at = open_store(folder)
    store.create_dir(at, recursive=True)
    rows = chunked(pages).select(
        F.col("page_id").cast("string"), "url", "digest", "payload_bytes", "kind", F.col("refers").cast("string"), "chunk_no", "last", "payload", "size"
    )
    return durable(rows.mapInPandas(stream, MANIFEST), "warc-manifest")


class Stream:
    """Bytes of a gzip archive of many members, a bounded window at a time."""

    def __init__(self, path: str):
        store, at = open_store(path)
        self.source, self.held, self.gz = store.open_input_stream(at, compression=None), b"", zlib.decompressobj(47)
        self.pending = b""

    def more(self) -> bool:
        while True:
            if self.gz.eof:
                self.pending, self.gz = self.gz.unused_data or self.pending, zlib.decompressobj(47)
            data = self.pending or self.source.read(CHUNK)
            if not data:
                return False
            got = self.gz.decompress(data, CHUNK)
            self.pending = b"" if self.gz.eof else self.gz.unconsumed_tail
            if got:
                self.held += got
                return True

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the archive."""
        while (at := self.held.find(b"\r\n")) < 0:
            if not self.more():
                return None
        line, self.held = self.held[:at], self.held[at + 2 :]
        return line

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.more():
                raise EOFError("an archive ends inside a record")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def records(stream: Stream) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers, body chunks) of each record; a body has to be used up before the next record."""
    while (line := stream.line()) is not None:
        if not line:
            continue  # the two empty lines after a record
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        found: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.lower()] = value.strip()
        yield found, stream.body(int(found["content-length"]))


def read(manifest: DataFrame, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in ``manifest``: a row per record and chunk number, with the digest and length of the
    payload up to and with that chunk. ``payload=False`` leaves the bytes out and keeps only each record's last chunk row."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                held, weight = [], 0
                for n, (found, parts) in enumerate(records(Stream(path))):
                    sha, size, number, waiting = hashlib.sha1(), 0, 0, b""
                    left = int(found["content-length"])
                    inner = [found.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to")]
                    digest = found.get("warc-payload-digest", "").removeprefix("sha1:")
                    named = (base64.b32decode(digest).hex() if digest else None, int(found.get("x-payload-length", -1)))
                    while True:
                        while len(waiting) < chunk and left:
                            part = next(parts)
                            waiting, left = waiting + part, left - len(part)
                        own, waiting = waiting[:chunk], waiting[chunk:]
                        sha.update(own)
                        size += len(own)
                        last = not left and not waiting
                        if payload or last:
                            held.append((path, n, *inner, number, last, own if payload else b"", size, sha.hexdigest(), *named))
                            weight += len(own) if payload else 0
                        number += 1
                        if len(held) >= 2000 or weight >= 1 << 24:
                            yield pd.DataFrame(held, columns=_names())
                            held, weight = [], 0
                        if last:
                            break
                if held:
                    yield pd.DataFrame(held, columns=_names())

    spread = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return spread.mapInPandas(parse, CHUNKS)


def _names() -> list[str]:
    return [c.split()[0] for c in CHUNKS.split(", ")]


def page_number(record_id: Column) -> Column:
    """The page id in a record id of :func:`write`, null for pages without one."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def archive(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) as records, read the archives back: page_id, payload_bytes, payload_digest
    (hex SHA-1 of the full payload), record_type, refers_to. A response's digest and length are those of the bytes read;
    a revisit's are those its header has."""
    folder = scratch(pages.sparkSession, "warc")
    back = read(write(plan(pages, revisit_from=revisit_from), folder), payload=False)
    whole = F.col("record_type") == "response"
    return back.select(
        page_number(F.col("record_id")).alias("page_id"),
        F.when(whole, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("sha1_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        page_number(F.col("refers_to")).alias("refers_to"),
    )
