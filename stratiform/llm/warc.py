"""WARC archives: a writer that deduplicates payloads into revisit records, and a salvage reader.

Writing: each partition streams its pages into one gzipped archive under the shared folder, one member for
each record. Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id
is a ``response`` and the others are ``revisit`` records that refer to it. Only archives of tasks that ended
well are in the manifest, so a lost executor's half-written file is never read.

Reading: :class:`SalvageReader` streams one archive (gzipped or plain, found out by itself). A record counts
only when all checks hold: member checksum, version line, headers, Content-Length, the closing blank lines
and the payload digest. After a failed check the reader searches for the next gzip member or version line
that starts a valid record, goes on from there, and reports the bytes between as a quarantined gap.

Defined cases: a null html is an empty payload; equal empty payloads are deduplicated like others; a null
page_id is smaller than any other and is left out of the headers; rows that repeat the largest page_id of
equal payloads are all responses; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fits_broadcast, kept, scratch

CRLF = b"\r\n"
MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
HEAD_LIMIT = 1 << 16
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, length long, kind string, record_type string, page_id long, target_uri string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary, reason string"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str | None:
    """A URL without the control characters that would break a header."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id, url, payload: bytes, kind: str, refers_to=None, date="1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    digest = base32_sha1(payload)
    name = f"{'none' if page_id is None else page_id}-{digest}"
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Page-Id", page_id),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To-Page-Id", refers_to),
        ("WARC-Profile", None if kind == "response" else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines + CRLF + block + CRLF * 2


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, broadcast_rows: int = 500_000) -> DataFrame:
    """Writes every page as a record and returns the manifest: path, records and bytes of each archive.

    Payload classes meet by SHA-256: one map-side combined aggregate of (hash, page_id). Only classes of two
    or more reach the join with the pages; it is a broadcast up to ``broadcast_rows`` classes and beyond that
    a shuffle join, whose hot keys Spark splits.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    groups = kept(
        slim.where(F.octet_length("payload") >= min_bytes)
        .groupBy("same")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("same", "keeper")
    )
    side = F.broadcast(groups) if fits_broadcast(groups, broadcast_rows) else groups.hint("merge")
    rows = slim.join(side, "same", "left").select("page_id", "url", "payload", "keeper")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        ctx = TaskContext.get()
        out, path, n, size = None, None, 0, 0
        for batch in batches:
            for pid, url, payload, keeper in batch.itertuples(index=False):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                pid = None if pd.isna(pid) else int(pid)
                keeper = None if pd.isna(keeper) else int(keeper)
                again = keeper is not None and pid != keeper
                data = _member(record_bytes(pid, url, bytes(payload), "revisit" if again else "response", keeper if again else None))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path}"], "records": [n], "bytes": [size]})

    return kept(rows.mapInPandas(write, MANIFEST))


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(Exception):
    """A failed check."""


@dataclass
class SalvageReader:
    """Records and gaps of one archive, in order. Holds one record and one chunk in memory."""

    stream: object
    max_record: int = 1 << 31
    buf: bytearray = field(default_factory=bytearray)
    base: int = 0
    ended: bool = False

    def _more(self) -> bool:
        if not self.ended and (x := self.stream.read(CHUNK)):
            self.buf += x
            return True
        self.ended = True
        return False

    def _need(self, n: int) -> bool:
        while len(self.buf) < n and self._more():
            pass
        return len(self.buf) >= n

    def _drop(self, n: int) -> None:
        del self.buf[:n]
        self.base += n

    def __iter__(self) -> Iterator[Record | Gap]:
        gap, why = None, ""
        while self._need(1):
            try:
                found, used = self._at_start()
            except Damaged as e:
                if gap is None:
                    gap, why = self.base, str(e)
                self._seek()
                continue
            if gap is not None:
                yield Gap(gap, self.base - gap, why)
                gap = None
            for x in found:
                x.offset, x.length = self.base, used
                yield x
            self._drop(used)
        if gap is not None:
            yield Gap(gap, self.base - gap, why)

    def _seek(self) -> None:
        """Drops bytes up to the next place that may start a member or a version line, or to the end."""
        at = 1
        while True:
            hits = [i for i in (self.buf.find(MAGIC, at), self._line(at)) if i >= 0]
            if hits:
                return self._drop(min(hits))
            at = max(1, len(self.buf) - 16)
            if at > CHUNK:
                self._drop(at - 1)
                at = 1
            if not self._more():
                return self._drop(len(self.buf))

    def _line(self, at: int) -> int:
        m = _VERSION.search(self.buf, at)
        return m.start() if m else -1

    def _at_start(self) -> tuple[list[Record], int]:
        self._need(3)
        if self.buf[:3] == MAGIC:
            data, used = self._inflate()
            found, at = [], 0
            while at < len(data):
                rec, n = self._parse(data, at, lambda _: False)
                found.append(rec)
                at += n
            return found, used
        rec, n = self._parse(self.buf, 0, self._need)
        return [rec], n

    def _inflate(self) -> tuple[bytes, int]:
        """The whole member at the start of the buffer, and its compressed length."""
        z, out, fed, size = zlib.decompressobj(31), [], 0, 0
        try:
            while not z.eof:
                if fed >= len(self.buf) and not self._more():
                    raise Damaged("member ends early")
                part = bytes(self.buf[fed : fed + CHUNK])
                fed += len(part)
                out.append(z.decompress(part, self.max_record - size + 1))
                size += len(out[-1])
                if size > self.max_record:
                    raise Damaged("record beyond the size limit")
                if out and size >= 5 and not b"".join(x for x in out if x).startswith(b"WARC/") and len(out) == 1:
                    raise Damaged("member holds no record")
        except zlib.error as e:
            raise Damaged(f"member checksum or data: {e}") from None
        return b"".join(out), fed - len(z.unused_data)

    def _parse(self, data, at: int, need) -> tuple[Record, int]:
        """The record at ``data[at:]`` and its length; ``need`` makes a growing buffer longer."""
        need(at + 10)
        first = _VERSION.match(data, at)
        if not first:
            raise Damaged("no version line")
        want = at + 1024
        while (end := data.find(CRLF * 2, first.end() - 2)) < 0:
            if len(data) - at > HEAD_LIMIT or not need(want):
                raise Damaged("headers don't end")
            want += CHUNK
        headers = {}
        for line in bytes(data[first.end() : end]).split(CRLF):
            k, colon, v = line.partition(b":")
            if not colon:
                raise Damaged("malformed header")
            headers[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = headers.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", size) or int(size) > self.max_record:
            raise Damaged("Content-Length")
        start = end + 4
        stop = start + int(size)
        need(stop + 4)
        if len(data) < stop + 4 or data[stop : stop + 4] != CRLF * 2:
            raise Damaged("record isn't closed where Content-Length says")
        block = bytes(data[start:stop])
        payload, declared = block, len(block)
        if "application/http" in headers.get("content-type", ""):
            head, _, payload = block.partition(CRLF * 2)
            m = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", head)
            declared = int(m[1]) if m else len(payload)
        if headers.get("warc-type") == "revisit":
            payload = None
        else:
            digest = headers.get("warc-payload-digest", "")
            if digest.startswith("sha1:") and digest[5:] != base32_sha1(payload):
                raise Damaged("payload digest")
            declared = len(payload)
        return Record(0, 0, headers, payload, declared), stop + 4 - at


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record and gap of the archives named in ``path``; one archive is read by one task as a stream."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for x in SalvageReader(stream):
                        if isinstance(x, Gap):
                            row = (path, x.offset, x.length, "gap", *[None] * 7, x.reason)
                        else:
                            h = x.headers
                            num = lambda k: int(h[k]) if re.fullmatch("-?[0-9]+", h.get(k, "")) else None
                            body = x.payload if payloads else None
                            row = (path, x.offset, x.length, "record", h.get("warc-type"), num("warc-page-id"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, x.payload_bytes, num("warc-refers-to-page-id"), body, None)
                            held += len(body or b"")
                        rows.append(row)
                        if len(rows) >= 2000 or held > 8 * CHUNK:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return manifest.select("path").mapInPandas(read, RECORDS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("offset", "length", "page_id", "payload_bytes", "refers_to"):
        df[c] = df[c].astype("Int64")
    return df
