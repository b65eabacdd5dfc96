"""WARC archives: writing with revisit records, and a reader that salvages what damage leaves.

Writing.  Equal payloads are found by digest; the row with the least id is written
as a response, others as revisits without payload.  Each task writes one gzip
member per record into files of its own in the shared folder, and reports their
names.  Only reported files are read, so files of lost or repeated attempts don't
count.

Reading.  A file is read in blocks of bounded size, member by member.  Where a
check fails (gzip's CRC, the version line, lengths, digests), the reader looks for the
next valid member, or in plain files the next version line, goes on there, and
logs the bytes between as a quarantined gap with the reason.

Null payloads are empty.  Rows with a null id come after all others.  Of several
rows with the least id of a payload, all are responses.  Empty tables make no files.
Very long payloads are held whole, one at a time.  Of the input's columns only id,
address and payload are read, so others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, clean, parallelism, rows_of, spread_join, to_batch
from .windows import utf8

#: A file is closed after so many bytes, and read in blocks of this size.
FILE_BYTES = 256 << 20
READ_BYTES = 4 << 20
#: A single member may not unpack to more; no value that Spark holds is longer than 2^31 bytes.
RECORD_BYTES = (1 << 31) + (1 << 20)
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_DATE = "2020-01-01T00:00:00Z"


def open_store(path: str):
    """File system and path of a URI in the shared folder (local, HDFS or S3)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, key: str, uri: str, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """One response (payload given) or revisit record, as plain bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{key}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError if it isn't whole and sound."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    head: dict[str, str] = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    size = int(head["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("block length")
    if (digest := head.get("warc-block-digest", "")).startswith("sha1:") and digest[5:] != payload_digest(block):
        raise ValueError("block digest")
    return head, block, end + 8 + size


class _Source:
    """A stream with a buffer that can be looked ahead in; ``pos`` is where reading stands."""

    def __init__(self, stream, step: int = READ_BYTES):
        self.stream, self.step = stream, step
        self.buffer, self.base, self.pos, self.ended = b"", 0, 0, False

    def more(self) -> bool:
        if not self.ended:
            got = self.stream.read(self.step)
            self.ended = not got
            self.buffer = self.buffer[self.pos :] + got
            self.base, self.pos = self.base + self.pos, 0
        return not self.ended

    @property
    def at(self) -> int:
        return self.base + self.pos

    def left(self) -> int:
        return len(self.buffer) - self.pos


def _member(source: _Source) -> tuple[bytes, int]:
    """Content and packed length of the gzip member that begins here; ValueError if damaged."""
    unpack = zlib.decompressobj(31)
    out, fed, size = [], 0, 0
    while True:
        part = source.buffer[source.pos + fed : source.pos + fed + 65536]
        if not part:
            if not source.more():
                raise ValueError("gzip: cut off")
            continue
        try:
            got = unpack.decompress(part)
        except zlib.error as e:
            raise ValueError(f"gzip: {e}") from None
        out.append(got)
        size += len(got)
        fed += len(part)
        if unpack.eof:
            return b"".join(out), fed - len(unpack.unused_data)
        if size > RECORD_BYTES:
            raise ValueError("gzip: member too large")


def _unpacked(data: bytes, step: int) -> Iterator[tuple[str, object]]:
    """What salvage finds in a sound member's content; ValueError if there is no record."""
    why = "more than one record in a member"
    try:
        head, block, used = parse(data)
        if used == len(data):
            return iter([("record", (head, block))])
    except ValueError as e:
        why = str(e)
    inner = ((what, found) for what, _, _, found in salvage(io.BytesIO(data), step, False))
    lead = []
    for x in inner:
        lead.append(x)
        if x[0] == "record":
            return chain(lead, inner)
    raise ValueError(why)


def _record(source: _Source) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length in the file of the sound plain record that begins here; ValueError if there is none."""
    while True:
        try:
            head, block, end = parse(source.buffer, source.pos)
            return head, block, end - source.pos
        except ValueError:
            # a plain record may reach beyond the buffer
            size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)\r\n", source.buffer[source.pos : source.pos + (64 << 10)])
            whole = (64 << 10) + (int(size[1]) if size and int(size[1]) <= RECORD_BYTES else 0)
            if source.left() > whole or not _VERSION.match(source.buffer, source.pos) or not source.more():
                raise


def _seek(source: _Source) -> None:
    """Go to the next place where a member or version line may begin, or to the end."""
    start = source.pos + 1
    while True:
        member = source.buffer.find(_MAGIC, start)
        line = _VERSION.search(source.buffer, start)
        hits = [i for i in (member, line.start() if line else -1) if i >= 0]
        if hits:
            source.pos = min(hits)
            return
        source.pos = max(start, len(source.buffer) - 16)
        if not source.more():
            source.pos = len(source.buffer)
            return
        start = source.pos


def salvage(stream, step: int = READ_BYTES, members: bool = True) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (headers, block)) and ("gap", start, end, reason) for a stream, in order.

    Gzip members and plain records are told apart at each place, so damage to one kind doesn't hide the other.
    A sound member that isn't one sound record is salvaged inside; what is found there has the member's start and end.
    """
    source = _Source(stream, step)
    bad_from, why = None, ""
    while True:
        while source.left() < 1024 and source.more():
            pass
        if not source.left():
            break
        try:
            if members and source.buffer.startswith(_MAGIC, source.pos):
                data, length = _member(source)
                found = _unpacked(data, step)
            else:
                head, block, length = _record(source)
                found = [("record", (head, block))]
        except ValueError as e:
            if bad_from is None:
                bad_from, why = source.at, str(e)
            _seek(source)
            continue
        if bad_from is not None:
            yield "gap", bad_from, source.at, why
            bad_from = None
        for what, x in found:
            yield what, source.at, source.at + length, x
        source.pos += length
    if bad_from is not None:
        yield "gap", bad_from, source.at, why


def write_archives(spark: SparkSession, pages: DataFrame, ws: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the rows as WARC files in the workspace; one row per file: path, records, bytes."""
    rows = clean(pages, id=id_col, url=url_col, html=html_col)
    text = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("sha", F.unhex(F.sha1(text.cast("binary")))).withColumn("size", F.octet_length(text))
    # only digests that occur twice travel back; rows without an id come after all others
    first = rows.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = ws.save(first, "digests")
    roles = spread_join(rows, first, ["sha"], pages.count(), "left")
    revisit = F.col("first").isNotNull() & ((F.col("id") > F.col("first")) | F.col("id").isNull())
    roles = roles.select("id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha", "size", F.when(revisit, F.col("first")).alias("refers_to"))
    folder = ws.folder("archives")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, path, done, n = None, "", [], 0

        def close():
            done.append((f"{folder}/{path}", n, out.tell()))
            out.close()

        try:
            for batch in batches:
                for key, url, html, sha, size, to in zip(*rows_of(batch, "id", "url", "html", "sha", "size", "refers_to")):
                    if out is None:
                        path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out, n = store.open_output_stream(f"{base}/{path}", compression=None), 0
                    name = "none" if key is None else str(key)
                    uri = re.sub(r"[\r\n]+", " ", url or "")
                    kind = "response" if to is None else "revisit"
                    plain = record(kind, name, uri, base64.b32encode(sha).decode(), size, utf8(html), None if to is None else str(to))
                    out.write(gzip_member(plain))
                    n += 1
                    if out.tell() > FILE_BYTES:
                        close()
                        out = None
            if out is not None:
                close()
                out = None
        finally:
            if out is not None:
                out.close()
        if done:
            yield to_batch(schema, list(zip(*done)))

    return ws.save(roles.mapInArrow(write, "path string, records long, bytes long"), "manifest")


_READ = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_READ_DDL = "path string, start long, end long, gap string, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the files in the column ``path``.  A gap's row has the reason in ``gap``, a record's has null there.

    A response's payload digest is checked; where it differs, the record is quarantined too.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = open_store(path)
                out, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for what, start, end, found in salvage(stream):
                        if what == "gap":
                            out.append((path, start, end, found, *[None] * 7))
                            continue
                        head, block = found
                        kind = head.get("warc-type")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        full = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response" and digest and digest != payload_digest(payload):
                            out.append((path, start, end, "payload digest", *[None] * 7))
                            continue
                        n = len(payload) if kind == "response" else int(full[1]) if full else None
                        out.append((path, start, end, None, kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, n, payload if with_payload else None))
                        size += len(block)
                        if size > READ_BYTES or len(out) >= 1000:
                            yield to_batch(_READ, list(zip(*out)))
                            out, size = [], 0
                if out:
                    yield to_batch(_READ, list(zip(*out)))

    return files.select("path").repartition(max(1, parallelism(spark)), "path").mapInArrow(read, _READ_DDL)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back, and give one row per record: id, payload_bytes, payload_digest, record_type, refers_to.

    ValueError if not all records written are read back.
    """
    ws = Workspace(spark, "warc")
    manifest = write_archives(spark, pages, ws, id_col, url_col, html_col, least_bytes)
    wanted = manifest.agg(F.sum("records").alias("n")).first().n or 0
    rows = read_archives(spark, manifest, with_payload=False).where("gap IS NULL")
    key = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(key(c) != "", key(c)).cast("long")
    out = ws.finish(rows.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")))
    if (found := out.count()) != wanted:
        raise ValueError(f"{found} of {wanted} records read back; a record over {RECORD_BYTES} bytes can't be read")
    return out
