"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

The writer makes one gzip member for each record and rolls archives at a bounded size, in a
folder that all executors share. Each attempt of a task writes files of its own, and only
those that a finished task reports are read.

The reader checks every record: the member must inflate with its checksum, begin with a
version line, hold as many bytes as its header says, and match its block and payload digests.
A member may hold several records. Headers may have any length. After a
failed check it searches for the next place where a valid member or, in plain archives, a
valid record begins, goes on from there, and reports the bytes between as quarantined. In a
member that inflates, the same search goes on within its content; a gap there is reported at
the member's place with its offset in the content. It reads in chunks, so memory depends on
the largest member or record.

Null html is an empty payload and null url an empty address. Of rows with equal payloads of
at least `least` bytes, that with the largest page_id is the response (null counts as the
smallest; of equal ids, one row) and the others revisit it; smaller payloads are all
responses. Each row gives one record, repeated rows too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._spark import checkpoint_dir, grouped, looked_up, saved

ROLL = 64 << 20
CHUNK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/(?:0\.\d+|1\.[01])\r\n")
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class Record(NamedTuple):
    """A record, or with kind `quarantined` a byte range that holds none; then note says why."""

    offset: int
    length: int
    kind: str
    record_id: str
    target: str
    refers_to: str | None
    digest: str | None
    payload_bytes: int
    payload: bytes
    note: str


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page: str, url: str, payload: bytes, refers_to: str | None, revisit: bool, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One record, not compressed. A revisit has the response's head but no payload."""
    head = HEAD % len(payload)
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Source:
    """Random access to bytes or to an open file."""

    def __init__(self, data):
        self.data = data
        self.size = len(data) if isinstance(data, bytes) else data.size()

    def at(self, offset: int, n: int) -> bytes:
        if isinstance(self.data, bytes):
            return self.data[offset : offset + n]
        self.data.seek(offset)
        return self.data.read(n)

    def find(self, what: bytes, offset: int) -> int:
        """The next place of `what`, or the size."""
        while offset < self.size:
            part = self.at(offset, CHUNK)
            i = part.find(what)
            if i >= 0:
                return offset + i
            if len(part) < CHUNK:
                break
            offset += len(part) - len(what) + 1
        return self.size

    def inflate(self, offset: int, most: int | None = None) -> tuple[bytes, int] | None:
        """(content, end) of the gzip member at offset, or None. With `most`, its first bytes and any end."""
        z, out, at, got = zlib.decompressobj(31), [], offset, 0
        try:
            while not z.eof:
                part = self.at(at, CHUNK)
                if not part:
                    return None
                out.append(z.decompress(part) if most is None else z.decompress(part, most))
                at += len(part)
                got += len(out[-1])
                if most is not None and got >= most:
                    break
        except zlib.error:
            return None
        return b"".join(out), at - len(z.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _parse(f: dict[str, str], block: bytes, offset: int, length: int) -> Record | str:
    """The record of that header and block, or what is wrong with it."""
    if (said := f.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest_of(block):
        return "wrong block digest"
    http = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -4
    payload = block[http + 4 :]
    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if not (kind := f.get("warc-type", "")):
        return "no record type"
    n = len(payload)
    if kind == "revisit":
        said = _fields(block[: max(http, 0)]).get("content-length", "")
        n = int(said) if said.isdigit() else 0
    elif digest and digest != digest_of(payload):
        return "wrong payload digest"
    return Record(offset, length, kind, f.get("warc-record-id", ""), f.get("warc-target-uri", ""), f.get("warc-refers-to"), digest, n, payload, "")


def _plain(s: _Source, offset: int) -> tuple[Record | str, int]:
    """The record of a plain archive at offset and its end; for a failed one, the end is the offset."""
    if not VERSION.match(s.at(offset, 16)):
        return "no version line", offset
    stop = s.find(b"\r\n\r\n", offset)
    if stop == s.size:
        return "no end of header", offset
    f = _fields(s.at(offset, stop - offset))
    n = f.get("content-length", "")
    if not n.isdigit():
        return "no content length", offset
    start, end = stop + 4, stop + 8 + int(n)
    if end > s.size or s.at(end - 4, 4) != b"\r\n\r\n":
        return "wrong content length", offset
    got = _parse(f, s.at(start, int(n)), offset, end - offset)
    return got, end if isinstance(got, Record) else offset


def _scan(s: _Source, read, mark: bytes) -> Iterator[Record]:
    """What `read` finds from the start on, and the gaps between; after a failure it goes on at the next `mark`."""
    at, gap, why = 0, None, ""
    while at < s.size:
        got, end = read(s, at)
        if isinstance(got, str):
            if gap is None:
                gap, why = at, got
            at = s.find(mark, at + 1)
            continue
        if gap is not None:
            yield Record(gap, at - gap, "quarantined", "", "", None, None, 0, b"", why)
            gap = None
        yield from [got] if isinstance(got, Record) else got
        at = end
    if gap is not None:
        yield Record(gap, s.size - gap, "quarantined", "", "", None, None, 0, b"", why)


def _zipped(s: _Source, offset: int) -> tuple[list[Record] | str, int]:
    """The records of the member at offset, with what is wrong between them, and its end; a member without any record fails."""
    if s.at(offset, 3) != MAGIC:
        return "no member", offset
    member = s.inflate(offset)
    if member is None:
        return "member doesn't inflate", offset
    found = list(_scan(_Source(member[0]), _plain, b"WARC/"))
    if all(r.kind == "quarantined" for r in found):
        return (found[0].note if found else "empty member"), offset
    length = member[1] - offset
    return [r._replace(note=f"{r.note}, bytes {r.offset} to {r.offset + r.length} of the member's content", offset=offset, length=length) if r.kind == "quarantined" else r._replace(offset=offset, length=length) for r in found], member[1]


def salvage(data) -> Iterator[Record]:
    """All records of an archive (bytes, or a file with seek, read and size), and its quarantined gaps, in order."""
    s = _Source(data)
    zipped = s.at(0, 2) == MAGIC[:2] or (not VERSION.match(s.at(0, 16)) and s.find(MAGIC, 0) < s.find(b"WARC/", 0))
    yield from _scan(s, *((_zipped, MAGIC) if zipped else (_plain, b"WARC/")))


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, roll: int = ROLL, level: int = 3) -> DataFrame:
    """(path, records) of the archives written below folder, by default a new one in the checkpoint folder."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # equal payloads are those of one SHA-1; the most frequent ones meet their heads without a shuffle by digest
    head = F.max(F.struct("page_id", "row"))
    big = rows.where(F.octet_length("payload") >= least).select("page_id", "row", "digest")
    heads = grouped(big, ["digest"], [head.alias("head"), F.count("*").alias("n")], [F.max("head").alias("head"), F.sum("n").alias("n")]).where("n > 1")
    marked = looked_up(rows, heads, "digest")
    revisit = F.col("head").isNotNull() & (F.octet_length("payload") >= least) & (F.col("head.row") != F.col("row"))
    marked = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("head.page_id").cast("string").alias("to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        task = TaskContext.get()
        name, part, out, size, n = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{part:04d}.warc.gz"]), pa.array([n])], names=["path", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, address, payload, to, again = (batch.column(j)[i].as_py() for j in range(5))
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, size, n = fs.open_output_stream(f"{name}-{part:04d}.warc.gz", compression=None), 0, 0
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record_bytes(str(page), address, payload, str(to), again)) + z.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll:
                    yield close()
                    part, out = part + 1, None
        if out is not None:
            yield close()

    found = saved(marked.mapInArrow(run, "path string, records long"))
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    return found.select(F.concat(F.lit(scheme), "path").alias("path"), "records")


_ROWS = "path string, offset long, length long, kind string, record_id string, target string, refers_to string, digest string, payload_bytes long, payload binary, note string"
_TYPES = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("note", pa.string())])


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record and quarantined gap of archives(path), or (path, content) as Spark's binaryFile source gives them.

    Without `content` the executors open the path themselves. Without `payloads` the column is null.
    """
    own = "content" in archives.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                rows, size = [], 0
                if own:
                    data = batch.column(1)[i].as_py() or b""
                else:
                    fs, name = _open(path)
                    data = fs.open_input_file(name)
                for r in salvage(data):
                    rows.append((path, *(r if payloads else r._replace(payload=None))))
                    size += 300 + (len(r.payload) if payloads else 0)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)

    return archives.select("path", *(["content"] if own else [])).mapInArrow(run, _ROWS)


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that `write` made."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    return records.where("kind in ('response', 'revisit')").select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", number("refers_to")).alias("refers_to"))
