"""WARC archives: deduplicating writer and salvage reader.

Every record is a gzip member of its own. The reader checks each member (gzip checksum, version
line, lengths, block digest); after a failed check it searches for the next place where a whole
valid record starts, by gzip magic or version line, goes on from there, and reports the bytes in
between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

FILE_BYTES = 32 << 20
LEVEL = 4
CHUNK = 1 << 20
#: Bytes of a member that are inflated at a time, compressed and inflated.
PIECE, INFLATED = 1 << 14, 1 << 18
#: Bytes of a record that is being checked that stay in memory, for the search after a failed check; beyond, they are read again.
HOLD = 1 << 26
#: Headers (not blocks) end within so many bytes, so that a false or hostile member can't fill a task's memory; the writer refuses longer ones.
HEAD = 1 << 26
#: Bytes of a file name or comment in a gzip header.
NAME = 1 << 12
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: str | None, digest: str) -> str:
    """The id of the record of a page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{digest}:{page_id}')}>"


def _line(value: str) -> str:
    """A header value without line breaks."""
    return " ".join(value.split())


def _member(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}",
        *([f"WARC-Page-ID: {quote(page_id, safe='')}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Page: {quote(refers_to, safe='')}"]
    start = "\r\n".join(head).encode() + END
    if len(start) > HEAD:
        raise ValueError(f"the headers of page {str(page_id)[:60]} have {len(start)} bytes, more than {HEAD}")
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([z.compress(start), z.compress(block), z.compress(END), z.flush()])


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2026-01-01T00:00:00Z", least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Write a record per row under ``folder`` (any URI that pyarrow and Spark open) and return the manifest ``(file, records, bytes)``.

    Of rows whose payloads (UTF-8; null: empty) are equal and of ``least`` bytes or more, that of the
    least id holds the payload and the others are revisits that refer to it; a row that repeats id and
    payload is a response again. An id with several payloads is planned for each payload by itself. Rows of
    null id are written as responses without a page id; ids stand percent-encoded in the headers, so that
    blanks and line breaks come back. A payload of any length that a row can hold is one record. Files are
    whole before they get their name, and only files in the manifest count, so what a lost executor left
    behind is never read.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(id_col).alias("order"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    digests = rows.where("page_id is not null").select("order", "sha", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    firsts = digests.groupBy("sha").agg(F.min("order").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = digests.join(firsts, "sha").where("order <> first").select("order", "sha", F.col("first").cast("string").alias("refers_to")).distinct()
    planned = rows.join(again, ["order", "sha"], "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            store.move(f"{root}/{name}.open", f"{root}/{name}")
            done.append((f"{folder}/{name}", records, size))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}.open", compression=None)
                member = _member(page_id, url, payload, base32_sha1(payload), refers_to, date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            f, n, b = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n, pa.int64()), pa.array(b, pa.int64())], names=["file", "records", "bytes"])

    return (scratch or Scratch(pages.sparkSession)).table(planned.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


@dataclass
class Record:
    start: int
    stop: int
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


class BadRecord(ValueError):
    pass


class Salvage:
    """Records of one archive in order, and the gaps between them.

    The archive is read once from front to back and blocks are digested as they pass, so that a record may
    be longer than a task's memory; payloads are held only if ``keep`` asks for them. Up to HOLD bytes of
    the record that is being checked stay in the buffer, so that a failed check can go on searching from
    there without reading again.
    """

    def __init__(self, source: pa.NativeFile, *, keep: bool = False):
        self.source, self.size, self.keep = source, source.size(), keep
        self.buffer, self.base = bytearray(), 0
        self.gaps: list[tuple[int, int, str]] = []
        #: of each start that is searched for: where it was found next, or up to where there is none
        self.known: dict[bytes, tuple[int, bool]] = {MAGIC: (0, False), VERSION: (0, False)}

    def _fill(self, offset: int, n: int) -> int:
        """Up to ``n`` bytes from ``offset`` on are in the buffer; how many there are."""
        if not self.base <= offset <= self.base + len(self.buffer):
            self.source.seek(offset)
            self.buffer, self.base = bytearray(), offset
        while len(self.buffer) < offset - self.base + n:
            data = self.source.read(CHUNK)
            if not data:
                break
            self.buffer += data
        return min(n, len(self.buffer) - (offset - self.base))

    def _at(self, offset: int, n: int) -> bytes:
        n = self._fill(offset, n)
        at = offset - self.base
        return bytes(memoryview(self.buffer)[at : at + n])

    def _forget(self, offset: int) -> None:
        """What lies before ``offset`` is not needed; it goes a chunk at a time."""
        if offset - self.base >= CHUNK:
            self._fill(offset, 0)
            del self.buffer[: offset - self.base]
            self.base = offset

    def _plain(self, offset: int) -> Iterator[bytes]:
        """The archive's bytes from ``offset`` on."""
        at = offset
        while data := self._at(at, PIECE):
            yield data
            at += len(data)
            if at - offset > HOLD:
                self._forget(at)

    def _member_starts(self, offset: int) -> bool:
        """Whether a gzip header stands at ``offset`` (by its flags, and names and comments that end within NAME bytes)."""
        if self._fill(offset, 12) < 12:
            return False
        flags = self.buffer[offset - self.base + 3]
        at = offset + 10
        if flags & 4:
            at += 2 + int.from_bytes(self._at(at, 2), "little")
        for bit in (8, 16):
            if flags & bit:
                self._fill(at, NAME)
                end = self.buffer.find(0, at - self.base, at - self.base + NAME)
                if end < 0:
                    return False
                at = self.base + end + 1
        return not flags & 0xE0

    def _inflated(self, offset: int) -> Iterator[bytes]:
        """The bytes of the member at ``offset``; then ``stop`` is its end."""
        z, at = zlib.decompressobj(31), offset
        for data in self._plain(offset):
            at += len(data)
            while data and not z.eof:
                try:
                    piece = z.decompress(data, INFLATED)
                except zlib.error as e:
                    raise BadRecord(f"gzip: {e}") from None
                if piece:
                    yield piece
                data = z.unconsumed_tail
            if z.eof:
                self.stop = at - len(z.unused_data)
                return
        raise BadRecord("member breaks off")

    @staticmethod
    def _headers(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise BadRecord("no version line")
        pairs = [x.partition(":") for x in lines[1:]]
        if any(not sep for _, sep, _ in pairs):
            raise BadRecord("header line without colon")
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    def _record(self, offset: int) -> Record:
        start = self._at(offset, 8)
        if start.startswith(MAGIC):
            if not self._member_starts(offset):
                raise BadRecord("gzip header")
            pieces, alone = self._inflated(offset), True
        elif start.startswith(VERSION):
            pieces, alone = self._plain(offset), False
        else:
            raise BadRecord("no record starts here")
        head = bytearray()
        while (end := head.find(END, max(0, len(head) - INFLATED - 3))) < 0:
            if len(head) >= len(VERSION) and not head.startswith(VERSION):
                raise BadRecord("no version line")
            if len(head) > HEAD:
                raise BadRecord("headers too long")
            more = next(pieces, b"")
            if not more:
                raise BadRecord("no end of headers")
            head += more
        headers = self._headers(bytes(head[:end]))
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise BadRecord("no content length")
        left = int(length)
        if not alone and offset + end + 4 + left + 4 > self.size:
            raise BadRecord("block length")
        block, payload, kept, n = hashlib.sha1(), hashlib.sha1(), [], 0
        front = bytearray() if headers.get("content-type", "").startswith("application/http") else None
        piece, tail = bytes(head[end + 4 :]), b""
        del head
        while True:
            part, tail = piece[:left], piece[left:]
            left -= len(part)
            block.update(part)
            if front is not None:
                front += part
                at = front.find(END, max(0, len(front) - len(part) - 3))
                part, front = (bytes(front[at + 4 :]), None) if at >= 0 else (b"", front)
            payload.update(part)
            n += len(part)
            if self.keep:
                kept.append(part)
            if not left:
                break
            piece = next(pieces, b"")
            if not piece:
                raise BadRecord("block length")
        while len(tail) < 4 + alone and (piece := next(pieces, b"")):
            tail += piece
        if (tail if alone else tail[:4]) != END:
            raise BadRecord("block length")
        want = headers.get("warc-block-digest")
        if want and want != f"sha1:{base64.b32encode(block.digest()).decode()}":
            raise BadRecord("block digest")
        stop = self.stop if alone else offset + end + 4 + int(length) + 4
        return Record(offset, stop, headers, n, base64.b32encode(payload.digest()).decode(), b"".join(kept) if self.keep else None)

    def _next_of(self, what: bytes, offset: int) -> int:
        """Where ``what`` stands next in the buffer from ``offset`` on, or the last offset up to which it doesn't start."""
        at, found = self.known[what]
        if not found or at < offset:
            i = self.buffer.find(what, max(at, offset) - self.base)
            at, found = (self.base + i, True) if i >= 0 else (max(offset, self.base + len(self.buffer) - len(what) + 1), False)
            self.known[what] = at, found
        return at

    def _next_start(self, offset: int) -> int:
        """The next offset where a member or a version line may start, or the size; what lies before it is forgotten."""
        while offset < self.size:
            self._forget(offset)
            if not self._fill(offset, CHUNK):
                break
            at = min(self._next_of(MAGIC, offset), self._next_of(VERSION, offset))
            if any(found and where == at for where, found in self.known.values()):
                return at
            if self.base + len(self.buffer) >= self.size:
                break
            offset = at
        return self.size

    def __iter__(self) -> Iterator[Record]:
        at = 0
        while at < self.size:
            try:
                record = self._record(at)
            except BadRecord as e:
                gap, reason, record = at, str(e), None
                while record is None and at < self.size:
                    at = self._next_start(at + 1)
                    if at < self.size:
                        try:
                            record = self._record(at)
                        except BadRecord:
                            pass
                self.gaps.append((gap, at, reason))
                if record is None:
                    return
            yield record
            at = record.stop
            self._forget(at)


_READ = "file string, start long, stop long, kind string, page_id string, url string, refers_to string, record_id string, refers_to_record string, payload_bytes long, payload_digest string, reason string"


def _id(headers: dict[str, str], name: str) -> str | None:
    return unquote(headers[name]) if name in headers else None


def read_archives(spark: SparkSession, files: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Records and quarantined gaps of the archives in ``files(file)``, one row each.

    ``kind`` is the record's WARC type, or ``gap`` for bytes that belong to no valid record, with the
    reason of the failed check; start and stop are its bytes. A response's payload_bytes and
    payload_digest are computed from the payload read (a response whose payload doesn't match its own
    payload digest is a gap); a revisit's are null until it is resolved. An empty file has no rows.
    """
    names = [x.split(" ")[0] for x in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    salvage, rows, held = Salvage(source, keep=with_payload), [], 0
                    for r in salvage:
                        h, kind = r.headers, r.headers.get("warc-type", "")
                        full = kind == "response"
                        if full and h.get("warc-payload-digest", f"sha1:{r.payload_digest}") != f"sha1:{r.payload_digest}":
                            rows.append((file, r.start, r.stop, "gap", *[None] * 7, "payload digest", None))
                            continue
                        names = _id(h, "warc-page-id"), h.get("warc-target-uri"), _id(h, "warc-refers-to-page"), h.get("warc-record-id"), h.get("warc-refers-to")
                        rows.append((file, r.start, r.stop, kind, *names, r.payload_bytes if full else None, r.payload_digest if full else None, None, r.payload if full else None))
                        held += len(r.payload or b"")
                        if held > CHUNK * 8 or len(rows) >= 1 << 14:
                            yield _batch(rows)
                            rows, held = [], 0
                    rows += [(file, a, b, "gap", *[None] * 7, why, None) for a, b, why in salvage.gaps]
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
        if with_payload:
            return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[-1], pa.binary())], names=[*names, "payload"])
        return pa.RecordBatch.from_arrays(arrays, names=names)

    # one archive a task, up to the session's shuffle partitions
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(parts, "file").mapInArrow(run, _READ + ", payload binary" * with_payload)


def resolve(records: DataFrame, pages: DataFrame | None = None, *, id_col: str = "page_id") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of responses and revisits; a revisit takes its response's payload.

    A revisit whose response lies in a gap keeps its row, with null payload columns. ``pages``: of an id
    that has more rows there than records here (the others lie in gaps), each further row is one of type
    ``lost`` with nulls.
    """
    own = records.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    # records of one id hold one payload, so any of them will do
    held = records.where("kind = 'response' and record_id is not null").select(F.col("record_id").alias("refers_to_record"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to_record"])
    seen = records.where("kind = 'revisit'").select("page_id", "refers_to", "refers_to_record").join(held, "refers_to_record", "left")
    out = own.unionByName(seen.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
    if pages is None:
        return out
    there = pages.select(F.col(id_col).cast("string").alias("page_id"), F.lit(1).alias("n")).unionByName(records.where("kind in ('response', 'revisit')").select("page_id", F.lit(-1).alias("n")))
    lost = there.where("page_id is not null").groupBy("page_id").agg(F.sum("n").alias("n")).where("n > 0").select("page_id", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.unionByName(lost.select("page_id", F.lit("lost").alias("record_type")), allowMissingColumns=True)
