"""WARC archives in the shared folder: a writer, and a reader that salvages what damaged archives still hold.

Writing: every task writes its rows as gzip members, one record each, into archives of about ``ARCHIVE_BYTES``; names are new for
each attempt of a task and only archives of finished tasks are in the returned listing, so a lost executor leaves at most
files that nobody reads. Payloads that occur more than once are stored once: the row with the largest id is the response,
the others are revisit records that refer to it.

Reading: a task streams an archive through a buffer of ``WINDOW`` bytes (a longer record makes it grow). A record must pass all checks:
version line, named fields, length, the record's digest and the two line ends after it. After a failed check the reader searches for the
next gzip member or version line that passes, goes on there, and reports the bytes in between as a gap
(path, start, end, reason). A record cut off by the end of the file is a gap too. Inflated bytes are read the same way, in steps, and searched for
version lines; a broken member gives the records before its break and those behind a failed one (after an error of gzip's, checksum
included, only those with a digest; fields have none) unless it is all one record, and what follows the last is the gap. Records of a member have its start and end; gaps inside
begin and end at the nearest known places (every ``PIECE`` packed bytes).

Defined results: a null payload is empty; null ids are written as such and read back as null; of rows with equal payloads and equal
largest ids all are responses; an empty table gives no archives and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import new_path, written

ARCHIVE_BYTES = 64 << 20
WINDOW = 1 << 20
#: Packed bytes that are inflated at once.
PIECE = 1 << 14
#: Smaller payloads are stored anew each time.
REVISIT_BYTES = 1000
GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, start long, end long, kind string, reason string, warc_type string, record_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def marked(rows: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    """Rows (record_id, url, payload, refers_to): refers_to is the id whose record holds the payload, null where it is the row's own."""
    rows = rows.select(
        F.col(record_id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")
    )
    keyed = rows.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha1(F.encode("payload", "UTF-8"))))
    # Only digests that occur twice are joined back: one row for each, counted before the shuffle.
    twice = (
        keyed.where("digest IS NOT NULL AND record_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.max("record_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "kept")
    )
    return keyed.join(twice, "digest", "left").select(
        "record_id", "url", "payload", F.when(F.col("kept") > F.col("record_id"), F.col("kept")).alias("refers_to")
    )


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no block, only what it takes to find the payload."""
    block = payload if refers_to is None else b""
    name = lambda i: f"<urn:record:{'null' if i is None else i}>"
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(record_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", digest(payload)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html;charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[3:3] = [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", _PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write(rows: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", compress: bool = True) -> DataFrame:
    """Writes the rows as archives in the shared folder; returns their listing (path, records, bytes), itself a written table."""
    spark = rows.sparkSession
    folder = new_path(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count]), pa.array([size])], ["path", "records", "bytes"])

        for batch in batches:
            for i, u, p, r in zip(*batch.columns, strict=True):
                data = record(i.as_py(), u.as_py(), p.as_py().encode(), r.as_py())
                if compress:
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = gz.compress(data) + gz.flush()
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * compress
                    path, size, count = f"{folder}/{name}", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)  # already packed
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(marked(rows, record_id, url, payload).mapInArrow(archive, "path string, records long, bytes long"), "warc-listing")


class _Window:
    """Bytes of a file from any place on, read in steps and dropped behind."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def get(self, start: int, length: int) -> bytes:
        """Up to so many bytes from start, which is at or behind the last start or is sought anew."""
        if start < self.at or start > self.at + len(self.data):
            self.at, self.data = start, b""
            self.file.seek(start)
        if start + length > self.at + len(self.data):
            self.data = self.data[start - self.at :]
            self.at = start
            self.file.seek(start + len(self.data))
            self.data += self.file.read(max(length - len(self.data), WINDOW))
        return self.data[start - self.at : start - self.at + length]


class Damaged(Exception):
    """What a check found wrong."""


def _head(window: _Window | _Member, start: int) -> tuple[dict[str, str], int]:
    """Named fields of the record at start, and the length of its head, of whatever length."""
    limit = 1 << 16
    data = window.get(start, limit)
    if not _VERSION.match(data):
        raise Damaged("no version line")
    while (end := data.find(b"\r\n\r\n")) < 0:
        if len(data) < limit:
            raise Damaged("no end of the fields")
        limit *= 4
        data = window.get(start, limit)
    fields = {}
    for line in data[10:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if line and not colon:
            raise Damaged("a line that is no field")
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("no length")
    return fields, end + 4


def _checked(fields: dict[str, str], block: bytes, tail: bytes, proof: bool) -> dict:
    if tail != b"\r\n\r\n":
        raise Damaged("no end of the record")
    want = fields.get("warc-block-digest")
    if want and want.lower().startswith("sha1:") and want[5:].upper() != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise Damaged("digest")
    if proof and not (want and want.lower().startswith("sha1:")):
        raise Damaged("no digest in a broken member")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:record:([0-9-]+)>", fields.get(x, ""))) else None
    kind, given = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    try:
        digest = base64.b32decode(given[5:]).hex() if given else hashlib.sha1(block).hexdigest()
        size = int(fields.get("x-payload-length", len(block)))
    except ValueError:
        raise Damaged("payload fields") from None
    return {"warc_type": kind, "record_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "refers_to": number("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": block}


def _plain(window: _Window | _Member, start: int, proof: bool = False) -> tuple[dict, int]:
    """The uncompressed record at start, if asked for only with a digest, and where it ends."""
    fields, head = _head(window, start)
    length = int(fields["content-length"])
    if start + head + length + 4 > window.size:
        raise Damaged("cut off")
    data = window.get(start, head + length + 4)
    return _checked(fields, data[head : head + length], data[head + length :], proof), start + head + length + 4


class _Member:
    """The inflated bytes of a gzip member with the calls of a window, read in steps and dropped behind.

    A first pass finds where it ends (``end``), its inflated ``size`` and what is wrong with it (``reason``), and keeps small members.
    """

    def __init__(self, window: _Window, begin: int):
        self.window, self.begin, self.end, self.size, self.reason = window, begin, begin, 0, None
        self.marks, self.at, self.data = [(0, begin)], 0, bytearray()
        for data, self.end in self._inflated():
            self.size += len(data)
            self.marks.append((self.size, self.end))
            if self.size <= 4 * WINDOW:
                self.data += data
        if self.size <= 4 * WINDOW:
            self.steps = iter(())
        else:
            self._open()

    def _open(self) -> None:
        self.at, self.data, self.steps = 0, bytearray(), self._inflated()

    def _inflated(self) -> Iterator[tuple[bytes, int]]:
        """Inflated pieces and how far they reach in the file; of a broken member all before the break."""
        inflate, at = zlib.decompressobj(31), self.begin
        while not inflate.eof:
            data, before = self.window.get(at, PIECE), inflate.copy()
            if not data:
                self.reason = "cut off"
                return
            try:
                out = inflate.decompress(data)
            except zlib.error:
                self.reason = "gzip"
                for k in range(len(data)):
                    try:
                        out = before.decompress(data[k : k + 1])
                    except zlib.error:
                        return
                    if out:
                        yield out, at + k + 1
                return
            at += len(data)
            yield out, at - len(inflate.unused_data)

    def get(self, start: int, length: int) -> bytes:
        if start < self.at:
            self._open()
        while True:
            drop = min(start - self.at, len(self.data))
            del self.data[:drop]
            self.at += drop
            if self.at + len(self.data) >= start + length or (step := next(self.steps, None)) is None:
                return bytes(self.data[:length]) if self.at == start else b""
            self.data += step[0]

    def place(self, inner: int, after: bool = False) -> int:
        """The last known place in the file before the inflated byte inner, or the first one after all bytes before it."""
        if after:
            return self.marks[min(bisect.bisect_left(self.marks, (inner, 0)), len(self.marks) - 1)][1]
        return self.marks[bisect.bisect_right(self.marks, (inner, self.end)) - 1][1]


def _inside(member: _Member) -> Iterator[dict]:
    """Records of a member and gaps before or between them; leaves ``good``, where the last record ends, and ``lost``, why what follows it fails."""
    at, gap = 0, None
    member.good, member.lost = 0, None
    while at < member.size:
        try:
            one, done = _plain(member, at, member.reason == "gzip")
            if member.reason and at == 0 and done == member.size:
                raise Damaged(member.reason)  # a member of one record stands or falls with it
        except Damaged as e:
            if gap is None:
                gap, member.lost = at, str(e)
            at = _next(member, at + 1, packed=False)
            continue
        if gap is not None:
            yield {"kind": "gap", "start": member.place(gap), "end": member.place(at, True), "reason": member.lost}
            gap = member.lost = None
        yield {"kind": "record", "start": member.begin, "end": member.end, **one}
        member.good = at = done


def salvage(file: pa.NativeFile) -> Iterator[dict]:
    """Records and gaps of an archive, in order."""
    window, at, gap, reason = _Window(file), 0, None, ""
    told, until = set(), 0  # records of a broken member, which may lie in it unpacked and are met again then
    name = lambda r: tuple(r[x] for x in ("warc_type", "record_id", "url", "refers_to", "payload_digest"))
    while at < window.size:
        if at >= until:
            told.clear()
        if window.get(at, 10).startswith(GZIP):
            member = _Member(window, at)
            for r in _inside(member):
                if gap is not None and gap < at:
                    yield {"kind": "gap", "start": gap, "end": at, "reason": reason}
                gap = None
                if member.reason and r["kind"] == "record":
                    told.add(name(r))
                    until = member.end
                yield r
            if member.good and not member.reason:
                if member.lost:
                    yield {"kind": "gap", "start": member.place(member.good), "end": member.end, "reason": member.lost}
                at = member.end
                continue
            if gap is None:
                gap, reason = member.place(member.good), member.reason or member.lost or "empty member"
            at = _next(window, at + 1)
            continue
        try:
            one, end = _plain(window, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = _next(window, at + 1)
            continue
        if at < until and name(one) in told:
            at = end
            continue
        if gap is not None and gap < at:
            yield {"kind": "gap", "start": gap, "end": at, "reason": reason}
        gap = None
        yield {"kind": "record", "start": at, "end": end, **one}
        at = end
    if gap is not None:
        yield {"kind": "gap", "start": gap, "end": window.size, "reason": reason}


def _next(window: _Window | _Member, start: int, packed: bool = True) -> int:
    """The next place that looks like a member (if these may come) or a version line; the end if there is none."""
    at = start
    while at < window.size:
        data = window.get(at, WINDOW // 2)
        version = _VERSION.search(data)
        places = [data.find(GZIP) if packed else -1, version.start() if version else -1]
        if max(places) >= 0:
            return at + min(x for x in places if x >= 0)
        if at + len(data) >= window.size:
            break
        at += len(data) - 9  # a sign may lie across the border
    return window.size


def read(listing: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of the listed archives (column ``path``): one row each, by ``kind``."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.binary() if x.endswith("binary") else pa.int64() if x.endswith("long") else pa.string() for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(local) as file:
                    rows, size = [], 0
                    for r in salvage(file):
                        if not keep_payload:
                            r["payload"] = None
                        rows.append({**r, "path": path})
                        size += len(r.get("payload") or b"") + 500
                        if size > 4 << 20:
                            yield _batch(rows, names, kinds)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names, kinds)

    # One archive is one task's work; a listing is a few bytes for each 64 MB.
    return listing.select("path").repartition(F.col("path")).mapInArrow(run, RECORDS)


def _batch(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A listing of archives that are already there."""
    return spark.createDataFrame([(p,) for p in paths], "path string")
