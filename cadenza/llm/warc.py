"""WARC archives: pages written as records, and a reader that goes on after damage.

Spark writes and reads the files themselves, so they may lie in any store that it reaches, and its commit protocol
decides which task's files count. A record is a gzip member of its own; Spark's text writer puts one byte after each row,
and that byte is made the member's last one, so a file is members alone.

The reader checks each member (checksum, version line, lengths, digest). Where a check fails it searches for the next
offset at which a whole record passes all checks, a gzip member or a plain record that begins with a version line, goes
on there, and logs the bytes between as a gap with the reason. Files may mix both kinds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, short_batches

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
PIECE = 1 << 16
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NAME = re.compile(rb"[!#-'*+.^-z|~\-0-9A-Z]+[ \t]*")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_SPACE = uuid.UUID("6f1f3a52-8f0f-5b0e-9a55-3d1f5f0c2a11")

#: What the reader gives: records (gap null) and gaps (gap says why; other columns but path, start and size null).
READ = ("path string, start long, size long, gap string, record_type string, record_id string, target string, date string, refers_to_id string, payload_digest string, "
        "payload_bytes long, payload binary, page_id long")
_READ = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target", pa.string()),
                   ("date", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("page_id", pa.int64())])


def record(kind: str, ident: str, page_id: int | None, url: str | None, sha1: bytes, size: int, payload: bytes | None, date: str, refers_to: str | None = None) -> bytes:
    """A response with its payload, or a revisit, which has the response's HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:  # an address can't hold line ends
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to:
        lines += [f"WARC-Refers-To: <urn:uuid:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member without its last byte, which is zero: it is the top byte of the length. Data of 16 MB or more get an
    empty member after theirs, whose length is zero anyway."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return (out if out[-1] == 0 else out + _EMPTY)[:-1]


class Damaged(ValueError):
    pass


def parsed(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises Damaged with the check that failed."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header without end")
    fields: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name):
            raise Damaged("header line without a name and a colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if missing := [n for n in ("warc-type", "warc-record-id", "warc-date") if n not in fields]:
        raise Damaged(f"no {missing[0]}")
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Damaged("no content length")
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block shorter or longer than its content length")
    block = data[begin:end]
    if (digest := fields.get("warc-block-digest")) and not _agrees(digest, block):
        raise Damaged("block digest")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
        size = int(told[1]) if told else len(payload)
    if fields.get("warc-type") == "revisit":
        payload = None
    elif (digest := fields.get("warc-payload-digest")) and not _agrees(digest, payload):
        raise Damaged("payload digest")
    return fields | {"": payload, "size": size}, end + 4


def _agrees(digest: str, data: bytes) -> bool:
    """Whether a sha1 in base 32 or hexadecimal is that of the data; other algorithms are taken on trust."""
    name, _, told = digest.partition(":")
    if name.lower() != "sha1":
        return True
    sha1 = hashlib.sha1(data)
    return told.upper() == base64.b32encode(sha1.digest()).decode() or told.lower() == sha1.hexdigest()


def _hex(digest: str | None) -> str | None:
    if not digest:
        return None
    told = digest.partition(":")[2]
    try:
        return base64.b32decode(told.upper()).hex() if len(told) == 32 else told.lower()
    except ValueError:
        return told


def _member_at(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's text and where the member ends. It is fed piece by piece, so what follows isn't copied."""
    z, out = zlib.decompressobj(31), []
    while at < len(data) and not z.eof:
        try:
            out.append(z.decompress(memoryview(data)[at : at + PIECE]))
        except zlib.error as e:
            raise Damaged("member: " + str(e).rpartition(": ")[2]) from None
        at += PIECE
    if not z.eof:
        raise Damaged("member without end")
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def _records_at(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of what stands at ``at`` (a member may hold several, or none) and where it ends."""
    if data[at : at + 3] != MAGIC:
        one, end = parsed(data, at)
        return [one], end
    text, end = _member_at(data, at)
    found, inner = [], 0
    while inner < len(text):
        one, inner = parsed(text, inner)
        found.append(one)
    return found, end


def salvaged(data: bytes) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(start, size, why, record) of all of a file's bytes in order: records (why null) and gaps (record null)."""
    at = 0
    while at < len(data):
        try:
            found, end = _records_at(data, at)
        except Damaged as bad:
            after = at
            while True:
                start = _START.search(data, after + 1)
                after = start.start() if start else len(data)
                if not start:
                    break
                try:
                    found, end = _records_at(data, after)
                except Damaged:
                    continue
                if found:
                    break
            yield at, after - at, str(bad), None
            at = after
            continue
        for one in found:
            yield at, end - at, None, one
        at = end


def _written(run: str, date: str, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        name = lambda *of: str(uuid.uuid5(_SPACE, ":".join(map(str, (run, *of)))))
        for batch in batches:
            out = []
            for page_id, url, payload, key, shared, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "key", "shared", "refers")), strict=True):
                n += 1
                ident = name(key) if shared and not refers else name(task, n, page_id)
                kind = "revisit" if refers else "response"
                url = None if url is None else url.decode("utf-8", "replace")
                one = record(kind, ident, page_id, url, hashlib.sha1(payload).digest(), len(payload), None if refers else payload, date, name(key) if refers else None)
                out.append(member(one, level))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return go


def write(pages: DataFrame, path: str, scratch: Scratch, least: int = 1000, level: int = 3, date: str | None = None) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives in the folder ``path``, one a task.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of ``least`` bytes or more the one
    with the largest page_id (null smallest; any one of rows that repeat it) holds the payload, the others revisit it.
    Payloads are compared by SHA-256; the table of those that repeat is joined, broadcast only if Spark sees that it is
    small. The frame's rows must come in the same partitions each time it is read, as a table's do. Addresses are
    written with line ends and blanks escaped, null ones left out. Other columns are left out.
    """
    spark = pages.sparkSession
    short_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "row": F.monotonically_increasing_id(), "large": F.octet_length("payload") >= least})
    groups = rows.where("large").groupBy("key").agg(F.max(F.struct("page_id", "row")).alias("top"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.write(groups.select(F.col("key").alias("of"), F.col("top.row").alias("top")), "groups")
    rows = rows.join(groups, F.col("large") & (F.col("key") == F.col("of")), "left")
    rows = rows.select("page_id", "url", "payload", "key", F.col("top").isNotNull().alias("shared"), F.coalesce(F.col("row") != F.col("top"), F.lit(False)).alias("refers"))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    members = rows.mapInArrow(_written(uuid.uuid4().hex, date, level), "member binary")
    # the cast keeps the bytes as they are, and the separator is each member's last byte
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)
    scratch.drop("groups")


def _read(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for start, length, why, got in salvaged(content.as_py()):
                    if got is None:
                        held.append((path, start, length, why, *[None] * 9))
                    else:
                        payload, page = got[""] if payloads else None, got.get("x-page-id", "")
                        held.append((
                            path, start, length, None, got.get("warc-type"), got.get("warc-record-id"), got.get("warc-target-uri"), got.get("warc-date"), got.get("warc-refers-to"),
                            _hex(got.get("warc-payload-digest")), got["size"], payload, int(page) if re.fullmatch("-?[0-9]{1,18}", page) else None))
                        size += len(payload or b"")
                    if len(held) >= 2000 or size > BATCH_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return go


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (columns of READ) of all archives in a folder, or of one file, with .gz or without.

    Damage costs the records it lies in: reading goes on at the next whole record, and a row with ``gap`` says what check
    failed and which bytes of the file are left out. Start and size are those of the member or plain record; records of
    one member share them. Without ``payloads`` that column is null; lengths and digests are checked all the same. An
    archive is read by one task, which holds its bytes (Spark stops above 2 GB) and one member's text.
    """
    short_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(payloads), READ)


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages written to archives in the shared folder and read back: page_id, payload_bytes, payload_digest (SHA-1 in
    hexadecimal), record_type, refers_to (the page_id of the response that a revisit names).

    A row for each row of ``pages``; an empty table gives none. Raises if the archives have gaps.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write(pages, f"{scratch.root}/archives", scratch, least)
    got, seen = scratch.counted(read(spark, f"{scratch.root}/archives", payloads=False), "records", F.count_if(F.col("gap").isNotNull()).alias("gaps"))
    if seen["gaps"]:
        raise RuntimeError(f"{seen['gaps']} gaps in archives just written")
    scratch.drop("archives")
    out = got.select("page_id", "payload_bytes", "payload_digest", "record_type")
    known = got.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"))
    again = got.where("record_type = 'revisit'").join(known, F.col("refers_to_id") == F.col("of"), "left").select(*out.columns, "refers_to")
    return out.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)
