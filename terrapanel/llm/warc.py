"""WARC archives: writing with revisits, and a reader that salvages damaged files.

Archives are written by Spark's text sink, so they go wherever Spark can write.
Each record is one gzip member; the sink's record separator is an empty member,
so a file is a plain series of members that any gzip reader unpacks to a WARC.

The reader checks every member (gzip checksum, record syntax, block and payload
digest). Where a check fails it looks for the next gzip member or version line
that holds a valid record, goes on from there and reports the bytes between as
a gap with the reason. Uncompressed archives are read the same way, and so is
the content of each member, also what can be unpacked of a damaged one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm.common import map_arrow, slices, text_or_empty

ROWS = 512  # rows handed on at a time
STEP = 1 << 14  # bytes unpacked at a time
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/"
HASHES = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+[ \t]*\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-record:"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY_MEMBER = _member(b"")


def record_bytes(kind: str, key: str | None, url: str | None, date: str, payload: bytes, digest: str, size: int,
                 refers_to: str | None = None) -> bytes:
    """One WARC record. A revisit has the head of the response only, which still states the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{quote(key or '', safe='')}>", f"WARC-Date: {date}"]
    if url is not None:
        # characters that a header line cannot hold, and the sign that escapes them, are percent-encoded
        head.append("WARC-Target-URI: " + "".join(quote(c) if c <= " " or c in "%\x7f\x85" else c for c in url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{URN}{quote(refers_to or '', safe='')}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _responses(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            key, url, text = (part.column(k).to_pylist() for k in range(3))
            payload = [t.encode() for t in text]
            digest = [hashlib.sha256(p).hexdigest() for p in payload]
            made = [_member(record_bytes("response", k, u, date, p, d, len(p))) for k, u, p, d in zip(key, url, payload, digest)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(digest, pa.string()), pa.array([len(p) for p in payload], pa.int64()), pa.array(made, pa.binary())],
                ["key", "url", "digest", "bytes", "member"])


def _revisits(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """Members as they are, or a revisit where `refers` names another record."""
    for batch in batches:
        made = [member if refers is None else _member(record_bytes("revisit", key, url, date, b"", digest, size, refers))
                for key, url, digest, size, member, refers in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 100, records_per_file: int = 2000) -> None:
    """Write one record for each row into archives below `path`.

    Of rows with equal payloads of at least `min_revisit_bytes`, the smallest
    key is a response and the others revisit it; rows that repeat the smallest
    key are responses too. A NULL payload counts as empty; a NULL key revisits
    a group's smallest key and is a response where there is none.
    """
    own = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), text_or_empty(f"`{payload}`").alias("text"))
    firsts = own.filter(F.octet_length("text") >= min_revisit_bytes).groupBy(F.sha2("text", 256).alias("same")).agg(
        F.min("id").cast("string").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = map_arrow(
        own.select(F.col("id").cast("string").alias("key"), "url", "text"), partial(_responses, date=date), "key string, url string, digest string, bytes long, member binary")
    refers = F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first"))
    joined = members.join(firsts, F.col("digest") == F.col("same"), "left").select(
        "key", "url", "digest", "bytes", F.when(refers.isNull(), F.col("member")).alias("member"), refers.alias("refers"))
    records = map_arrow(joined, partial(_revisits, date=date), "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option(
        "encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)


class Damaged(ValueError):
    """A record that fails a check."""


def _hash_name(stated: str) -> str:
    return stated.partition(":")[0].strip().lower().replace("-", "")


def _checkable(stated: str) -> bool:
    return _hash_name(stated) in HASHES


def _digest_ok(stated: str, data: bytes) -> bool:
    """Whether `data` has the digest, stated in hex or base32; others than HASHES are not checked."""
    if not _checkable(stated):
        return True
    value, made = stated.partition(":")[2].strip(), hashlib.new(_hash_name(stated), data)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def _length(stated: str) -> int:
    if not re.fullmatch("[0-9]{1,18}", stated.strip()):
        raise Damaged("no content length")
    return int(stated)


def _unchunked(payload: bytes) -> bytes:
    """The content of a chunked HTTP body; as it is where it is none."""
    out, at = [], 0
    while (head := re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n").match(payload, at)) and (size := int(head[1], 16)):
        out.append(payload[head.end():head.end() + size])
        at = head.end() + size + 2
    return b"".join(out) if head else payload


def _head_lines(data: bytes, pos: int) -> tuple[int, list[str]]:
    """(start of the block, lines after the version line) of the record at `pos`; a line may have any length."""
    version = _VERSION_LINE.match(data, pos)
    if not version:
        raise Damaged("no record head")
    at, lines = version.end(), []
    while (end := data.find(b"\r\n", at)) != at:
        if end < 0:
            raise Damaged("no record head")
        line = data[at:end]
        if b":" not in line and line[:1] not in (b" ", b"\t"):
            raise Damaged("bad head line")  # the next record's version line is one
        lines.append(line.decode("utf-8", "replace"))
        at = end + 2
    return at + 2, lines


def parse_record(data: bytes, pos: int) -> tuple[int, dict[str, str], bytes]:
    """(end, headers with lower-case names, block) of the record at `pos`."""
    start, lines = _head_lines(data, pos)
    heads = {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines) if s}
    end = start + _length(heads.get("content-length", ""))
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record cut short")
    block = data[start:end]
    if not _digest_ok(heads.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs")
    return end + 4, heads, block


def unpack_member(data: memoryview, pos: int) -> tuple[int, bytes, str]:
    """(end, content, fault) of the gzip member at `pos`; a few bytes at a time, so that what follows is never copied whole.

    A whole member has no fault; of another, the content is what could be unpacked before the fault.
    """
    unpack, out, at = zlib.decompressobj(31), [], pos
    while not unpack.eof:
        if at >= len(data):
            return at, b"".join(out), "member cut short"
        before = unpack.copy()
        try:
            out.append(unpack.decompress(data[at:at + STEP]))
        except zlib.error:
            break
        at = min(len(data), at + STEP)
    else:
        return at - len(unpack.unused_data), b"".join(out), ""
    try:  # the last step again, byte by byte up to the fault
        while at < len(data):
            out.append(before.decompress(data[at:at + 1]))
            at += 1
    except zlib.error:
        pass
    return at, b"".join(out), "bad member"


def _packed_end(data: memoryview, pos: int, size: int) -> int:
    """How far the member at `pos` has to be read for all but the last of the first `size` bytes of its content."""
    unpack, at, left = zlib.decompressobj(31), pos, size - 1
    while left > 0:
        step = data[at:at + STEP]
        left -= len(unpack.decompress(step, left))
        at += len(step) - len(unpack.unconsumed_tail)
    return at


def _member_at(view: memoryview, pos: int) -> tuple[int, Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]]:
    """(end, what `salvage` yields for it) of the gzip member at `pos`; of a damaged member, up to the end of its last valid record."""
    def placed(found: Iterator) -> Iterator:
        for a, b, heads, x in found:
            yield pos, end, heads, f"{x} (bytes {a} to {b} of the member's content)" if heads is None else x

    end, content, fault = unpack_member(view, pos)
    if not fault:
        return end, placed(_series(content, {VERSION: -1}))
    found = list(_series(content, {VERSION: -1}, fault == "bad member"))
    # the checksum is all that vouches for a head, so a bad member that is one record is a bad record
    alone = fault == "bad member" and len(found) == 1
    while found and found[-1][2] is None:
        found.pop()
    if not found or alone:
        raise Damaged(fault)
    end = min(_packed_end(view, pos, found[-1][1]), end - 1)  # so what is left is never empty
    return end, placed(iter(found))


def _series(data: bytes, ahead: dict[bytes, int], strict: bool = False) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """Records and gaps of `data`; `ahead` names the marks to go on at. `strict` takes only records with a digest that was checked."""
    view, pos, gap, reason = memoryview(data), 0, None, ""
    while pos < len(data):
        try:
            if MAGIC in ahead and data.startswith(MAGIC, pos):
                end, found = _member_at(view, pos)
            elif data.startswith(VERSION, pos):
                end, heads, block = parse_record(data, pos)
                if strict and not _checkable(heads.get("warc-block-digest", "")):
                    raise Damaged("no digest in a bad member")
                found = iter([(pos, end, heads, block)])
            else:
                raise Damaged("neither member nor version line" if MAGIC in ahead else "no version line")
        except Damaged as e:
            if gap is None:
                gap, reason = pos, str(e)
            for mark, at in ahead.items():  # each mark is searched for once over the file
                if at <= pos:
                    at = data.find(mark, pos + 1)
                    ahead[mark] = len(data) if at < 0 else at
            pos = min(ahead.values())
            continue
        if gap is not None:
            yield gap, pos, None, reason
            gap = None
        yield from found
        pos = end
    if gap is not None:
        yield gap, len(data), None, reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """(start, end, headers, block) of each valid record and (start, end, None, reason) of each gap, in order.

    What a gzip member holds has the member's start and end; the reason of a
    gap inside names its place in the unpacked content. Of a damaged member,
    what follows the last valid record is a gap of the file.
    """
    return _series(data, {MAGIC: -1, VERSION: -1})


_FIELDS = [("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()),
           ("key", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
           ("refers_to", pa.string()), ("payload", pa.string())]
READ_SCHEMA = ("archive string, start long, end long, gap string, record_type string, key string, url string, payload_digest string, "
               "payload_bytes long, refers_to string, payload string")


def _key(stated: str | None) -> str | None:
    return unquote((stated or "").strip("<>").removeprefix(URN)) or None


def _record(heads: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind = heads.get("warc-type")
    digest = heads.get("warc-payload-digest", "")
    # writers differ in whether the payload is the body as it was sent
    if kind == "response" and not _digest_ok(digest, payload) and not (
            re.search(rb"(?im)^transfer-encoding:.*chunked", http) and _digest_ok(digest, _unchunked(payload))):
        raise Damaged("payload digest differs")
    size = next((_length(x[15:]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")), len(payload))
    url = heads.get("warc-target-uri")
    return (kind, _key(heads.get("warc-record-id")), None if url is None else unquote(url), digest.partition(":")[2], size,
            _key(heads.get("warc-refers-to")), payload.decode("utf-8", "replace") if with_payload and kind == "response" else None)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])

    for batch in batches:
        for archive, content in zip(batch.column(0), batch.column(1)):
            name, rows = archive.as_py(), []
            for start, end, heads, block in salvage(content.as_py()):
                if heads is None:
                    rows.append((name, start, end, block, *[None] * 7))
                else:
                    try:
                        rows.append((name, start, end, None, *_record(heads, block, with_payload)))
                    except Damaged as e:
                        rows.append((name, start, end, str(e), *[None] * 7))
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record and every gap of the archives below `path`.

    A gap has its reason in `gap` and only archive, start and end besides;
    a record has NULL there. `payload` is NULL for revisits, and for all with
    payload=False. One archive is one task's work; an empty file has no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    return map_arrow(files.select("path", "content"), partial(_read, with_payload=payload), READ_SCHEMA)

