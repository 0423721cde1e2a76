"""WARC archives with deduplicated payloads, and a reader that salvages damaged ones.

Writer: each partition writes archives of about ARCHIVE_BYTES, one gzip member a record,
into the shared folder under a name of its own attempt; the manifest it returns lists the
finished ones, so files of lost attempts are never read. Reader: a member has to inflate,
pass its CRC and hold well-formed records whose blocks have the stated digests, if any. Where
that fails, the reader looks for the next place at which a valid member (or, in archives
that aren't compressed, a valid version line) starts, goes on there, and logs the bytes
between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ARCHIVE_BYTES = 32 << 20
VERSION = b"WARC/1.1\r\n"
_GZIP = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[0-9]+\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]+\r\n")
_DATE = "2024-01-01T00:00:00Z"
#: Inflated bytes of one record at most, against damaged or hostile members: above what the
#: writer makes of the longest texts (2^31 bytes of html, three for each of 2^31 of the URL).
RECORD_LIMIT = 9 << 30
#: Bytes of a header block at most where none are inflated, above the longest URL's as well.
HEADER_LIMIT = 7 << 30
#: Compressed bytes that are inflated at once.
_PIECE = 1 << 16
#: Repeated payloads (a hash and a page_id each) that are broadcast at most; more are joined by salted keys.
BROADCAST_ROWS = 500_000
SALTS = 64


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    payload: bytes


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


def _safe(value: str) -> str:
    """Header value on one line; controls and % as %XX of their UTF-8 bytes."""
    return "".join(c if c.isprintable() and c != "%" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in value)


def _unsafe(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value, errors="replace")


def build_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record with its payload, or a revisit without it when refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    seed = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}|{url}|{digest}|{kind}")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{seed}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", _safe(url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    body = payload if refers_to is None else b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + lines + b"\r\n" + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def _covers_block(headers: dict[str, str]) -> bool:
    """Whether the payload is the whole block: not where HTTP headers come before it."""
    return headers["warc-type"] in ("response", "resource") and not headers.get("content-type", "").lower().startswith("application/http")


def _differs(stated: str | None, block: bytes) -> bool:
    """Whether a stated SHA-1 (base 32 or hex) isn't the block's; other digests aren't checked."""
    kind, _, value = (stated or "").partition(":")
    return kind.lower() == "sha1" and value.upper() not in (digest_of(block), hashlib.sha1(block).hexdigest().upper())


def parse_record(data: bytes, at: int = 0, header_limit: int | None = None) -> tuple[Record, int] | str:
    """The record at ``at`` and its end, or why there is none. Headers may reach to the end of
    ``data`` unless limited."""
    line = _LINE.match(data, at)
    if line is None:
        return "no version line"
    stop = data.find(b"\r\n\r\n", at, len(data) if header_limit is None else at + header_limit)
    if stop < 0:
        return "headers without end"
    headers: dict[str, str] = {}
    name = b""
    for row in data[line.end():stop].split(b"\r\n") if stop >= line.end() else ():
        folded = row[:1] in (b" ", b"\t") and name
        if not folded:
            name, colon, row = row.partition(b":")
            if not colon:
                return "malformed header"
        try:
            key, value = name.decode("ascii").strip().lower(), row.decode("utf-8").strip()
        except UnicodeDecodeError:
            return "malformed header"
        headers[key] = f"{headers[key]} {value}" if folded else value
    if "warc-type" not in headers:
        return "no record type"
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        return "no content length"
    body = stop + 4
    end = body + length
    if length < 0 or data[end:end + 4] != b"\r\n\r\n":
        return "content length doesn't fit"
    payload = data[body:end]
    if _covers_block(headers) and _differs(headers.get("warc-payload-digest"), payload):
        return "payload digest differs"
    if _differs(headers.get("warc-block-digest"), payload):
        return "block digest differs"
    return Record(headers, payload), end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | str:
    """One gzip member at ``at``: its content and end; CRC and size are checked.

    Goes on piece by piece, so that what follows the member is never copied.
    """
    d, view, out, size = zlib.decompressobj(31), memoryview(data), [], 0
    while at < len(data) and not d.eof:
        try:
            out.append(d.decompress(view[at:at + _PIECE]))
        except zlib.error as e:
            return f"bad member: {str(e)[:60]}"
        at = min(at + _PIECE, len(data))
        size += len(out[-1])
        if size > RECORD_LIMIT:
            return "member too large"
    if not d.eof:
        return "member without end"
    return b"".join(out), at - len(d.unused_data)


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """All records that can be read, in order, and the gaps between them."""
    at, n = 0, len(data)
    bad, why = None, ""
    while at < n:
        got = _unit(data, at)
        if isinstance(got, str):
            if bad is None:
                bad, why = at, got
            at = _next_start(data, at + 1)
            continue
        records, end = got
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield from records
        at = end
    if bad is not None:
        yield Gap(bad, n, why)


def _unit(data: bytes, at: int) -> tuple[list[Record | Gap], int] | str:
    if data.startswith(_GZIP, at):
        got = _inflate(data, at)
        if isinstance(got, str):
            return got
        out, inside = [], 0
        while inside < len(got[0]):
            inner = parse_record(got[0], inside)
            if isinstance(inner, str):
                if not out:
                    return inner
                out.append(Gap(at, got[1], f"in the member after {len(out)} records: {inner}"))
                break
            out.append(inner[0])
            inside = inner[1]
        return out, got[1]
    got = parse_record(data, at, HEADER_LIMIT)
    return got if isinstance(got, str) else ([got[0]], got[1])


def _next_start(data: bytes, at: int) -> int:
    """The next place that looks like a member or a version line; the end if there is none."""
    found = _START.search(data, at)
    return found.start() if found else len(data)


def _files(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, limit: int):
    def run(batches):
        files, top = _files(folder)
        files.create_dir(top, recursive=True)
        out, name, size, count = None, "", 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 32):
                for r in b.slice(at, 32).to_pylist():
                    payload = (r["html"] or "").encode()
                    if out is None:
                        name, size, count = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(name, compression=None)
                    digest = base64.b32encode(r["sha"]).decode()
                    data = member(build_record(r["page_id"], r["url"], payload, digest, r["refers_to"]))
                    out.write(data)
                    size += len(data)
                    count += 1
                    if size >= limit:
                        out.close()
                        out = None
                        yield _manifest(folder, name, size, count)
        if out is not None:
            out.close()
            yield _manifest(folder, name, size, count)

    return run


def _manifest(folder, name, size, count):
    path = f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}"
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])


def with_references(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, html, sha, refers_to): SHA-1 of the payload, and for all but the
    largest page_id of equal payloads that page_id.

    Only hashes are grouped. Repeated ones are counted, then broadcast, so that payloads stay
    where they are read; above BROADCAST_ROWS of them the rows of a payload are dealt out by
    salts before they are joined.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    first = rows.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    first = scratch.save(first, "repeated")
    if first.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(first), "sha", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        out = salted.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["sha", "salt"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return out.select("page_id", "url", "html", "sha", refers.alias("refers_to"))


def write(pages: DataFrame, scratch: Scratch, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns their manifest (path, bytes, records).

    Null urls and htmls are empty, null page_ids are left out of the headers, repeated rows are
    records of their own, texts of any length are written whole. An empty table gives no
    archive; other columns are not looked at.
    """
    folder = f"{scratch.root}/archives-{uuid.uuid4().hex}"
    rows = with_references(pages, scratch)
    return scratch.save(rows.mapInArrow(_write(folder, archive_bytes), "path string, bytes long, records long"), "manifest")


READ_DDL = "path string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, gap_reason string"


def _read(with_payload: bool, whole_archives: bool):
    def rows(path):
        files, inner = _files(path)
        with files.open_input_stream(inner, compression=None) as f:
            data = f.read()
        whole = lambda h, k: int(h[k]) if re.fullmatch("-?[0-9]{1,18}|-?[0-9]{19}", h.get(k, "")) else None
        for x in read_archive(data):
            if isinstance(x, Gap):
                yield {"path": path, "gap_start": x.start, "gap_end": x.end, "gap_reason": x.reason}
                continue
            h = x.headers
            kind = h["warc-type"]
            size = whole(h, "x-payload-length") if kind == "revisit" else len(x.payload)
            digest = digest_of(x.payload) if _covers_block(h) else h.get("warc-payload-digest")
            digest = digest and digest.removeprefix("sha1:")
            yield {"path": path, "page_id": whole(h, "x-page-id"), "url": _unsafe(h.get("warc-target-uri", "")), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": whole(h, "x-refers-to-page"), "payload": x.payload if with_payload else None}

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string())])
        for b in batches:
            for path, records in zip(*(c.to_pylist() for c in b.columns)):
                held, size, found, lost = [], 0, 0, None
                for r in rows(path):
                    held.append(r)
                    found += "gap_reason" not in r
                    lost = lost or r.get("gap_reason")
                    size += 200 + len(r.get("payload") or b"")
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)
                if whole_archives and (found != records or lost):
                    raise ValueError(f"{path}: {found} of {records} records can be read, {lost or 'no gap'}")

    return run


def read(manifest: DataFrame, with_payload: bool = True, whole_archives: bool = False) -> DataFrame:
    """Records of all archives, and gaps as rows with gap_start, gap_end and gap_reason only.

    Records of other types and writers pass through: payload_bytes of a revisit is null where
    its writer doesn't state it, payload_digest is the stated one where the payload isn't the
    whole block.

    whole_archives: a gap, or a count of records that isn't the manifest's, is an error.
    """
    n = manifest.count()
    paths = manifest.select("path", "records" if whole_archives else F.lit(None).cast("long").alias("records"))
    spread = paths.repartition(max(1, n), "path") if n else paths
    return spread.mapInArrow(_read(with_payload, whole_archives), READ_DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    """One row per page read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of equal payloads the largest page_id is the
    response (each row that has it, if rows repeat); the others, null page_ids too, revisit
    it. Where a payload's page_ids are all null, all are responses. Other columns than
    page_id, url and html are not looked at; an empty table gives an empty result. A record
    that can't be read back is an error.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    back = read(write(pages, scratch), with_payload=False, whole_archives=True)
    return back.where("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
