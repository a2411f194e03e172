"""WARC archives: a distributed writer and a salvage reader.

Writing: payload digests are grouped narrow (digest, largest id) and joined
back, so an equal payload is stored once and later copies become revisit
records. Every record is its own gzip member; the files go through Spark's
text sink, hence through its commit protocol and any file system it knows.
Between records the sink puts an empty gzip member, which any gunzip accepts.

Reading: a file is scanned record by record. When a record fails a check
(broken member, bad header, wrong length, wrong digest), the reader searches
for the next member or version line that begins a valid record, goes on from
there and logs the bytes between as a gap. The same is done inside a member
that holds several records, and with what a broken member still inflates.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from convolytics.llm.common import require_columns, scratch_path

_SEPARATOR = gzip.compress(b"", mtime=0)  # an empty member
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, min_revisit: int = 1000, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, url, body`` (UTF-8 bytes), ``bytes``, ``digest`` (SHA-1 hex),
    ``refers_to`` (the largest id with the same payload, for payloads of at
    least ``min_revisit`` bytes whose row has a smaller or null id).

    A null body is empty; a null url is left out of the record; rows that
    repeat the largest id are all responses, as are rows whose copies all
    have a null id. Other columns are not read.
    """
    require_columns(pages, [id_col, url_col, body_col])
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "utf-8")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"))
    src = src.withColumns({"bytes": F.octet_length("body").cast("long"), "digest": F.sha1("body")})
    groups = (
        src.filter(F.col("bytes") >= min_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("digest", "latest")
    )
    both = src.join(groups, "digest", "left")
    is_copy = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return both.select("page_id", "url", "body", "bytes", "digest", F.when(is_copy, F.col("latest")).alias("refers_to"))


def _member(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write_archives(records: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", records_per_file: int = 4096) -> None:
    """Writes the rows of ``plan_records`` as ``.txt`` files of gzip members
    under ``path`` (which must not exist), at most ``records_per_file`` to a
    file, so no file outgrows what one reading task holds."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c for c in batch.columns)):
                page, url, body, digest, refers = (x.as_py() for x in row)
                out.append(_member(page, url, body, digest, refers, date))
                size += len(out[-1])
                if size > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    cols = records.select("page_id", "url", "body", "digest", "refers_to")
    made = cols.mapInArrow(members, "member binary")
    # a cast of bytes to string keeps the bytes, and the sink writes them as they are
    writer = made.select(F.col("member").cast("string").alias("value")).write
    writer = writer.option("encoding", "ISO-8859-1").option("lineSep", _SEPARATOR.decode("latin-1"))
    writer.option("maxRecordsPerFile", records_per_file).option("compression", "none").text(path)


class BadRecord(ValueError):
    pass


def _digest(value: str, block: bytes) -> None:
    name, _, want = value.partition(":")
    if name.lower() != "sha1":
        return  # another algorithm: not checked
    got = hashlib.sha1(block).digest()
    if want.upper() != base64.b32encode(got).decode() and want.lower() != got.hex():
        raise BadRecord("digest does not match")


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at ``at``: its fields (lower-case names), its
    payload, and the place after it. Raises ``BadRecord``."""
    if not _VERSION.match(data, at):
        raise BadRecord("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise BadRecord("header does not end")
    fields: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise BadRecord("no content length")
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("length does not match")
    block = data[start:stop]
    if "warc-block-digest" in fields:
        _digest(fields["warc-block-digest"], block)
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields["http-" + name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields:
        _digest(fields["warc-payload-digest"], payload)
    return fields, payload, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The content of the member at ``at``, the place after it and, if it is
    broken or cut off, why: then the content goes as far as it inflates."""
    inflater = zlib.decompressobj(31)
    out, pos, why = [], at, ""
    while not inflater.eof and pos < len(data):
        # the rest of the file is passed as a view; the inflater stops at the member's end
        piece = memoryview(data)[pos : pos + (1 << 20)]
        before = inflater.copy()
        try:
            out.append(inflater.decompress(piece))
        except zlib.error as e:
            why = f"broken member: {e}"
            try:
                for i in range(len(piece)):  # a failed call gives nothing of what it inflated
                    out.append(before.decompress(piece[i : i + 1]))
            except zlib.error:
                break
        pos += len(piece)
    if not why and not inflater.eof:
        why = "member does not end"
    return b"".join(out), min(pos, len(data)) - len(inflater.unused_data), why


def _inner(inner: bytes, sure: bool) -> Iterator[tuple[str | None, dict[str, str] | None, bytes | None]]:
    """``None, fields, payload`` of every record in a member's content, and
    ``reason, None, None`` of every gap in it. Unless ``sure``, a record
    counts only if a digest of it was checked."""
    pos, gap, reason = 0, -1, ""
    while pos < len(inner):
        if gap < 0 and inner[pos] in b"\r\n":
            pos += 1
            continue
        try:
            fields, payload, after = parse_record(inner, pos)
            if not sure and not any(fields.get(f, "").lower().startswith("sha1:") for f in _checked(fields)):
                raise BadRecord("no digest to check in a broken member")
        except BadRecord as e:
            if gap < 0:
                gap, reason = pos, str(e)
            start = _VERSION.search(inner, pos + 1)
            pos = start.start() if start else len(inner)
            continue
        if gap >= 0:
            yield f"{reason} (bytes {gap} to {pos} of the member's content)", None, None
            gap = -1
        yield None, fields, payload
        pos = after
    if gap >= 0:
        yield f"{reason} (bytes {gap} to {pos} of the member's content)", None, None


def _checked(fields: dict[str, str]) -> list[str]:
    """The digest fields that ``parse_record`` checks."""
    return ["warc-block-digest", *(["warc-payload-digest"] if fields.get("warc-type") == "response" else [])]


class BrokenMember(BadRecord):
    """Carries what ``_inner`` found in what still inflates."""

    def __init__(self, why: str, found: list):
        super().__init__(why)
        self.found = found


def _unit(data: bytes, at: int) -> tuple[list[tuple[str | None, dict[str, str] | None, bytes | None]], int]:
    """What the member or plain record that begins at ``at`` holds, as of
    ``_inner``, and the place after it."""
    if data[at : at + 3] == b"\x1f\x8b\x08":
        inner, after, why = _inflate(data, at)
        found = list(_inner(inner, not why.startswith("broken")))
        if why:
            # a lone record counts only if a digest of it was checked
            kept = [x for x in found if x[0] is None]
            if len(found) == 1 and not any(f in x[1] for x in kept for f in _checked(x[1])):
                kept = []
            raise BrokenMember(why, kept)
        if found and all(reason for reason, _, _ in found):
            raise BadRecord(found[0][0])
        return found, after
    fields, payload, after = parse_record(data, at)
    return [(None, fields, payload)], after


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str | None, dict[str, str] | None, bytes | None]]:
    """Every record and gap of a file: ``("record", offset, length, None,
    fields, payload)`` or ``("gap", offset, length, reason, None, None)``.
    Records and gaps cover the file without overlap, but for those of one
    member, which all have the member's bytes: a gap inside it gives its
    place in the content as its reason, and records that a broken member
    still holds have the bytes of the gap it lies in. White space between
    records and empty members are neither."""
    at, gap, reason = 0, -1, ""
    kept: list[tuple[dict[str, str], bytes]] = []  # of broken members in the gap
    while at < len(data):
        if gap < 0 and data[at] in b"\r\n":
            at += 1
            continue
        try:
            found, after = _unit(data, at)
        except BadRecord as e:
            if gap < 0:
                gap, reason = at, str(e)
            if isinstance(e, BrokenMember):
                kept += [(fields, payload) for _, fields, payload in e.found]
            start = _START.search(data, at + 1)
            at = start.start() if start else len(data)
            continue
        if gap >= 0:
            yield "gap", gap, at - gap, reason, None, None
            for fields, payload in kept:
                yield "record", gap, at - gap, None, fields, payload
            gap, kept = -1, []
        for why, fields, payload in found:
            yield "gap" if why else "record", at, after - at, why, fields, payload
        at = after
    if gap >= 0:
        yield "gap", gap, len(data) - gap, reason, None, None
        for fields, payload in kept:
            yield "record", gap, len(data) - gap, None, fields, payload


_READ_SCHEMA = (
    "path string, kind string, offset long, length long, reason string, "
    "fields map<string,string>, payload binary, payload_bytes long, payload_sha1 string"
)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (``kind`` record) and quarantined byte ranges (``kind`` gap) of
    all files under ``path``, gzip members or plain records. One task holds
    one file at a time. ``payload_sha1`` is computed from the payload read;
    for a revisit it is the digest its header names, and ``payload_bytes``
    the length its HTTP header names."""
    arrow = pa.schema(
        [("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
         ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
         ("payload_sha1", pa.string())]
    )

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for kind, offset, length, reason, fields, payload in salvage(data):
            size = sha = None
            if fields is not None and fields.get("warc-type") == "revisit":
                named = fields.get("http-content-length", "")
                size = int(named) if named.isdigit() else None
                _, _, coded = fields.get("warc-payload-digest", "").partition(":")
                try:
                    sha = base64.b32decode(coded).hex() if len(coded) == 32 else coded.lower() or None
                except ValueError:
                    sha = None
            elif payload is not None:
                size, sha = len(payload), hashlib.sha1(payload).hexdigest()
            yield (name, kind, offset, length, reason, list(fields.items()) if fields is not None else None,
                   payload if with_payload else None, size, sha)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                out, held = [], 0
                for row in rows(name.as_py(), content.as_py()):
                    out.append(row)
                    held += len(row[6] or b"") + 256
                    if held > 32 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInArrow(scan, _READ_SCHEMA)


def page_digests(records: DataFrame) -> DataFrame:
    """What the archives say about each page: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``."""

    def page(field: str):
        text = F.regexp_extract(F.col("fields")[field], r"^<urn:page:(-?\d+)>$", 1)
        return F.when(text != "", text.cast("long"))

    return records.filter(F.col("kind") == "record").select(
        page("warc-record-id").alias("page_id"),
        "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"),
        F.col("fields")["warc-type"].alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Writes the pages under the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(plan_records(pages, min_revisit), path)
    return page_digests(read_archives(pages.sparkSession, path, with_payload=False))
