"""WARC archives: a writer of gzip members, one a record, and a salvage reader.

Writing: of records with equal payloads of LEAST bytes or more that with the largest page_id is the response and the others
are revisits of it.  Ids meet by payload digest and size; the group's largest id comes from a pre-aggregated count, and the
rows of a payload of a third of all pages are spread over tasks; payloads themselves only move once, by page.  A task writes
archives of about ARCHIVE_BYTES to the shared folder under names of its own and returns them as a manifest; only archives in
the stored manifest are read, so a task that runs again, or twice, leaves at most files that nobody reads.

Reading: salvage() takes one archive, gzip members or plain records.  A record counts if its version line and headers parse,
its length ends at a record end and its payload has the digest it names.  Otherwise the reader searches for the next place
from which a whole record can be read, in the archive or in what a member holds, and logs the bytes between as a gap with its
reason.  Records and gaps within a member have the member's offset and length.  Of a member that doesn't inflate to its end,
those records count that were inflated before and whose digest holds (it says nothing of their headers); what comes after the
last of them is a gap.

Defined results: a null payload is an empty one; a null url leaves the target out; a null page_id is read back as null and is
a revisit of any page with its payload; rows that repeat the largest page_id are all responses; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, map_batches, opened, shared_dir, stored, texts_of

LEAST = 1000
ARCHIVE_BYTES = 32_000_000
DATE = "2000-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_ID = "urn:page:"
_END = b"\r\n\r\n"
#: Bytes given to zlib at a time; what it hands back unused is copied, so this bounds it.
_STEP = 16_384


@dataclass(frozen=True)
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP headers of the block and the payload."""
        head, _, payload = self.block.partition(_END)
        lines = head.decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


@dataclass(frozen=True)
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(ValueError):
    pass


def _line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit without payload if refers_to is given; not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    lines += [] if url is None else [f"WARC-Target-URI: {_line(url)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at `at`."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    head = data.find(_END, at)
    if head < 0:
        raise Damaged("headers don't end")
    try:
        lines = data[at:head].decode("utf-8").split("\r\n")[1:]
    except UnicodeDecodeError:
        raise Damaged("headers aren't UTF-8") from None
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header has no colon")
        headers[name.strip().lower()] = value.strip()
    if "warc-type" not in headers or "warc-record-id" not in headers or not headers.get("content-length", "").isdecimal():
        raise Damaged("a header is missing")
    start = head + len(_END)
    end = start + int(headers["content-length"])
    if data[end : end + len(_END)] != _END:
        raise Damaged("the length doesn't lead to a record end")
    block = data[start:end]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and hashlib.sha1(block).hexdigest() != told[5:].lower():
        raise Damaged("the block has another digest")
    told = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and told.startswith("sha1:") and hashlib.sha1(block.partition(_END)[2]).hexdigest() != told[5:].lower():
        raise Damaged("the payload has another digest")
    return headers, block, end + len(_END)


def _digested(headers: dict[str, str]) -> bool:
    """Whether _parsed() held the record against a digest."""
    return any(headers.get(k, "").startswith("sha1:") for k in ("warc-block-digest", *["warc-payload-digest"] * (headers["warc-type"] == "response")))


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at `at` holds, its end, and why it ends too early, if so."""
    inflate, out, end = zlib.decompressobj(31), [], at
    while end < len(data) and not inflate.eof:
        before = inflate.copy()
        try:
            out.append(inflate.decompress(data[end : end + _STEP]))
        except zlib.error as e:
            try:  # what comes before the error
                for k in range(end, len(data)):
                    out.append(before.decompress(data[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(out), end, f"the member doesn't inflate: {str(e)[:60]}"
        end += _STEP
    return b"".join(out), min(end, len(data)) - len(inflate.unused_data), "" if inflate.eof else "the member doesn't end"


def _place(data: bytes, at: int, n: int) -> int:
    """The place by which the member at `at` has given n bytes."""
    inflate, done, end = zlib.decompressobj(31), 0, at
    while True:
        before = inflate.copy()
        try:
            size = len(inflate.decompress(data[end : end + _STEP]))
        except zlib.error:
            break
        if done + size >= n:
            break
        done, end = done + size, end + _STEP
    while done < n:
        done, end = done + len(before.decompress(data[end : end + 1])), end + 1
    return end


def _within(plain: bytes, broken: str) -> tuple[list[tuple[dict[str, str], bytes] | str], int]:
    """The records of what a member holds, a reason for each gap between them, and the end of the last."""
    found: list[tuple[dict[str, str], bytes] | str] = []
    at = last = 0
    gap: tuple[int, str] | None = None
    while at < len(plain):
        try:
            headers, block, end = _parsed(plain, at)
            if broken and not _digested(headers):
                raise Damaged("the member is broken and the record has no digest")
        except Damaged as e:
            gap = gap or (at, str(e))
            version = _VERSION.search(plain, at + 1)
            at = version.start() if version else len(plain)
            continue
        if gap:
            found.append(f"bytes {gap[0]} to {at} of the member: {gap[1]}")
        found.append((headers, block))
        at, last, gap = end, end, None
    if gap and not broken:
        found.append(f"bytes {gap[0]} to {at} of the member: {gap[1]}")
    return found, last


def _at(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """The records and gaps of the member, or the one plain record, at `at`, where it ends, and what is wrong from there on."""
    if data.startswith(_MAGIC, at):
        plain, end, broken = _inflated(data, at)
        found, last = _within(plain, broken)
        if (plain or broken) and not last:
            raise Damaged(broken or str(found[0]))
        if broken:
            end = _place(data, at, last)
        return [Gap(at, end - at, x) if isinstance(x, str) else Record(at, end - at, *x) for x in found], end, broken
    headers, block, end = _parsed(data, at)
    return [Record(at, end - at, headers, block)], end, ""


def _candidates(data: bytes, at: int) -> Iterator[int]:
    """Places from `at` on where a member or a version line may begin."""
    magic, version = data.find(_MAGIC, at), _VERSION.search(data, at)
    while magic >= 0 or version:
        if not version or 0 <= magic < version.start():
            yield magic
            magic = data.find(_MAGIC, magic + 1)
        else:
            yield version.start()
            version = _VERSION.search(data, version.start() + 1)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that can be read, and the gaps between them, in order."""
    at = 0
    while at < len(data):
        try:
            found, end, reason = _at(data, at)
        except Damaged as e:
            found, end, reason = [], at, str(e)
        yield from found
        if reason:
            start, end = end, len(data)
            for place in _candidates(data, max(start, at + 1)):
                try:
                    _at(data, place)
                except Damaged:
                    continue
                end = place
                break
            yield Gap(start, end - start, reason)
        at = end


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives to the folder; the manifest, read back from it: path, n_records, n_bytes."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    ids = rows.where(F.col("size") >= LEAST).select("page_id", "digest", "size")
    last = ids.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only ids meet by payload; payloads move once, by page and digest
    told = looked_up(ids, last, ["digest", "size"], "page_id").where("page_id IS NULL AND last IS NOT NULL OR page_id < last")
    told = told.select(F.col("page_id").alias("t_page"), F.col("digest").alias("t_digest"), F.col("last").alias("refers_to")).distinct()
    near = rows.join(told, F.col("page_id").eqNullSafe(F.col("t_page")) & (F.col("digest") == F.col("t_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(f"{folder}/archives")
        files.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, count, size, name = None, 0, 0, ""
        for batch in batches:
            for page, url, text, digest, to in zip(*(texts_of(batch, c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(page, url, text.encode("utf-8", "surrogatepass"), digest, to))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.record_batch([pa.array([x[k] for x in done]) for k in range(3)], ["path", "n_records", "n_bytes"])

    return stored(map_batches(near, work, "path string, n_records bigint, n_bytes bigint"), folder, "manifest")


def _number(text: str) -> int | None:
    m = re.fullmatch(rf"<{_ID}(-?[0-9]+)>", text)
    return int(m[1]) if m else None


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record and each gap of the archives that the manifest names; also where one has fewer records than were written."""

    def rows(data: bytes, path: str, written: int) -> Iterator[dict]:
        count = 0
        for x in salvage(data):
            if isinstance(x, Gap):
                yield {"path": path, "offset": x.offset, "length": x.length, "gap": x.reason}
                continue
            count += 1
            http, payload = x.http
            told = x.headers.get("warc-payload-digest", "")[5:]
            full = x.kind == "response"
            yield {
                "path": path, "offset": x.offset, "length": x.length, "gap": None, "page_id": _number(x.headers["warc-record-id"]), "payload_bytes": len(payload) if full else int(http.get("content-length", 0)),
                "payload_digest": hashlib.sha1(payload).hexdigest() if full else told, "record_type": x.kind, "refers_to": _number(x.headers.get("warc-refers-to", "")),
            }
        if count != written:
            yield {"path": path, "offset": len(data), "length": 0, "gap": f"{count} records of {written}"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(f"{folder}/archives")
        for batch in batches:
            for path, written in zip(texts_of(batch, "path"), texts_of(batch, "n_records"), strict=True):
                with files.open_input_file(f"{base}/{path}") as f:
                    data = f.read()
                own = []
                for row in rows(data, path, written):
                    own.append(row)
                    if len(own) >= 4096:
                        yield pa.RecordBatch.from_pylist(own, schema)
                        own = []
                if own:
                    yield pa.RecordBatch.from_pylist(own, schema)

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_batches(spread, work, "path string, offset bigint, length bigint, gap string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def query(pages: DataFrame) -> DataFrame:
    """All records that were written; a gap, or a record less, makes the job fail."""
    folder = shared_dir(pages.sparkSession)
    found = read(write(pages, folder), folder)
    lost = F.raise_error(F.concat(F.lit("gap in "), F.col("path"), F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), F.col("gap")))
    return found.where(F.when(F.col("gap").isNotNull(), lost.cast("boolean")).otherwise(F.lit(True))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id < g.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < g.last THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes = g.payload_bytes
"""
