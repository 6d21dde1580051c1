"""WARC archives: segmented records with chunked payloads, written and read by Spark's file sources."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.llm.common import map_batches, table
from pagemill.session import scratch_dir, settled

#: A record's block is cut into segments of at most so many bytes, its payload into chunks.
SEGMENT = 16 << 10
CHUNK = 8 << 10
#: Records of an archive: with SEGMENT, an archive stays under 18 MB, so a task can read it whole.
ARCHIVE_RECORDS = 1_000
#: Groups of equal payloads that are broadcast to the writers; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
DATE = "2024-01-01T00:00:00Z"

_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of ``data``."""
    parts = [b"%x\r\n%b\r\n" % (len(own := data[at : at + size]), own) for at in range(0, len(data), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of chunked framing; None if the framing is broken or doesn't end."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(headers: dict[str, str | None], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + _END.encode() + block


def _records(number: int, page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> Iterator[bytes]:
    record_id = f"<urn:uuid:{hashlib.md5(f'{number}/{page_id}'.encode()).hexdigest()}>"
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id,
        "WARC-Date": DATE,
        "WARC-Target-URI": url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{_base32_sha1(payload)}",
        "Content-Type": "application/http;msgtype=response",
        "X-Page-ID": None if page_id is None else str(page_id),
    }
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record({**headers, "WARC-Profile": profile, "X-Refers-To-Page-ID": str(first)}, _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT:
        yield _record(headers, block)
        return
    last = -(-len(block) // SEGMENT)
    for k in range(1, last + 1):
        own = headers if k == 1 else {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"<urn:uuid:{hashlib.md5(f'{number}/{page_id}/{k}'.encode()).hexdigest()}>",
            "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": record_id,
        }
        total = str(len(block)) if k == last else None
        yield _record({**own, "WARC-Segment-Number": str(k), "WARC-Segment-Total-Length": total}, block[(k - 1) * SEGMENT : k * SEGMENT])


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for each row of ``page_id, url, html`` to WARC files in the new folder ``path``.

    The payload is the html in UTF-8 (null: empty) in chunked framing. Among equal payloads of
    ``least`` bytes or more, the page of the smallest ``page_id`` is a response and the others revisit
    it; rows that repeat that page are responses too, and a null ``page_id`` is larger than others.
    Blocks over SEGMENT bytes become a record and continuations, which may lie in another archive.

    Only digests and ids are shuffled; pages stay where they are read, unless there are too many
    groups of copies to broadcast.
    """
    payload = F.coalesce("html", F.lit(""))
    given = pages.select("page_id", "url", payload.alias("html"), F.unhex(F.sha1(payload)).alias("digest"))
    copies = settled(
        given.where(F.octet_length("html") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .drop("n")
    )
    known = F.broadcast(copies) if copies.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else copies
    rows = given.join(known, "digest", "left").select(
        F.monotonically_increasing_id().alias("number"), "page_id", "url", "html", "first",
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            held, size = [], 0
            for number, page_id, url, html, first, revisit in zip(*columns, strict=True):
                for record in _records(number, page_id, url, html.encode(), first, revisit):
                    held.append(record)
                    size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    # The text sink writes a string's bytes as they are, and the line end after each closes the record.
    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", _END).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (lower-case names) and block of each record; ends at the first broken one."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode(errors="replace").split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if end < 0 or not size.isdigit() or end + 4 + int(size) > len(data):
            return
        at = end + 4 + int(size)
        yield headers, data[end + 4 : at]
        at += 4


def _decoded(block: bytes) -> bytes | None:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if re.search(rb"(?i)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b""), re.M) else body


_READ = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, problem string, payload binary"
_PART = f"{_READ}, segment int, total bigint, declared string, block binary"


def _finish(kind: str, declared: str | None, block: bytes, keep: bool) -> tuple:
    """``payload_bytes, payload_digest, problem, payload`` of a whole record."""
    if kind == "revisit":
        return None, declared, None, None
    payload = _decoded(block)
    if payload is None:
        return None, None, "broken framing", None
    digest = _base32_sha1(payload)
    if declared not in (None, digest):
        return None, None, "digest differs", None
    return len(payload), digest, None, payload if keep else None


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """A row for each record of the archives under ``path``, continuations joined to their origin.

    Segments are grouped by origin and put in order of their numbers; the numbers must be 1 to the
    last without a gap, the sum of their bytes the last one's total length, the chunked framing
    whole, and the payload of the declared digest. Otherwise ``problem`` says what is wrong and the
    payload columns are null. Revisits have no payload of their own, only its digest (see ``resolve_revisits``).
    Without ``keep_payload`` the payload stays null. Records that are whole are decoded where they
    are read; only the blocks of segments are shuffled.
    """
    kind = to_arrow_schema(StructType.fromDDL(_PART))
    number = lambda v: int(v) if v and re.fullmatch(r"-?\d+", v) else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_archive(content.as_py()):
                    declared = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    whole = "warc-segment-number" not in h
                    done = _finish(h.get("warc-type"), declared, block, keep_payload) if whole else (None,) * 4
                    rows.append((
                        h.get("warc-segment-origin-id", h.get("warc-record-id")), number(h.get("x-page-id")), h.get("warc-target-uri"),
                        h.get("warc-type"), number(h.get("x-refers-to-page-id")), *done, number(h.get("warc-segment-number")),
                        number(h.get("warc-segment-total-length")), declared, None if whole else block,
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    names = [x.split()[0] for x in _READ.split(", ")]

    def join_up(batch: pa.RecordBatch) -> dict:
        rows = []
        for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [[origin, *(p[k] for k in names[1:])] for p in parts if p["block"] is None]
            parts = [p for p in parts if p["block"] is not None]
            if not parts:
                continue
            head, block = parts[0], b"".join(p["block"] for p in parts)
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                done = None, None, "segments missing", None
            elif parts[-1]["total"] != len(block):
                done = None, None, "total length differs", None
            else:
                done = _finish(head["record_type"], head["declared"], block, keep_payload)
            rows.append([origin, *(head[k] for k in names[1:5]), *done])
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    parts = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _PART)
    fields = F.struct("segment", "total", "block", "declared", *names[1:])
    grouped = parts.groupBy("record_id").agg(F.sort_array(F.collect_list(fields)).alias("parts"))
    return map_batches(grouped, join_up, _READ)


def resolve_revisits(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Payload columns of revisits from the response they refer to: one of that ``page_id`` and of the digest that
    the revisit declares. ``problem`` if there is none; then the payload columns are null.

    A page on several records may have several payloads, so the id alone doesn't say which is meant. Without
    ``keep_payload`` only sizes are looked up, by a broadcast unless there are too many groups of copies.
    """
    records = settled(records)
    revisit = F.col("record_type") == "revisit"
    kept = ["payload_bytes", "payload"] if keep_payload else ["payload_bytes"]
    wanted = records.where(revisit).select(F.col("refers_to").alias("r_page_id"), F.col("payload_digest").alias("r_digest")).distinct()
    whole = records.where("record_type = 'response' and problem is null and page_id is not null")
    found = whole.groupBy(F.col("page_id").alias("r_page_id"), F.col("payload_digest").alias("r_digest")).agg(*(F.max(c).alias(f"r_{c}") for c in kept))
    found = found.join(wanted, ["r_page_id", "r_digest"], "left_semi")
    if not keep_payload:
        found = settled(found)
        found = F.broadcast(found) if found.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else found
    joined = records.join(found, revisit & (F.col("refers_to") == F.col("r_page_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    lost = revisit & F.col("problem").isNull() & F.col("r_page_id").isNull()
    return joined.select(
        "record_id", "page_id", "url", "record_type", "refers_to",
        F.coalesce("payload_bytes", "r_payload_bytes").alias("payload_bytes"), F.when(~lost, F.col("payload_digest")).alias("payload_digest"),
        F.when(lost, "response missing").otherwise(F.col("problem")).alias("problem"),
        (F.coalesce("payload", "r_payload") if keep_payload else F.col("payload")).alias("payload"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    back = resolve_revisits(read_archives(spark, path, keep_payload=False), keep_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("problem").isNull().alias("intact"))


QUERIES = {"op7_warc": op7_warc}
SQL = {
    "op7_warc": """
WITH RECURSIVE hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), quads AS (
  SELECT page_id, k, CAST('0x' || substr(hex, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT) AS v
  FROM hashed, range(8) t(k)
), digests AS (
  SELECT page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1), '' ORDER BY k) AS payload_digest
  FROM quads GROUP BY page_id
)
SELECT h.page_id, h.payload_bytes, d.payload_digest,
       CASE WHEN h.page_id = h.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN h.page_id = h.first THEN NULL ELSE h.first END AS refers_to,
       true AS intact
FROM hashed h JOIN digests d ON h.page_id = d.page_id
"""
}
