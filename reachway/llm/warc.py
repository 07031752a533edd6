"""WARC archives of web pages, and a reader that salvages what is left of damaged ones.

Writing: a record for each page, one gzip member a record (or plain), collected to archives of bounded size; each archive is one row that Spark's
text writer puts in a file of its own, on whatever store the session uses. Pages with equal payloads are stored once: the page with the largest id
is a response, the others are revisits that refer to it.

Reading: every member is inflated and checked (gzip check sum, version line, header, length, block end, payload digest). After a failed
check the reader searches for the next gzip member or version line that passes them, goes on from there, and reports the bytes between as a
quarantined gap. The same search runs over a member's inflated bytes, so that a bad record among several, or damage inside a member, costs no sound record before it.
Headers have no length limit: their end is searched up to the end of the member or file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachway.llm.common import prepare, remove, shared_dir

#: Bytes at which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Digests of several rows that are broadcast at most (some 60 bytes each), and rows of a digest from which on it counts as hot beyond that.
BROADCAST_DIGESTS, HOT_ROWS = 500_000, 100_000
#: Byte that ends a file of members: gzip readers skip zero padding. Plain records end with two line ends anyway.
GZIP_END, PLAIN_END = "\x00", "\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_URN = "urn:reachway:page:"
RECORD = "archive string, start long, end long, problem string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(lines: list[tuple[str, object]]) -> bytes:
    clean = (f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in lines if v is not None)
    return ("WARC/1.1\r\n" + "\r\n".join(clean) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record without the two line ends that close it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    return _head([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_URN}{page_id}>"),
        ("WARC-Target-URI", url),
        ("WARC-Date", "2025-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<{_URN}{refers_to}>" if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]) + block


def _info() -> bytes:
    block = b"software: reachway\r\nformat: WARC File Format 1.1\r\n"
    return _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'reachway')}>"), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block


def member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data + b"\r\n\r\n") + c.flush()


def archives(compress: bool, limit: int):
    """Rows (page_id, url, payload, refers_to, revisit) to rows that hold a whole archive each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = member if compress else (lambda x: x)
        parts, held = [], 0

        def close() -> pa.RecordBatch:
            whole = b"".join(parts) if compress else PLAIN_END.encode().join(parts)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["archive"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not parts:
                    parts.append(form(_info()))
                page_id, url, payload, refers_to, revisit = row
                parts.append(form(record(page_id, url, payload or b"", refers_to, revisit)))
                held += len(parts[-1])
                if held >= limit:
                    yield close()
                    parts, held = [], 0
        if parts:
            yield close()

    return run


def _with_first(slim: DataFrame, min_bytes: int, broadcast_digests: int, hot_rows: int) -> DataFrame:
    """slim (page_id, url, payload, sha) with first: the largest page_id of rows that share a payload, null for payloads of one row or of too few bytes.

    Payloads are never dealt by their digest. Up to broadcast_digests shared digests go to all executors, and rows don't move at all. More of them are joined to page ids alone, digests of over hot_rows rows (few, by
    their very number) by a broadcast, and rows find what they refer to by their own id.
    """
    light = slim.filter(F.length("payload") >= min_bytes).select("page_id", "sha")
    shared = light.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").checkpoint()
    if shared.count() <= broadcast_digests:
        return slim.join(F.broadcast(shared.select("sha", "first")), "sha", "left")
    hot = light.join(F.broadcast(shared.filter(F.col("n") > hot_rows).select("sha", "first")), "sha")
    rest = light.join(F.broadcast(shared.filter(F.col("n") > hot_rows).select("sha")), "sha", "left_anti").join(shared.filter(F.col("n") <= hot_rows).select("sha", "first"), "sha")
    own = hot.unionByName(rest).select(F.col("page_id").alias("own"), F.col("sha").alias("own_sha"), "first").distinct()
    return slim.join(own, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("sha") == F.col("own_sha")), "left").drop("own", "own_sha")


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES, broadcast_digests: int = BROADCAST_DIGESTS, hot_rows: int = HOT_ROWS
) -> str:
    """Writes a record for each row of pages (page_id, url, html) to archives under path.

    Of rows with equal payloads of at least min_bytes bytes, those with the largest page_id are responses and the others revisits of it; a null
    page_id is less than any other. A null html is an empty payload, a null url leaves its header out; an empty table gives no records; url and html may have any
    length that a row of Spark has (2 GB); other columns, whatever their names, are ignored. Payloads are compared by their SHA-1, and don't move for that (_with_first).
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    both = _with_first(slim, min_bytes, broadcast_digests, hot_rows)
    revisit = F.coalesce(F.col("first").isNotNull() & (F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    rows = both.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    whole = rows.mapInArrow(archives(compress, archive_bytes), "archive binary")
    whole.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", GZIP_END if compress else PLAIN_END).option("maxRecordsPerFile", 1).text(path)
    return path


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at this place, its end, and what is wrong with it. A damaged or cut member gives what was inflated before the damage; its end is unknown then (-1)."""
    d, out, p = zlib.decompressobj(31), [], at
    while not d.eof:
        piece = data[p : p + 65_536]
        if not len(piece):
            return b"".join(out), -1, "the member is cut"
        spare = d.copy()
        try:
            out.append(d.decompress(piece))
        except zlib.error as e:
            # an error takes the output of its call with it: once more in single bytes
            try:
                for i in range(len(piece)):
                    out.append(spare.decompress(piece[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), -1, str(e)[:200]
        p += len(piece)
    return b"".join(out), p - len(d.unused_data), None


def _one(data: bytes, at: int, end: int) -> tuple[dict[str, str], int, int, int]:
    """Header fields, block start, block end and record end of the plain record at this place; raises ValueError."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at, end)
    if stop < 0:
        raise ValueError("no end of the header")
    fields = _fields(data[at:stop])
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError("no length or type")
    start = stop + 4
    after = start + int(fields["content-length"])
    if after + 4 > end or data[after : after + 4] != b"\r\n\r\n":
        raise ValueError("the block doesn't end where its length says")
    return fields, start, after, after + 4


def _checked(data: bytes, at: int, end: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, payload and end of the record at this place, with its digest checked; raises ValueError."""
    fields, start, stop, after = _one(data, at, end)
    payload = data[start:stop]
    if fields["warc-type"] in ("response", "revisit"):
        head, blank, payload = payload.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("no end of the HTTP header")
        length = next((x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
        fields["payload-bytes"] = length.decode() if length.isdigit() else str(len(payload))
    want = fields.get("warc-payload-digest", "").rpartition(":")[2]
    if fields["warc-type"] != "revisit" and want and want != digest(payload):
        raise ValueError("the payload has another digest")
    return fields, payload, after


def _plain(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(start, end, problem, fields, payload) of the records and gaps of inflated bytes: after a failed check the search goes on at the next version line."""
    at, n, gap_start, problem = 0, len(data), -1, ""
    while at < n:
        try:
            fields, payload, end = _checked(data, at, n)
        except ValueError as e:
            if gap_start < 0:
                gap_start, problem = at, str(e)[:200]
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else n
            continue
        if gap_start >= 0:
            yield gap_start, at, problem, {}, b""
            gap_start = -1
        yield at, end, None, fields, payload
        at = end
    if gap_start >= 0:
        yield gap_start, n, problem, {}, b""


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(start, end, problem, fields, payload) of every record, and of every gap: then problem says what was wrong.

    Places are bytes of the file. Records inside a gzip member have the member's places; a member with a gap among its records, or a damaged one with
    records before the damage, gives these records and a gap with the places in question: of the member, or from the member's start to where
    the next sound member or version line is found (start and end of such a record are the member's start).
    """
    view, at, n = memoryview(data), 0, len(data)
    gap_start, problem = None, ""

    def failed(why: str, start: int) -> None:
        nonlocal gap_start, problem
        if gap_start is None:
            gap_start, problem = start, why

    while at < n:
        found: list[tuple[int, int, str | None, dict[str, str], bytes]] = []
        end = -1
        if data.startswith(MAGIC, at):
            inner, end, why = _inflate(view, at)
            parts = list(_plain(inner))
            if why is None:
                good = [x for x in parts if x[2] is None]
                if good or not inner:
                    found = [(at, end, p if p is None else f"bytes {s} to {e} of the member: {p}", f, x) for s, e, p, f, x in parts]
                else:
                    end = -1
                    failed(parts[0][2] or "", at)
            else:
                # records that others follow lie before the damage, and pass their own checks; the last one goes with the damage
                before = [(at, at, None, f, x) for _, e, p, f, x in parts if p is None and e < len(inner)]
                if before and gap_start is not None:
                    yield gap_start, at, problem, {}, b""
                    gap_start = None
                yield from before
                failed(why, at)
        elif data.startswith(b"WARC/", at):
            try:
                fields, payload, end = _checked(data, at, n)
                found = [(at, end, None, fields, payload)]
            except ValueError as e:
                failed(str(e)[:200], at)
        elif gap_start is None and not data[at:].strip(b"\x00\r\n"):
            return
        else:
            failed("neither a member nor a version line", at)
        if end < 0:
            m = _START.search(data, at + 1)
            at = m.start() if m else n
            continue
        if gap_start is not None:
            yield gap_start, at, problem, {}, b""
            gap_start = None
        yield from found
        at = end
    if gap_start is not None:
        yield gap_start, n, problem, {}, b""


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{_URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_rows(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                rows, held = [], 0
                for start, end, problem, f, payload in salvage(content.as_py() or b""):
                    if f.get("warc-type") == "warcinfo":
                        continue
                    rows.append((
                        path.as_py(), start, end, problem, f.get("warc-type"), _page(f.get("warc-record-id")), f.get("warc-target-uri"),
                        int(f["payload-bytes"]) if "payload-bytes" in f else None, f.get("warc-payload-digest", "").rpartition(":")[2] or None, _page(f.get("warc-refers-to")), payload if payloads and not problem else None,
                    ))
                    held += len(payload) if payloads else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record under path, and every quarantined gap (problem is not null then, start and end are its bytes), by the columns of RECORD.

    Other record types come with what they have. Empty files give no rows. payloads: whether payloads are returned; they are checked anyway.
    """
    prepare(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(read_rows(payloads), RECORD)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes: archive, start, end, problem."""
    return records.filter(F.col("problem").isNotNull()).select("archive", "start", "end", "problem")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives.

    A gap in archives just written means a lost page: it raises, as does another number of records than of pages. Repeated rows and null ids give a record each, an empty
    table gives no rows, html of any length is written and read whole. The digests are checkpointed, so that the archives can go.
    """
    spark = prepare(pages.sparkSession)
    path = write_archives(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    found = read_archives(spark, path, payloads=False)
    whole = F.when(F.col("problem").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat_ws(": ", "archive", "problem")).cast("long"))
    out = found.select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to").checkpoint()
    (n, want) = out.count(), pages.count()
    if n != want:
        raise RuntimeError(f"{want} pages written, {n} records read")
    remove(spark, path)
    return out


#: Base 32 from the hexadecimal digest: five digits make four letters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31 AS INT) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""
