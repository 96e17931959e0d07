"""WARC archives: a writer in DataFrame functions and a salvage reader.

The writer makes one record per page, with revisit records for payloads that an earlier page has, and a gzip member per
record. Spark's text sink writes the members to any file system: its line separator is the zero byte that a member ends in
(the high byte of a length below 16 MiB; a longer record is followed by an empty member). Rows of the sink hold members of
about a MB, and files a bounded number of rows.

The reader takes files as bytes. It checks each gzip member, version line, header, length, record end and digest. After a
failed check it searches for the next valid member or version line, goes on from there, and logs the bytes in between as a
quarantined gap. What a broken member still gives before its fault is read too, and its gap begins after that.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, shared_dir

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
SCHEMA = "archive string, kind string, start long, stop long, member long, reason string, headers map<string,string>, payload binary"


# --- writer --------------------------------------------------------------------------------------------------------


def base32_sha1(c: Column) -> Column:
    """Upper-case base32 of a binary column's SHA-1: 5 hex digits are 4 base32 digits."""

    def spelled(digest: Column) -> Column:
        out = []
        for g in range(8):
            five = F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 10).cast("int")
            out += [F.substr(F.lit(ALPHABET), F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*out)

    return F.transform(F.array(F.sha1(c)), spelled)[0]  # bound once: 32 digits, one digest


def typed(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of min_bytes or more, those with the least page_id are responses and the others revisit
    it; shorter payloads, and payloads of which no row has a page_id, are all responses. A null html is the empty payload.
    Only ids and digests meet by payload, those of very frequent payloads without a shuffle to one task; html moves once, by
    page_id.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    small = pages.select(F.col("page_id").cast("long").alias("_id"), base32_sha1(body).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"))
    small = small.distinct()
    first = small.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("n"))
    known = hot_join(small, first, "_digest")
    revisit = (F.col("_bytes") >= min_bytes) & (F.coalesce(F.col("_id"), F.col("_first") + 1) != F.col("_first"))
    known = known.select("_id", "_digest", "_bytes", F.coalesce(revisit, F.lit(False)).alias("_revisit"), "_first")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    full = full.withColumn("payload_digest", base32_sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    met = full.join(known, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")))
    return met.select(
        "page_id", "url", "html", "payload_digest",
        F.col("_bytes").alias("payload_bytes"),
        F.when(F.col("_revisit"), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(F.col("_revisit"), F.col("_first")).alias("refers_to"),
    )


def records(pages: DataFrame, min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """(value) one WARC record per row, without its closing blank lines."""
    t = typed(pages, min_bytes)
    html = F.coalesce(F.col("html"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(html))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:none>"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return t.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, per_row: int = 1 << 20, per_file: int = 64) -> None:
    """Archives of at most per_file rows of members, into a folder that Spark can write. A row is filled up to per_row bytes,
    so that files stay near the product unless single records are larger."""

    def packed(rows: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[bytes] = []
        size = 0
        for b in rows:
            for value in b.column(0):
                held.append(member(value.as_py()))
                size += len(held[-1])
                if size >= per_row:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    rows = records(pages, min_bytes).select(F.concat(F.col("value").cast("binary"), F.lit(_END))).mapInArrow(packed, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, with an empty one behind it where its length needs that."""
    out = gzip.compress(record, 3, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", 6, mtime=0)


# --- salvage reader ------------------------------------------------------------------------------------------------


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, in order. start and stop are byte offsets, within a member's content if `member`
    has that member's own offset; a gap has a reason instead of headers and payload."""
    at = 0
    while at < len(data):
        read = 0
        if data.startswith(_MEMBER, at):
            content, used, fault = _inflate(data, at)
            if not fault:
                yield from _plain(content, at)
                at += used
                continue
            whole = [x for x in _plain(content, at) if x["kind"] == "record"]
            yield from whole
            read = _reached(data, at, whole[-1]["stop"]) if whole else 0
        elif _VERSION.match(data, at):
            record = _record(data, at)
            if "reason" not in record:
                yield record
                at = record["stop"]
                continue
            fault = record["reason"]
        else:
            fault = "no member or version line"
        after = _resume(data, at + max(1, read))
        yield _gap(at + read, after, -1, fault)
        at = after


def _plain(data: bytes, member: int) -> Iterator[dict]:
    at = 0
    while at < len(data):
        x = _record(data, at) if _VERSION.match(data, at) else {"reason": "no version line"}
        if "reason" not in x:
            yield x | {"member": member}
            at = x["stop"]
            continue
        after = at + 1
        while (m := _VERSION.search(data, after)) and "reason" in _record(data, m.start()):
            after = m.end()
        stop = m.start() if m else len(data)
        yield _gap(at, stop, member, x["reason"])
        at = stop


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What a member holds, the bytes it takes, and what is wrong with it."""
    d = zlib.decompressobj(31)
    out, view = [], memoryview(data)
    step = 1 << 16
    try:
        for i in range(at, len(data), step):
            out.append(d.decompress(view[i : i + step]))
            if d.eof:
                return b"".join(out), min(i + step, len(data)) - len(d.unused_data) - at, ""
        return b"".join(out), len(data) - at, "member ends early"
    except zlib.error as e:
        out += _drip(data, at, sum(map(len, out)))
        return b"".join(out), 0, f"member: {e}"


def _reached(data: bytes, at: int, content: int) -> int:
    """Bytes of a member that its first `content` bytes of content take, to the next multiple of 64."""
    d, got, i = zlib.decompressobj(31), 0, at
    try:
        while got < content and i < len(data):
            got += len(d.decompress(data[i : i + 64]))
            i += 64
    except zlib.error:
        pass
    return min(i, len(data)) - at


def _drip(data: bytes, at: int, have: int) -> list[bytes]:
    """The rest of a broken member's content, byte by byte as far as it goes."""
    d, out, got = zlib.decompressobj(31), [], 0
    try:
        for i in range(at, len(data), 64):
            part = d.decompress(data[i : i + 64])
            got += len(part)
            out.append(part)
    except zlib.error:
        pass
    return [b"".join(out)[have:]]


def _resume(data: bytes, at: int) -> int:
    """The next place from `at` where a whole member or a whole record begins, or the end."""
    while True:
        m = _VERSION.search(data, at)
        z = data.find(_MEMBER, at)
        if z >= 0 and (m is None or z < m.start()):
            if not _inflate(data, z)[2]:
                return z
            at = z + 1
        elif m is None:
            return len(data)
        elif "reason" not in _record(data, m.start()):
            return m.start()
        else:
            at = m.start() + 1


def _record(data: bytes, at: int) -> dict:
    """The record at a version line, or {"reason": ...}."""
    end = _VERSION.match(data, at).end()
    headers = {}
    while not data.startswith(b"\r\n", end):
        stop = data.find(b"\r\n", end)
        if stop < 0:
            return {"reason": "header has no end"}
        name, colon, value = data[end:stop].partition(b":")
        if not colon or not name.strip():
            return {"reason": "header line has no name"}
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        end = stop + 2
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        return {"reason": "no length"}
    start = end + 2
    stop = start + int(length)
    if stop > len(data):
        return {"reason": "record ends early"}
    if data[stop : stop + 4] != _END:
        return {"reason": "length doesn't meet the record's end"}
    payload = data[start:stop]
    if headers.get("content-type", "").startswith("application/http"):
        payload = payload.partition(_END)[2]
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if algorithm == "sha1" and headers.get("warc-type") != "revisit" and sha1_base32(payload) != digest:
        return {"reason": "digest differs"}
    return {"kind": "record", "start": at, "stop": stop + 4, "member": -1, "headers": headers, "payload": payload}


def _gap(start: int, stop: int, member: int, reason: str) -> dict:
    return {"kind": "gap", "start": start, "stop": stop, "member": member, "reason": reason}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def read(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "part-*") -> DataFrame:
    """Records and gaps of all archives in a folder, one row each (SCHEMA). An archive is read by one task; the writer
    bounds its size. Without payloads their column is null."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["archive", "kind", "start", "stop", "member", "reason", "headers", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in rows:
            for i in range(b.num_rows):
                archive, out = b.column(0)[i].as_py(), []
                for x in salvage(b.column(1)[i].as_py()):
                    x["archive"] = archive
                    if not with_payload:
                        x.pop("payload", None)
                    x["headers"] = list(x.get("headers", {}).items()) or None
                    out.append(x)
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], k) for n, k in zip(names, kinds, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], k) for n, k in zip(names, kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of pages into the shared folder and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url per record. A response's size and digest are those of the payload read."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)

    def digest(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for b in rows:
            heads, bodies = [dict(h) for h in b.column(0).to_pylist()], b.column(1).to_pylist()
            out = []
            for h, body in zip(heads, bodies, strict=True):
                whole = h["warc-type"] == "response"
                number = re.fullmatch(r"<urn:page:(-?\d+)>", h["warc-record-id"])
                target = re.fullmatch(r"<urn:page:(-?\d+)>", h.get("warc-refers-to", ""))
                out.append((int(number[1]) if number else None, len(body) if whole else int(h["warc-payload-length"]), sha1_base32(body) if whole else h["warc-payload-digest"][5:], h["warc-type"], int(target[1]) if target else None, h.get("warc-target-uri")))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    back = read(spark, path).where("kind = 'record'").select("headers", "payload")
    return back.mapInArrow(digest, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
