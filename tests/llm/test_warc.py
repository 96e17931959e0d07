"""Archives that the writer made, damaged; long headers and records; joins of hot keys."""

import gzip
import random
from pathlib import Path

from prooflake.llm import warc
from prooflake.llm.common import hot_join

PAGES = "page_id long, url string, html string"


def archives(spark, tmp_path, rows):
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    return sorted(Path(path).glob("part-*"))


def test_damaged_archive(spark, tmp_path):
    """Zeros in the middle of an archive lose the members that they touch, and the log names their bytes."""
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", f"page {i} " + " ".join(f"w{rng.randrange(9999)}" for _ in range(60))) for i in range(400)]
    files = archives(spark, tmp_path, rows)
    whole = [bytearray(f.read_bytes()) for f in files]
    assert sum(sum(1 for x in warc.salvage(bytes(d)) if x["kind"] == "record") for d in whole) == 400
    assert sum(gzip.decompress(bytes(d)).count(b"WARC/1.1\r\n") for d in whole) == 400  # plain gzip reads it too
    data = max(whole, key=len)
    had = {x["headers"]["warc-record-id"] for x in warc.salvage(bytes(data))}
    at = len(data) // 3
    data[at : at + 300] = bytes(300)
    out = list(warc.salvage(bytes(data)))
    assert len(had) - 3 <= sum(x["kind"] == "record" for x in out) < len(had)
    gaps = [x for x in out if x["kind"] == "gap" and x["member"] < 0]
    assert gaps[0]["start"] <= at and gaps[-1]["stop"] >= at + 300 and sum(g["stop"] - g["start"] for g in gaps) < 3000


def test_gap_begins_after_what_was_read():
    records = [b"WARC/1.1\r\nWARC-Record-ID: <%d>\r\nContent-Length: 400\r\n\r\n%s\r\n\r\n" % (i, random.Random(i).randbytes(200).hex().encode()) for i in range(30)]
    data = bytearray(gzip.compress(b"".join(records)))
    at = len(data) // 2
    data[at : at + 40] = bytes(40)
    out = list(warc.salvage(bytes(data)))
    read, gap = [x for x in out if x["kind"] == "record"], out[-1]
    assert 10 < len(read) < 20 and gap["kind"] == "gap" and len(data) // 3 < gap["start"] <= len(data) // 2 + 200 and gap["stop"] == len(data)


def test_long_headers_and_records(spark):
    rows = [(1, "http://h/" + "x" * (3 << 20), "<p>"), (2, "http://b/", "long " * (4 << 20)), (3, None, None)]
    got = sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.round_trip(spark.createDataFrame([(*r, "k") for r in rows], PAGES + ", kind string")).collect())
    assert got == [(1, 3, "response"), (2, 20 << 20, "response"), (3, 0, "response")]


def test_hot_join(spark):
    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1), ("c", 2), (None, 3)], "k string, x long")
    table = spark.createDataFrame([("a", 500, 10), ("b", 1, None), ("d", 1, 12)], "k string, n long, y long")
    for share in (1, 2, 1000):
        got = sorted(((r.k, r.x, r.y) for r in hot_join(rows, table, "k", hot_share=share).collect()), key=str)
        assert got == sorted([("a", i, 10) for i in range(500)] + [("b", 1, None)], key=str)
