import base64
import hashlib

import pytest

from pixelloom.llm import common as C
from pixelloom.llm import warc

GAP = "\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (5, "http://a/1", "<p>same</p>"),
    (2, "http://a/2 x\r\ny", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (None, "http://a/3", "<p>same</p>"),
    (7, "http://a/4", None),
    (8, "http://a/5", ""),
    (10, "http://é/6", "é" * 3000 + GAP + "tail" + GAP * 3),
    (11, "u", GAP),
    (12, "u", "x" * 100_000),
    (13, "u", "x" * 100_000),
    (15, "u", "WARC/1.1\r\n" * 2 + "WARC/1.1" + "\r\n" * 3 + "WWARC/1.1\r\n"),
    (14, "u", "\r\n" * 500 + "0\r\n\r\n"),
    (14, "u", "\r\n" * 500 + "0\r\n\r\n"),
]


@pytest.mark.parametrize("segment, chunk, least", [(16384, 4096, 0), (50, 7, 0), (64, 1000, 20)])
def test_round_trip(spark, segment, chunk, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS row", "2 AS key").repartition(3)
    path = C.scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, segment_bytes=segment, chunk_bytes=chunk, min_revisit_bytes=least, records_per_file=5)
    rows = warc.read_archives(spark, path, keep_payload=True).collect()
    assert len(rows) == len(PAGES) and all(r.complete for r in rows)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "").encode() == raw]
        first = min(same, key=lambda j: (j is None, j))
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if len(raw) < least or i == first else "revisit", None if len(raw) < least or i == first else first))
    want[-1] = (*want[-1][:3], "revisit", 14)  # the second of two equal rows revisits the first
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    payloads = {r.payload_digest: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert all(base64.b32encode(hashlib.sha1(p).digest()).decode() == d for d, p in payloads.items())


def test_separators_at_buffer_ends(spark):
    n = 6000
    pages = spark.range(n).selectExpr("id AS page_id", "'u' AS url", "repeat('a', cast(id % 37 as int)) || repeat('\\r\\n', cast(id % 5 as int)) || id AS html").repartition(2)
    path = C.scratch_path(spark, "warc-many")
    warc.write_archives(pages, path)
    rows = warc.read_archives(spark, path)
    assert rows.count() == n and rows.where("not complete").count() == 0


def test_broken_archives(spark, tmp_path):
    block = warc._HTTP + warc.to_chunks(b"hello world" * 20, 16)
    parts = warc.to_segments(block, 60)
    records = []
    for name, numbers, total in (("whole", range(len(parts)), len(block)), ("hole", [0, *range(2, len(parts))], len(block)), ("short", range(len(parts)), len(block) + 1)):
        for k in reversed(numbers):
            own = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("Page-Id", 1), ("WARC-Segment-Number", 1)]
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name}{k}"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k + 1), ("WARC-Segment-Total-Length", total if k == len(parts) - 1 else None)]
            records.append(warc._record(own if k == 0 else more, parts[k]) + b"\n")
    # Another writer's record, whose payload isn't framed and holds the separator; and one that is cut short.
    plain = b"HTTP/1.1 200 OK\r\n\r\nab" + GAP.encode() + b"cd"
    records.append(warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "plain"), ("Page-Id", 2)], plain) + b"\n")
    records.append(warc._record([("WARC-Type", "revisit"), ("WARC-Record-ID", "lost"), ("Page-Id", 3), ("WARC-Refers-To", "nowhere")], b"") + b"\n")
    records.append(warc._record([("WARC-Type", "response"), ("WARC-Record-ID", "cut"), ("Page-Id", 4)], block)[:-40])
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    rows = warc.read_archives(spark, f"file://{tmp_path}", keep_payload=True).collect()
    got = sorted((r.page_id, r.record_type, r.complete) for r in rows)
    assert got == [(1, "response", False), (1, "response", False), (1, "response", True), (2, "response", True), (3, "revisit", False), (4, "response", False)]
    assert next(bytes(r.payload) for r in rows if r.page_id == 2) == b"ab" + GAP.encode() + b"cd"


def test_empty_table(spark):
    path = C.scratch_path(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
