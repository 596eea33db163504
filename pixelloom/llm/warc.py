"""WARC archives of pages: writing, and reading back with segment reassembly.

A page is one record: of pages with equal payloads, that of the smallest id is
a response with the payload in chunked transfer framing, and the others are
revisit records that refer to it. A block longer than segment_bytes is written
as a first segment and continuation records. The reader groups continuations
by the identifier of the first segment, orders them by number, checks the
number of segments and the total length, and takes the framing off.

Scale: archives are written and read by Spark's own text source, with the start
of a record as line separator; so any file system works, files need
not fit in memory, and a writer cuts chunks and segments such that no payload
holds that separator. Only segments are shuffled, one payload to a group; the
joins on digests and record identifiers carry one row per page, and AQE splits
those of a payload that very many pages share.

Cases: a null payload is an empty one; a null id is larger than any other and
comes back null; of rows that repeat id and payload one is the response and the
rest revisit it under the smallest of their urls; payloads under min_revisit_bytes are all responses; a record
whose length, segments or digest don't fit comes back with complete = false;
other columns are ignored; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEGMENT_BYTES, CHUNK_BYTES, MIN_REVISIT_BYTES = 16384, 4096, 0
#: Starts every record, and is the line separator of the text source. Its first letter doesn't recur in it, so that a
#: reader that has met a part of it at a buffer's end never has to look back.
_VERSION = b"WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, copy: int | str, digest: str) -> str:
    h = hashlib.sha1(f"{page_id}|{copy}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def to_chunks(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing; a chunk ends inside whatever could start a record, even with the framing's line end."""
    ends = {*range(chunk_bytes, len(payload), chunk_bytes), len(payload)}
    name = _VERSION.rstrip()
    at = payload.find(name)
    while at >= 0:
        ends.add(at + 4)
        at = payload.find(name, at + 1)
    out, start = [], 0
    for end in sorted(ends - {0}):
        out.append(b"%x\r\n%b\r\n" % (end - start, payload[start:end]))
        start = end
    return b"".join(out) + b"0\r\n\r\n"


def from_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def to_segments(block: bytes, segment_bytes: int) -> list[bytes]:
    """The block in pieces of segment_bytes."""
    return [block[at : at + segment_bytes] for at in range(0, max(1, len(block)), segment_bytes)]


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """All of a record but its last byte, which the writer's line end adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return _VERSION + head.encode() + b"\r\n" + block + b"\r\n\r"


def _fields(page_id: int | None, url: str | None, digest: str, key: str) -> list[tuple[str, object]]:
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url) if url else f"urn:page:{page_id}"
    return [("WARC-Record-ID", key), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("Page-Id", page_id), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]


def response_records(page_id: int | None, url: str | None, payload: bytes, copy: int | str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    """The records of a page with its payload: one, or a first segment and its continuations."""
    digest = digest32(payload)
    own = record_id(page_id, copy, digest)
    fields = [("WARC-Type", "response"), *_fields(page_id, url, digest, own)]
    block = _HTTP + to_chunks(payload, chunk_bytes)
    parts = to_segments(block, segment_bytes)
    if len(parts) == 1:
        return [_record(fields, block)]
    out = [_record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, f"{copy}|{k}", digest)), ("WARC-Date", _DATE), fields[3], ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k)]
        out.append(_record(more + [("WARC-Segment-Total-Length", len(block))] * (k == len(parts)), part))
    return out


def revisit_record(page_id: int | None, url: str | None, digest: str, copy: int, first_id: int | None) -> bytes:
    """The record of a page whose payload the response of page first_id has."""
    fields = _fields(page_id, url, digest, record_id(page_id, copy, digest))
    return _record([("WARC-Type", "revisit"), *fields, ("WARC-Refers-To", record_id(first_id, 0, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], _HTTP)


def _by_slices(make, name: str = "record"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = [x for r in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)) for x in make(*r)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=[name])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = 50_000) -> None:
    """Writes gzip-compressed archives of all pages to the folder path.

    Revisits need no payload, so they are made from one small row for each
    digest and id. The page with the payload is found by its id, not by a row
    number, so a recomputed task makes the same records.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("key", F.sha1("payload"))
    pages_of = rows.where(F.length("payload") >= min_revisit_bytes).groupBy("key", "id").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("copies"))
    pages_of, p1 = C.cut(pages_of, "page-digests")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "copies")).alias("first")
    shared = pages_of.groupBy("key").agg(first, F.sum("copies").alias("n")).where("n > 1")
    shared, p2 = C.cut(shared.select("key", F.lit(True).alias("shared"), F.col("first.id").alias("first_id"), F.col("first.copies").alias("ties")), "shared-digests")

    whole = rows.join(shared, "key", "left").where(F.col("shared").isNull() | F.col("id").eqNullSafe(F.col("first_id")))
    once = whole.where("shared is null or ties = 1").select("id", "url", "payload", F.when(F.col("shared"), F.lit("0")).otherwise(F.concat(F.lit("r"), F.monotonically_increasing_id())).alias("copy"))
    tied = whole.where("ties > 1").groupBy("key").agg(F.first("id").alias("id"), F.min("url").alias("url"), F.first("payload").alias("payload")).select("id", "url", "payload", F.lit("0").alias("copy"))
    responses = once.union(tied).mapInArrow(_by_slices(lambda i, u, p, c: response_records(i, u, p, c, segment_bytes, chunk_bytes)), "record binary")

    again = pages_of.join(shared, "key").withColumn("from", F.when(F.col("id").eqNullSafe(F.col("first_id")), 1).otherwise(0))
    again = again.where("copies > from").select("id", "url", "key", F.explode(F.sequence(F.col("from"), F.col("copies").cast("int") - 1)).alias("copy"), "first_id")
    revisits = again.mapInArrow(_by_slices(lambda i, u, k, c, f: [revisit_record(i, u, base64.b32encode(bytes.fromhex(k)).decode(), c, f)]), "record binary")

    records = responses.union(revisits).select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    C.drop(pages.sparkSession, p1, p2)


_ROWS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("bytes", pa.int64()), ("payload", pa.binary()), ("complete", pa.bool_())])
_ROWS_SQL = "record_id string, type string, page_id long, digest string, refers string, origin string, segment int, total long, block binary, bytes long, payload binary, complete boolean"


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return from_chunks(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(block: bytes, digest: str | None) -> tuple[int | None, bytes | None, bool]:
    try:
        payload = payload_of(block)
    except ValueError:
        return None, None, False
    return len(payload), payload, digest is None or digest == digest32(payload)


def _parse(raw: bytes, keep_payload: bool) -> tuple | None:
    """The columns of one record; None if its block isn't all there yet."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
    size = int(fields.get("content-length") or 0)
    if len(rest) < size:
        return None
    block, number = rest[:size], fields.get("warc-segment-number")
    digest, page = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("page-id")
    key, kind = fields.get("warc-record-id"), fields.get("warc-type")
    out = [key, kind, int(page) if page else None, digest, fields.get("warc-refers-to")]
    if number:
        total = fields.get("warc-segment-total-length")
        return (*out, fields.get("warc-segment-origin-id") or key, int(number), int(total) if total else None, block, None, None, None)
    if kind != "response":
        return (*out, None, None, None, None, None, None, True)
    n, payload, fine = _checked(block, digest)
    return (*out, None, None, None, None, n, payload if keep_payload else None, fine)


def _parser(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, source = None, None
        for batch in batches:
            out = []
            for value, file in zip(*batch.columns):
                raw, file = value.as_py(), file.as_py()
                if pending is not None and file == source:  # a payload of another writer that holds the separator
                    raw = pending + _VERSION + raw
                elif pending is not None:
                    out.append(_cut_short(pending))
                pending, source = None, file
                if not raw.strip():  # what stands before the first record
                    continue
                row = _parse(raw, keep_payload)
                if row is None:
                    pending = raw
                else:
                    out.append(row)
                if len(out) >= 512:
                    yield _to_batch(out)
                    out = []
            yield _to_batch(out)
        if pending is not None:
            yield _to_batch([_cut_short(pending)])

    return run


def _cut_short(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = [x for x in head.split(b"\r\n") if not x.lower().startswith(b"content-length")]
    row = _parse(b"\r\n".join([*fields, b"Content-Length: %d" % len(rest)]) + b"\r\n\r\n" + rest, False)
    return (*row[:-1], False)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_ROWS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROWS)], schema=_ROWS)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, complete (and payload, of responses)."""
    lines = spark.read.option("lineSep", _VERSION.decode()).text(path)
    raw = lines.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"))
    rows, _ = C.cut(raw.mapInArrow(_parser(keep_payload), _ROWS_SQL), "records")
    parts = rows.where("segment is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
        F.max(F.when(F.col("segment") == 1, F.struct("page_id", "type", "digest"))).alias("head"),
    )

    def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for origin, segments, head in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    head = head or {"page_id": None, "type": "response", "digest": None}
                    block = b"".join(s["block"] for s in segments)
                    whole = [s["segment"] for s in segments] == list(range(1, len(segments) + 1)) and segments[-1]["total"] == len(block)
                    n, payload, fine = _checked(block, head["digest"])
                    out.append((origin, head["type"], head["page_id"], head["digest"], None, None, None, None, None, n, payload if keep_payload else None, whole and fine))
                yield _to_batch(out)

    joined = parts.select("origin", "parts", "head").mapInArrow(join_segments, _ROWS_SQL)
    single = rows.where("segment is null")
    columns = ["record_id", "type", "page_id", "digest", "refers", "bytes", "payload", "complete"]
    responses = single.where("type = 'response'").select(columns).union(joined.select(columns))
    targets = responses.select(F.col("record_id").alias("refers"), F.col("page_id").alias("target"), F.col("bytes").alias("target_bytes"), F.col("digest").alias("target_digest"), F.lit(True).alias("found"))
    revisits = single.where("type = 'revisit'").select(columns).join(targets, "refers", "left")
    same = F.coalesce(F.col("found") & F.col("digest").eqNullSafe(F.col("target_digest")), F.lit(False))
    more = ["payload"] if keep_payload else []
    a = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "complete", *more)
    b = revisits.select("page_id", F.col("target_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("target").alias("refers_to"), same.alias("complete"), *more)
    return a.union(b)
