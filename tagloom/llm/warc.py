"""WARC archives through a chunked record table.

A record is one or more rows of (record id, chunk number): its payload is cut
into chunks of bounded size, each row carries the SHA-1 of all payload bytes up
to its end, and each row is written as one WARC block, the first as the record
itself and the others as ``continuation`` records with segment numbers.  No task
ever holds a second copy of a whole payload, and an oversized record is read back
chunk by chunk with one running digest.

Archives are written and read by Spark's text source, so any file system that
Spark reaches will do and a lost task is simply run again.  Blocks are found by
the text between them; a chunk is cut where it would contain that text.

Of records with equal payloads the one with the smallest key is a response, the
others revisit it and carry no payload.

Defined cases: a null payload is empty; a null url leaves the target field out; a
row with a null key counts as larger than any key, and if all rows of a payload
lack one, all are responses; rows with equal key and payload are records of their
own with the same type; payloads below the smallest deduplicated size are all
responses; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of a payload in one chunk at most, and bytes of the rows sent to Spark at once.
CHUNK, BATCH_BYTES = 1 << 16, 4 << 20

# The start of each WARC record, with the last byte of the record before it.
START = "WARC/1.0\r\nWARC-Type: "
BETWEEN = "\n" + START
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
EMPTY_ARCHIVE = "page_id string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"

_RECORD = "record_id string, row long, segment int, last boolean, record_type string, page_id string, refers_to string, payload_bytes long, payload_digest string, running string, body binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks(payload: str, size: int = CHUNK) -> Iterator[str]:
    """The payload in pieces, at least one; no piece begins a line with a WARC version."""
    for at in range(0, max(len(payload), 1), size):
        piece, start = payload[at : at + size], 0
        for found in re.finditer(r"(?:^|\n)WAR(?=C/1\.)", piece):
            yield piece[start : found.end()]
            start = found.end()
        yield piece[start:]


def decisions(pages: DataFrame, *, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Key, url-independent facts and payload of each page, with the key of the response it revisits.

    The payloads' digests are grouped with a partial minimum, so copies are
    reduced before the shuffle; Spark splits a hot digest in the join.
    """
    facts = pages.withColumn("_payload", F.coalesce(payload, F.lit(""))).withColumn("_sha1", F.unhex(F.sha1("_payload")))
    shared = facts.where(F.octet_length("_payload") >= least_bytes)
    first = shared.groupBy("_sha1").agg(F.min(key).alias("_first"))
    joined = facts.join(first, "_sha1", "left")
    revisits = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return joined.withColumn("_refers", F.when(revisits, F.col("_first")))


def _header(fields: list[tuple[str, object]], body: bytes) -> str:
    lines = [f"{name}: {value}\r\n" for name, value in fields if value is not None]
    return "".join([*lines, f"Content-Length: {len(body)}\r\n\r\n"])


def _blocks(key, url, payload: str, total: int, sha1: bytes, refers, refers_id, record_id: str, row: int, *, date: str, size: int) -> Iterator[str]:
    """The WARC blocks of one record, without the last line feed."""
    digest = f"sha1:{base32(sha1)}"
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("X-Page-Id", key), ("X-Payload-Length", total)]
    if refers is not None:
        fields = [("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers_id}>"), ("X-Refers-To-Page", refers)]
        body = HTTP.encode()
        yield f"{START}revisit\r\n{_header([*fields, ('Content-Type', 'application/http; msgtype=response')], body)}{HTTP}\r\n\r"
        return
    running, pieces = hashlib.sha1(), chunks(payload, size)
    piece, number, end = next(pieces), 1, None
    while piece is not None:
        following = next(pieces, None)
        raw = piece.encode()
        running.update(raw)
        end = following is None
        segment = [] if number == 1 and end else [("WARC-Segment-Number", number), ("X-Row", row), ("X-Running-Digest", f"sha1:{base32(running.digest())}")]
        if number == 1:
            kind, front = "response", HTTP
            fields = [("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *common, ("Content-Type", "application/http; msgtype=response")]
        else:
            kind, front = "continuation", ""
            own = hashlib.md5(f"{record_id}/{number}".encode()).hexdigest()
            fields = [("WARC-Record-ID", f"<urn:uuid:{_uuid(own)}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>")]
            segment += [("WARC-Segment-Total-Length", len(HTTP) + total)] if end else []
        yield f"{START}{kind}\r\n{_header([*fields, *segment], front.encode() + raw)}{front}{piece}\r\n\r"
        piece, number = following, number + 1


def _uuid(hex32: str) -> str:
    return "-".join((hex32[:8], hex32[8:12], hex32[12:16], hex32[16:20], hex32[20:32]))


def _batched(rows: Iterator[tuple], names: list[str], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; ``weight`` is the column that holds the bulk."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += 200 + len(row[weight] or "")
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], names=names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], names=names)


def _record_id(key: Column, sha1: Column) -> Column:
    """A name-based identifier of a record."""
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.hex(sha1)))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def record_blocks(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, chunk: int = CHUNK
) -> DataFrame:
    """One row ``value`` per WARC block of the pages' records.

    Identifiers name key and payload; the chunks of rows that repeat both are told
    apart by a row number.
    """
    pages = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.col(payload).alias("_html"))
    rows = decisions(pages, key="_key", payload="_html", least_bytes=least_bytes).select(
        F.col("_key").cast("string"),
        "_url",
        F.when(F.col("_refers").isNull(), F.col("_payload")).alias("_payload"),
        F.octet_length("_payload").cast("long").alias("_bytes"),
        "_sha1",
        F.col("_refers").cast("string"),
        _record_id(F.col("_refers"), F.col("_sha1")).alias("_refers_id"),
        _record_id(F.col("_key"), F.col("_sha1")).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    schema = pa.schema([("value", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            for batch in batches:
                for at in range(batch.num_rows):  # one payload at a time
                    r = [column[at].as_py() for column in batch.columns]
                    for block in _blocks(r[0], r[1], r[2] or "", *r[3:], date=date, size=chunk):
                        yield (block,)

        yield from _batched(blocks(), ["value"], schema, 0)

    return rows.mapInArrow(write, "value string")


def write_archives(blocks: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write blocks as WARC files, one per task."""
    blocks.write.option("lineSep", "\n").option("compression", compression).text(path)


def parse_block(value: str) -> dict:
    """The fields and the body of a block as the text source returns it."""
    raw = value.encode()
    start = START.encode()
    raw = raw[len(start) :] if raw.startswith(start) else raw
    head, _, rest = raw.partition(b"\r\n\r\n")
    kind, *lines = head.decode().split("\r\n")
    fields = {"WARC-Type": kind} | dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if rest[length:] not in (b"\r\n\r", b"\r\n\r\n"):
        raise ValueError(f"a block of {length} bytes does not end as it should: {fields.get('WARC-Record-ID')}")
    return fields | {"body": rest[:length]}


def _record(value: str) -> tuple:
    """A row of _RECORD; the body only where the record has more chunks, else its digest is checked at once."""
    f = parse_block(value)
    kind, body = f["WARC-Type"], f["body"]
    segment = int(f.get("WARC-Segment-Number", 0))
    name = (f["WARC-Segment-Origin-ID"] if kind == "continuation" else f["WARC-Record-ID"])[10:-1]
    digest, running = (f[k][5:] if k in f else None for k in ("WARC-Payload-Digest", "X-Running-Digest"))
    if kind == "response":
        body = body.partition(b"\r\n\r\n")[2]
        if not segment and (base32(hashlib.sha1(body).digest()) != digest or len(body) != int(f["X-Payload-Length"])):
            raise ValueError(f"payload of record {name} does not match its digest")
    size = int(f["X-Payload-Length"]) if "X-Payload-Length" in f else None
    last = not segment or "WARC-Segment-Total-Length" in f
    return name, int(f.get("X-Row", 0)), segment, last, kind, f.get("X-Page-Id"), f.get("X-Refers-To-Page"), size, digest, running, body if segment else None


def _arrow_type(ddl: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[ddl]


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _arrow_type(t)) for n, t in (f.split() for f in ddl.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: what EMPTY_ARCHIVE lists, keys as text.

    Records of one block never move.  The chunks of the others meet in one task
    per record, ordered by number, and pass through one running digest, a chunk
    in memory at a time.
    """
    lines = spark.read.option("lineSep", BETWEEN).schema("value string").text(path)
    names, schema = [f.split()[0] for f in _RECORD.split(", ")], _arrow_schema(_RECORD)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_record(v.as_py()) for batch in batches for v in batch.column(0))
        yield from _batched(rows, names, schema, len(names) - 1)

    out_names, out_schema = [f.split()[0] for f in EMPTY_ARCHIVE.split(", ")], _arrow_schema(EMPTY_ARCHIVE)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            first, running, size, expected = None, None, 0, 1
            for batch in batches:
                for at in range(batch.num_rows):
                    r = {n: c[at].as_py() for n, c in zip(names, batch.columns)}
                    if not r["segment"]:
                        yield r["page_id"], r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]
                        continue
                    if r["segment"] == 1:
                        first, running, size, expected = r, hashlib.sha1(), 0, 1
                    if first is None or (r["record_id"], r["row"]) != (first["record_id"], first["row"]) or r["segment"] != expected:
                        raise ValueError(f"chunks of record {r['record_id']} are missing")
                    running.update(r["body"])
                    size, expected = size + len(r["body"]), expected + 1
                    if base32(running.digest()) != r["running"]:
                        raise ValueError(f"chunk {r['segment']} of record {r['record_id']} does not match its digest")
                    if r["last"]:
                        if r["running"] != first["payload_digest"] or size != first["payload_bytes"]:
                            raise ValueError(f"payload of record {r['record_id']} does not match its digest")
                        yield first["page_id"], first["record_id"], "response", None, size, r["running"]
                        first = None

        yield from _batched(records(), out_names, out_schema, 1)

    parsed = lines.mapInArrow(parse, _RECORD)
    together = parsed.repartition("record_id").sortWithinPartitions("record_id", "row", "segment")
    return together.mapInArrow(finish, EMPTY_ARCHIVE)
