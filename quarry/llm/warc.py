"""WARC archives: writing with revisits and segmentation, reading with segment reassembly.

Writing: one record per row. The payload (UTF-8 of the html) travels in an HTTP message with chunked
transfer framing. Rows of equal payload share one response, of the largest page id; the others
become revisit records that name it. A block longer than segment_bytes is cut into a first record
and continuation records, which carry the origin's record id, a segment number and, on the last, the
total length. Archives are gzip members in files below spark.checkpoint.dir, renamed into place
whole.

Reading: every record is keyed by its origin (its own id unless it continues another), dealt by that
key and sorted by segment number; a stream over the sorted records joins segments, checks that
numbers run from 1 without gaps and that the total length fits, removes the chunked framing, and
checks length and digest of the payload. One record's segments are all that a task holds at once.

Null html counts as the empty payload; null urls leave the header out. Rows that repeat the largest
page id of a payload are all responses; rows without a page id revisit if any copy has one. Other
columns are ignored; an empty table gives no rows. Damaged archives raise ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import checkpoint, filesystem, publish, work_dir

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 4 << 10
#: Uncompressed blocks that make up one archive file.
FILE_BYTES = 32 << 20
GZIP_LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: WARC-Date of every record; the rows have no capture time.
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[k : k + size]), p) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing, with chunk extensions and trailers skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) < size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


def record(headers: dict[str, object], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    data = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(stream) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of each record of an open, decompressed archive."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield headers, block


def segments(headers: dict[str, object], block: bytes, limit: int, name) -> list[bytes]:
    """The records of a block: one, or a first and its continuations. name() gives record ids."""
    if len(block) <= limit:
        return [record(headers, block)]
    cuts = range(0, len(block), limit)
    out = [record(headers | {"WARC-Segment-Number": 1}, block[:limit])]
    for n, start in enumerate(cuts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if n == len(cuts) else {}
        more = {"WARC-Type": "continuation", "WARC-Record-ID": name(), "WARC-Date": DATE, "WARC-Segment-Origin-ID": headers["WARC-Record-ID"], "WARC-Segment-Number": n}
        out.append(record(more | last, block[start : start + limit]))
    return out


def write(df: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, least_bytes: int = 0) -> DataFrame:
    """Writes the archives of (page_id, url, html); returns the manifest: path, n_records, n_bytes."""
    spark = df.sparkSession
    rows = df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    # one row for each payload that occurs more than once, counted before the shuffle
    copied = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    copied = checkpoint(copied.filter("n > 1 and winner is not null"))
    # payloads of more than one in FREQUENT_SHARE of all pages are at most that many, so they are broadcast; their pages,
    # and those that revisit nothing, are then dealt by what else they hold
    often = copied.filter(F.col("n") > max(common.FREQUENT_ROWS, df.count() // common.FREQUENT_SHARE)).select("digest", F.col("winner").alias("often"))
    met = rows.join(F.broadcast(often), "digest", "left")
    open_ = (F.col("size") >= least_bytes) & F.col("often").isNull()
    met = met.withColumn("digest", F.when(open_, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    dealt = met.join(copied.select("digest", "winner"), "digest", "left").withColumn("winner", F.when(F.col("size") >= least_bytes, F.coalesce("often", "winner"))).drop("often", "size", "digest")
    run_id = uuid.uuid4().hex

    def store(batches):
        fs, root = filesystem(folder)
        # two attempts of a task can hold its pages in other orders, so each has files and record ids of its own
        task, n, files = f"{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}", 0, 0
        parts, held, count = [], 0, 0

        def name() -> str:
            nonlocal n
            n += 1
            return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{run_id} {task} {n}'.encode()).hexdigest())}>"

        def close():
            nonlocal files, held, count
            path = f"{root}/part-{task}-{files:04d}.warc.gz"
            data = b"".join(parts)
            publish(fs, path, data)
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": [count], "n_bytes": [len(data)]})
            files, held, count = files + 1, 0, 0
            parts.clear()
            return row

        for batch in batches:
            for page, url, html, winner in zip(*(batch.column(c) for c in ("page_id", "url", "html", "winner")), strict=True):
                page, url, winner, payload = page.as_py(), url.as_py(), winner.as_py(), html.as_py().encode("utf-8", "surrogatepass")
                revisit = winner is not None and page != winner
                headers = {
                    "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(), "WARC-Date": DATE,
                    "WARC-Target-URI": None if url is None else "".join(url.splitlines()), "WARC-Payload-Digest": f"sha1:{digest(payload)}",
                    "Content-Type": "application/http; msgtype=response", "X-Page-ID": page, "X-Payload-Bytes": len(payload),
                }
                if revisit:
                    parts.append(record(headers | {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": winner}, HTTP_HEAD))
                    count += 1
                    held += len(parts[-1])
                else:
                    block = HTTP_HEAD + chunked(payload)
                    made = segments(headers, block, segment_bytes, name)
                    parts += made
                    count += len(made)
                    held += len(block)
                if held >= FILE_BYTES:
                    yield close()
        if parts:
            yield close()

    dealt.mapInArrow(store, "path string, n_records bigint, n_bytes bigint").write.parquet(f"{folder}/manifest")
    return spark.read.schema("path string, n_records bigint, n_bytes bigint").parquet(f"{folder}/manifest")


#: Of a record as the reader passes it on: its origin, place and last length, then what it says of the page.
RECORD = "origin string, number int, total bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, block binary"


def _entry(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(headers[k]) if k in headers else None
    origin = headers.get("warc-segment-origin-id") or headers["warc-record-id"]
    kind, told = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    size = number("x-payload-bytes")
    if kind == "response" and "warc-segment-number" not in headers:
        check(block, size, told)
        block = b""
    elif kind == "revisit":
        block = b""
    return origin, number("warc-segment-number") or 0, number("warc-segment-total-length"), number("x-page-id"), size, told, kind, number("x-refers-to-page-id"), block


def check(block: bytes, size: int, told: str) -> bytes:
    """The payload of an HTTP message; its length and digest must be those of the headers."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if len(payload) != size or digest(payload) != told:
        raise ValueError("a payload does not match its headers")
    return payload


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of segments (number, total length or None, bytes), in any order."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[2] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing")
    if parts[-1][1] != len(block):
        raise ValueError("segments do not add up to their total length")
    return block


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every archived record."""

    def load(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f, gzip.GzipFile(fileobj=f) as plain:
                    held, size = [], 0
                    for headers, block in records(io.BufferedReader(plain, 1 << 20)):
                        held.append(_entry(headers, block))
                        size += len(held[-1][-1])
                        if len(held) >= 5000 or size >= 8 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    def join(batches):
        origin, first, parts, out = None, None, [], []

        def close():
            if parts:
                if first is None:
                    raise ValueError("a continuation has no origin")
                check(join_segments(parts), first[4], first[5])
                out.append(first)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not row[1]:
                    out.append(row)
                    continue
                if row[0] != origin:
                    close()
                    origin, first, parts = row[0], None, []
                if row[6] != "continuation":
                    first = row
                parts.append((row[1], row[2], row[8]))
            if out:
                yield _batch(out, PAGE)
                out.clear()
        close()
        if out:
            yield _batch(out, PAGE)

    files = manifest.select("path")
    found = files.repartition(max(1, min(10_000, files.count()))).mapInArrow(load, RECORD)
    return found.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(join, PAGE)


PAGE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str = RECORD) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    where = [[f.split()[0] for f in RECORD.split(", ")].index(n) for n, _ in fields]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in zip(where, fields, strict=True)], names=[n for n, _ in fields])


def write_and_read(df: DataFrame, segment_bytes: int = SEGMENT_BYTES, least_bytes: int = 0) -> DataFrame:
    return read(write(df, work_dir(df.sparkSession, "warc"), segment_bytes, least_bytes))
