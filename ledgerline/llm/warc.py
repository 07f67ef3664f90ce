"""WARC archives as chunked record tables.

A payload is cut into chunks of a bounded size. Each becomes a segment of a WARC 1.1 record (the first a ``response``,
the others ``continuation``), written one by one. Reading gives a row per record id and chunk number, with the
digest of the payload up to the end of that chunk, and never puts a record together. Archives are written and
read by Spark's text source, so they can be in any store.

A segment ends with two line ends, and the next starts with the version line; both together part the rows when
an archive is read. A chunk is cut wherever a payload would hold that sequence itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, read

CHUNK = 1 << 20
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PART = END.encode() + VERSION


def digest_text(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def cuts(payload: memoryview, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of the chunks of a payload, at least one. No chunk between line ends holds the parting sequence."""
    start, n = 0, len(payload)
    while True:
        stop = min(start + most, n)
        inside = (END.encode() + bytes(payload[start:stop]) + END.encode()).find(PART)
        if inside >= 0:
            stop = start + inside + 5  # in the midst of the version line
        yield start, stop
        if stop == n:
            return
        start = stop


def merged_batches(run, most: int = 1 << 23):
    """``run`` with its one-row batches put together up to ``most`` bytes."""

    def together(batches):
        held, size = [], 0
        for small in run(batches):
            held.append(small)
            size += small.nbytes
            if size >= most or len(held) >= 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return together


def originals(named: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """``page_id, _same, refers_to`` of the pages that revisit another: equal payload, and not the largest id.

    Payloads are equal when their SHA-256 is. Ids meet their payload's largest id in a join whose one side has
    a row per payload that occurs twice or more, saved first: then adaptive execution can split a payload that fills a
    third of the table.
    """
    names = named.where(F.col("page_id").isNotNull() & (F.length("payload") >= min_bytes)).select("page_id", "_same")
    largest = names.groupBy("_same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    repeated = scratch.save(largest.where("_n > 1").drop("_n"), "repeated")
    return names.join(repeated, "_same").where("page_id < refers_to").distinct()


def segments(pages: DataFrame, min_bytes: int, most: int, id_column: str, payload_column: str, url_column: str) -> DataFrame:
    """A row per segment, ready to be written: header and block as text."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    named = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
        payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("_same"),
    )
    dealt = named.join(originals(named, min_bytes, Scratch(pages.sparkSession)), ["page_id", "_same"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, original = batch.column("url").to_pylist(), batch.column("refers_to").to_pylist()
            for i, name in enumerate(batch.column("page_id").to_pylist()):
                payload = memoryview(batch.column("payload")[i].as_buffer())
                whole = hashlib.sha1()
                for start in range(0, len(payload), most):
                    whole.update(payload[start : start + most])
                for head, block in record(name, urls[i], payload, digest_text(whole), original[i], most):
                    value = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block
                    yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

    rows = dealt.select("page_id", "url", "payload", "refers_to")
    return rows.mapInArrow(merged_batches(run), "value binary").select(F.col("value").cast("string"))


def record(name, url, payload, digest, original, most):
    """Headers and block of each segment of one record."""
    urn = f"<urn:page:{'' if name is None else name}>"
    target = "".join(c if c.isprintable() and not c.isspace() else "%{:02X}".format(ord(c)) for c in url or "")
    shared = [("WARC-Target-URI", target)] if target else []
    size = ("X-Payload-Length", len(payload))
    if original is not None:
        yield [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", urn), *shared,
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{original}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), size, ("Content-Length", 0),
        ], b""
        return
    for number, (start, stop) in enumerate(cuts(payload, most)):
        last = stop == len(payload)
        several = [("WARC-Segment-Number", number + 1)] if number or not last else []
        if number:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{urn[:-1]}:{number}>"), ("WARC-Segment-Origin-ID", urn), *shared]
        else:
            head = [("WARC-Type", "response"), ("WARC-Record-ID", urn), *shared]
        total = [("WARC-Segment-Total-Length", stop)] if number and last else []
        yield [*head, *several, *total, ("WARC-Payload-Digest", f"sha1:{digest}"), size, ("Content-Length", stop - start)], bytes(payload[start:stop])


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, most: int = CHUNK,
    id_column: str = "page_id", payload_column: str = "html", url_column: str = "url",
) -> str:
    """Writes a record per page to gzipped archives under ``path``, a file per task.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response and the
    others revisit it; smaller payloads are all responses. A null payload is empty. A page without an id is a response
    with an empty record name, and repeated rows of the largest id are all responses. An empty table writes no record. Only the three
    named columns are read.
    """
    rows = segments(pages, min_bytes, most, id_column, payload_column, url_column)
    rows.write.option("compression", "gzip").option("lineSep", END).text(path)
    return path


ARCHIVED = "page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, chunk binary, size long, digest string, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunk rows of the archives under ``path``.

    Segments of a record stand in one file in order, and a gzipped file is read by one task from its start, so a
    digest is carried from chunk to chunk: ``digest`` and ``size`` cover the payload so far. The last row of a record holds
    ``payload_bytes`` and ``payload_digest`` of the whole; what differs from the record's own header, or is cut short, is an
    error. ``payloads=False`` leaves ``chunk`` out of the rows.
    """
    rows = spark.read.option("lineSep", PART.decode()).text(path).select(F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = None
        for batch in batches:
            for value in batch.column("value"):
                head, block = parsed(value.as_buffer())
                kind, urn = head["WARC-Type"], head["WARC-Record-ID"]
                if kind == "continuation":
                    if running is None or head["WARC-Segment-Origin-ID"] != running[0]:
                        raise ValueError(f"{urn} does not follow the record it continues")
                    number = running[1] + 1
                else:
                    if running is not None:
                        raise ValueError(f"{running[0]} is cut short")
                    running, number = (urn, 0, hashlib.sha1(), 0), 0
                origin, _, digest, size = running
                digest.update(block)
                size += len(block)
                expected, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                whole = "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head
                if whole and kind != "revisit" and (size != length or digest_text(digest) != expected):
                    raise ValueError(f"{origin} does not match its digest")
                running = None if whole else (origin, number, digest, size)
                refers = head.get("WARC-Refers-To")
                name = lambda u: int(u[len("<urn:page:") : -1]) if len(u) > len("<urn:page:>") else None
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name(origin)], pa.int64()), pa.array([head.get("WARC-Target-URI")], pa.string()),
                        pa.array(["revisit" if kind == "revisit" else "response"]),
                        pa.array([name(refers) if refers else None], pa.int64()),
                        pa.array([number], pa.int32()), pa.array([whole]),
                        pa.array([bytes(block) if payloads else None], pa.binary()), pa.array([size], pa.int64()),
                        pa.array([digest_text(digest)]),
                        pa.array([length if whole else None], pa.int64()), pa.array([expected if whole else None], pa.string()),
                    ],
                    names=[c.split()[0] for c in ARCHIVED.split(", ")],
                )
        if running is not None:
            raise ValueError(f"{running[0]} is cut short")

    return rows.mapInArrow(merged_batches(run), ARCHIVED)


def parsed(value: pa.Buffer) -> tuple[dict[str, str], memoryview]:
    """Headers and block of one segment as the text source parts them: the first of a file has its version line,
    the last its closing line ends."""
    view = memoryview(value)
    start = len(VERSION) if bytes(view[: len(VERSION)]) == VERSION else 0
    stop = start
    while True:  # headers are short; look for their end a piece at a time
        stop += 4096
        at = bytes(view[start:stop]).find(END.encode())
        if at >= 0:
            break
        if stop >= len(view):
            raise ValueError("a segment without a header")
    head = dict(line.split(": ", 1) for line in bytes(view[start : start + at]).decode().split("\r\n"))
    block = view[start + at + 4 :]
    length = int(head["Content-Length"])
    if bytes(block[length : length + 5]) not in (b"", END.encode()):
        raise ValueError(f"{head['WARC-Record-ID']} is not as long as its header says")
    if len(block) < length:
        raise ValueError(f"{head['WARC-Record-ID']} is cut short")
    return head, block[:length]


def op3_warc_round_trip(spark, folder) -> DataFrame:
    path = write_archives(read(spark, folder, "pages"), Scratch(spark).path("warc"))
    return read_archives(spark, path, payloads=False).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), largest AS (
  SELECT payload, max(page_id) AS newest FROM hashed GROUP BY payload
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM hashed JOIN largest USING (payload)
"""
