"""WARC archives with a Zstandard dictionary of their own."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from twinlake.llm.batches import pieces, release
from twinlake.session import new_path, partitions, ship_package, written
from twinlake.sources.shared_files import read_file, write_file

#: The frame magics of Zstandard, and the skippable one that holds a dictionary.
FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A5D
#: Payload bytes of an archive at least, but for the last of a task; what a task holds at once.
ARCHIVE_BYTES = 16 << 20
#: Size of a dictionary, and bytes of records spread over the archive that it is built from.
DICT_BYTES, TRAINING_BYTES = 32 << 10, 2 << 20
EDGES = "\r\n"


#: Fixed value: what a revisit of an equal payload declares.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page: int | None, digest: str, place: str) -> str:
    """The record id of a page: that of its payload, so that a revisit can name it; without a page, of its place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place if page is None else f'{page} {digest}')}>"


def record(
    kind: str, page: int | None, url: str | None, digest: str, length: int, first: int | None, body: bytes, date: str, place: str = ""
) -> bytes:
    """One WARC record of an HTTP response. A revisit names its response and has no payload.

    Page ids travel in headers of their own. place tells records without a page apart.
    """
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page, digest, place)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}",
        f"X-Page: {'' if page is None else page}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(first, digest, place)}", f"X-Refers-To-Page: {first}"]
    http = EDGES.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {length}"])
    block = (http + 2 * EDGES).encode() + body
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return (EDGES.join(head) + 2 * EDGES).encode() + block + 2 * EDGES.encode()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split(EDGES)
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    said = dict(x.split(": ", 1) for x in lines[1:])
    return said, rest[: int(said["Content-Length"])].partition(b"\r\n\r\n")[2]


def _page(number: str) -> int | None:
    return int(number) if number else None


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Built from records spread evenly over the archive; what they begin with where they are too few to train on."""
    every = max(1, sum(map(len, records)) // TRAINING_BYTES)
    some = records[::every]
    try:
        return zstandard.train_dictionary(DICT_BYTES, some, k=256, d=8)
    except zstandard.ZstdError:
        raw = b"".join(r[: max(8, DICT_BYTES // len(some))] for r in some)[:DICT_BYTES]
        return zstandard.ZstdCompressionDict(raw.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The parts of one archive: the dictionary in a skippable frame, then a frame for each record."""
    found = _dictionary(records)
    raw = found.as_bytes()
    yield struct.pack("<II", DICTIONARY, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=level, dict_data=found, write_content_size=True, write_checksum=True)
    for r in records:
        yield packer.compress(r)


def _frame_end(raw: memoryview, at: int) -> int:
    """Where the Zstandard frame at a place ends, from its block headers."""
    said = zstandard.get_frame_parameters(raw[at : at + 18])
    end = at + zstandard.frame_header_size(raw[at : at + 18])
    while True:
        block = int.from_bytes(raw[end : end + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else size)
        if last:
            return end + 4 * said.has_checksum


def records(raw: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    view = memoryview(raw)
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICTIONARY:
        raise ValueError("the archive begins with no dictionary frame")
    found = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    unpacker, at = zstandard.ZstdDecompressor(dict_data=found), 8 + size
    while at < len(raw):
        end = _frame_end(view, at)
        yield unpacker.decompress(view[at:end])
        at = end


def plan_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, digest, length, first): first is the page that a record refers to, else null.

    Payloads of least_bytes and more are grouped by digest; the least page_id of
    a group is its response. Only digests and ids meet there: pages then fetch
    what they refer to by their own id, so a payload that many pages have makes
    no large task.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"), F.octet_length(body).cast("long").alias("length"),
    )
    thin = p.where((F.col("length") >= least_bytes) & F.col("page_id").isNotNull()).select("digest", "page_id")
    thin = written(thin, "warc-digests")  # so that groups and revisits do not hash the pages again
    many = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    many = written(many.where("first < last").select("digest", "first"), "warc-copies")  # plain, so a hot digest can be split
    revisits = written(thin.join(many, "digest").where("page_id > first").distinct(), "warc-revisits")
    out = p.where("page_id is not null").join(revisits, ["page_id", "digest"], "left")
    return out.union(p.where("page_id is null").withColumn("first", F.lit(None).cast("long")).select(out.columns))


def write_warc(pages: DataFrame, uri: str, level: int = 3, least_bytes: int = 100, date: str | None = None) -> DataFrame:
    """Writes the pages (page_id, url, html) as WARC archives to the folder uri; (name, records) of each archive.

    A record is response, or revisit where an equal payload of least_bytes or
    more has a smaller page_id. date is that of all records, in UTC, by default
    the time of the call. Record ids are made from page_id and payload, so rows
    that repeat both share one. A null html is an empty payload. Equal payloads
    on rows that repeat the least page_id are all responses; a payload whose
    page_ids are null on some rows has its response among the others, and null
    rows are responses too. Payloads of any length are one record. Other columns
    are not read. An empty table writes no archive, and an empty manifest.
    """
    ship_package(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, names, counts = TaskContext.get(), [], 0, [], []

        def flush() -> None:
            nonlocal held, size
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):05d}.warc.zst"
            names.append(write_file(uri, name, archive(held, level)))
            counts.append(len(held))
            held, size = [], 0

        for b in pieces(batches, "html"):
            for page, url, html, digest, length, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = "response" if first is None else "revisit"
                body = (html or "").encode() if first is None else b""
                place = f"{uri} {task.partitionId()} {task.taskAttemptId()} {len(names)} {len(held)}"
                held.append(record(kind, page, url, digest, length, first, body, date, place))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    flush()
        if held:
            flush()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["name", "records"])

    rows = plan_records(pages, least_bytes).select("page_id", "url", "html", "digest", "length", "first")
    # a revisit's payload is not needed any more
    rows = rows.withColumn("html", F.when(F.col("first").isNull(), F.col("html")))
    return written(rows.mapInArrow(work, "name string, records long"), "warc-manifest")


def read_warc(manifest: DataFrame, uri: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_length, refers_to, payload) of every record.

    The payload of a response is checked against its length; a revisit has none.
    """
    ship_package(manifest.sparkSession)
    kind = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string())]
        + [("payload_length", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("name").to_pylist():
                with read_file(uri, name) as f:
                    raw = f.read()
                rows, size = [], 0
                for said, body in map(parse, records(raw)):
                    revisit, length = said["WARC-Type"] == "revisit", int(said["X-Payload-Length"])
                    if not revisit and len(body) != length:
                        raise ValueError(f"{name}: a payload of {len(body)} bytes, not {length}")
                    rows.append(
                        (_page(said["X-Page"]), said["WARC-Target-URI"], said["WARC-Type"])
                        + (said["WARC-Payload-Digest"].removeprefix("sha256:"), length)
                        + (_page(said["X-Refers-To-Page"]) if revisit else None, None if revisit else body)
                    )
                    size += len(body)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kind)], schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), kind)], schema=kind)
        release()

    dealt = manifest.select("name").repartition(partitions(manifest.sparkSession), "name")
    return dealt.mapInArrow(
        work,
        "page_id long, url string, record_type string, payload_digest string, payload_length long, "
        "refers_to long, payload binary",
    )


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as the archives give them back; digests of responses are of the bytes read."""
    uri = new_path(spark, "warc")
    out = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri), uri)
    return out.select(
        "page_id",
        F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""
