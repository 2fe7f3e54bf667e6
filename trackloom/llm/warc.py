"""WARC archives with revisit records.

Only headers (digest, page id, length and where the page stands) are shuffled, by payload digest: each digest's smallest
page id is the original, and the other pages with that payload become revisit records which refer to it. Pages are
written once in blocks, and the answers come to the blocks. The archives are gzip files of WARC/1.1 records with fresh
headers, written and read back by Spark, so any store that Spark reaches does; Spark's writer makes one gzip member a
file. A file has ``FILE_BYTES`` at most before compression (one record may be larger), as a reading task takes it whole:
pages over ``SMALL_BYTES`` go to archives of their own, with fewer records each.

Defined results: a null page counts as an empty payload; payloads under ``least_bytes`` are never revisits; rows
that repeat the original's ``page_id`` are responses too; a page without an id becomes a revisit only of a page
that has one; line breaks and control characters are taken out of a url; an empty table gives empty archives; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import cut_blocks, unpack_rows, with_answers
from .common import scratch

LEAST_BYTES = 100
#: Bytes in a file, and bytes of a page that goes with the others.
FILE_BYTES = 256_000_000
SMALL_BYTES = 64_000
#: Headers' share of a file.
HEAD_BYTES = 1_000
#: Copies of an original's page id that go out, so that its revisits needn't meet in one task.
SALTS = 16
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def resolve_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    blocks = cut_blocks(page, "pages")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = unpack_rows(data.as_py())
                n = rows.num_rows
                columns = pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), *(rows.column(c).combine_chunks() for c in ("page_id", "payload_bytes", "payload_digest"))
                yield from pa.table(list(columns), ["block", "row", "page_id", "payload_bytes", "payload_digest"]).to_batches()

    found = blocks.select("block", "data").mapInArrow(headers, "block long, row long, page_id long, payload_bytes long, payload_digest string")
    found = found.filter(F.col("payload_bytes") >= least_bytes).withColumn("salt", F.pmod("row", F.lit(SALTS)))
    originals = found.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1 AND refers_to IS NOT NULL")
    originals = originals.select("payload_digest", "refers_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    revisits = found.join(originals, ["payload_digest", "salt"]).filter("NOT (page_id <=> refers_to)").select("block", "row", "refers_to")

    def referring(_block: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        refers_to, known = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, bool)
        at = answers.column("row").to_numpy()
        refers_to[at], known[at] = answers.column("refers_to").to_numpy(), True
        return rows.append_column("refers_to", pa.array(refers_to, mask=~known))

    return with_answers(blocks, revisits, referring, "page_id long, url string, payload string, payload_bytes long, payload_digest string, refers_to long")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("unknown")), F.lit(">"))


def warc_records(resolved: DataFrame, date: str) -> DataFrame:
    """One text column: a whole record without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(_CRLF))

    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "")
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.when(url != "", url)), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return resolved.select(F.concat(head, F.lit(_CRLF), block).alias("value"))


def write_archives(resolved: DataFrame, path: str, date: str, largest: int) -> None:
    """Archives of pages as ``resolve_revisits`` gives them, whose payloads have ``largest`` bytes at most. A record ends
    with two line ends, which is what the text writer puts between lines."""
    small = F.col("payload_bytes") <= SMALL_BYTES
    for name, size, which in (("small", SMALL_BYTES, small), ("large", largest, ~small)):
        if name == "small" or largest > SMALL_BYTES:
            records = max(1, FILE_BYTES // (size + HEAD_BYTES))
            warc_records(resolved.filter(which), date).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/{name}")


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.lower()] = value.strip()
    return found


def _page_id(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _records(content: bytes) -> Iterator[tuple]:
    with gzip.open(io.BytesIO(content)) as stream:
        while first := stream.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            head = _headers(stream)
            block = io.BytesIO(stream.read(int(head["content-length"])))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its length says")
            block.readline()
            http, digest, kind = _headers(block), head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
            payload = block.read()
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"damaged payload in {head['warc-record-id']}")
            size = len(payload) if kind == "response" else int(http["content-length"])
            yield _page_id(head["warc-record-id"]), size, digest, kind, _page_id(head.get("warc-refers-to"))


def read_archives(spark, path: str) -> DataFrame:
    """What the records' headers say; the payloads of responses are held against their digests."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                columns = list(zip(*_records(content.as_py()))) or [[] for _ in _ARROW]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(parse, _SCHEMA)


def archive_round_trip(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    write_archives(resolve_revisits(pages), path, date, largest)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, strlen(h) AS n, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS o FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o <> page_id THEN o END AS refers_to FROM f
"""
