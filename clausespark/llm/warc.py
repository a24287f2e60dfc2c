"""Operator 1: WARC archives with revisit records for payloads that repeat.

Headers (digest, length, page) are shuffled by payload digest, the newest page of each digest becomes the response,
and every other page is joined to it and written as a revisit. Records go out through Spark's text writer, whose
record separator is the CRLF CRLF that ends a WARC record, so lost tasks are written again and committed once.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.llm.common import new_path

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Salts of one digest: its pages meet in so many places at most, so a digest with a third of all pages is spread.
SALTS = 4096
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page/"), F.coalesce(page_id.cast("string"), F.lit("none"))))
    part = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null; line breaks cannot be smuggled in."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def resolve_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest and refers_to.

    Of pages with equal payloads of at least min_bytes the largest page_id stays (refers_to null); the others point to
    it. Null html is an empty payload. Pages with a null page_id are never pointed to; rows that repeat a page_id and
    payload are both responses or both revisits. Other columns are left out.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": F.sha1(F.col("payload").cast("binary")),
    })
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    head = p.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "payload_bytes", "salt", "page_id")
    placed = head.groupBy("payload_digest", "payload_bytes", "salt").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    target = placed.groupBy("payload_digest", "payload_bytes").agg(F.max("top").alias("target"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    target = target.select("payload_digest", "payload_bytes", F.explode("salts").alias("salt"), "target")
    joined = p.join(target, ["payload_digest", "payload_bytes", "salt"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("target")), None).otherwise(F.col("target"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 10_000, compression: str = "gzip") -> None:
    """Write one WARC/1.1 record per page to files under path; see resolve_revisits for what becomes a revisit."""
    r = resolve_revisits(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    block_bytes = F.octet_length(body) + len(HTTP_HEAD)
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _header("X-Page-ID", F.col("page_id")),
        _header("X-Refers-To-Page-ID", F.col("refers_to")),
        _header("X-Payload-Length", F.col("payload_bytes")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", block_bytes),
        F.lit(CRLF + HTTP_HEAD),
        body,
    )
    r.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one archive file; gzip is undone a piece at a time."""
    raw = _Unzipped(content) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    src = io.BufferedReader(raw, 1 << 16) if isinstance(raw, _Unzipped) else raw
    while line := src.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := src.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        n = int(head["content-length"])
        block = src.read(n)
        if len(block) < n or src.read(4) != b"\r\n\r\n":
            raise ValueError("the archive ends within a record")
        yield head, block


class _Unzipped(io.RawIOBase):
    def __init__(self, content: bytes):
        self.rest, self.left = zlib.decompressobj(31), content

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            got = self.rest.decompress(self.left, len(out))
            self.left = self.rest.unconsumed_tail
            if not got and self.rest.eof and self.rest.unused_data:
                self.rest, self.left = zlib.decompressobj(31), self.rest.unused_data
                continue
            out[: len(got)] = got
            return len(got)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under path, one row each: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Length and digest of a response are taken anew from its payload; those of a revisit are what its header says of the
    full payload. payload is null for revisits, and everywhere if payloads is False.
    """

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for head, block in parse_records(bytes(content)):
                    kind = head["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2]
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if f"sha1:{digest}" != head["warc-payload-digest"]:
                            raise ValueError(f"damaged payload in record {head['warc-record-id']}")
                    else:
                        size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                    number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), size, digest, kind, number("x-refers-to-page-id"), head.get("warc-target-uri"), payload if payloads and kind == "response" else None))
                    held += len(payload) if payloads else 0
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield _frame(rows)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, READ)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])
    return f.astype({"page_id": "Int64", "refers_to": "Int64"})


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back, by the digest contract of operator 1."""
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest,
             CASE WHEN strlen(t) >= 1000 THEN max(page_id) OVER (PARTITION BY t) END AS target FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN target IS NOT NULL AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN target <> page_id THEN target END AS refers_to
FROM q
"""
