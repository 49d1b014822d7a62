"""WARC archives of pages: written as records with revisits, continuation segments and chunked framing, and read back.

Reading groups the continuation records of a record by their origin identifier, orders them by segment
number, verifies that none is missing and that the lengths add up to the total of the last one, and decodes
the chunked transfer framing of the whole. Archives are written and read by Spark alone, so any file system
that Spark knows will do; a file holds at most FILE_RECORDS records of at most a segment each, which bounds
what a reading task has in memory beside one whole record.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches, new_path, removed, written

#: Bytes of a segment's block and of a transfer chunk; records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 1 << 12, 1 << 10, 2000
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: 4 times 5 bytes are 8 digits."""
    digest = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*(part(i) for i in range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    at, parts = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has another length than it says")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, without transfer framing."""
    head, found, body = block.partition(_END)
    if not found:
        raise ValueError("no end of the HTTP header")
    framed = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return dechunked(body) if framed else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(record_id: str, page_id: int | None, url: str, digest: str, payload: bytes | None, refers_to: str | None, segment: int) -> Iterator[bytes]:
    """The records of a page, without the empty lines that end them; payload None: a revisit."""
    common = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        common.append(("X-Page-ID", str(page_id)))
    if payload is None:
        extra = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
        yield _record(extra + common, _HTTP)
        return
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{k}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(fields, part)


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes a record, with its continuations, for each row of pages (page_id, url, html) to files in path.

    Of rows with equal payloads the one with the least page_id is a response, the others revisit it; rows
    without a page_id come last, and of rows with equal page_ids the one that is read first. A null html is
    an empty payload, a null url an empty one.
    """
    bounded_batches(pages.sparkSession)
    plain = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    plain = plain.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    # row ids hold for one reading of the input only, so the rows are written with them until the archives are there
    spark, kept = pages.sparkSession, new_path(pages.sparkSession, "warc-rows")
    plain = written(plain, "warc-rows", kept)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = written(plain.groupBy("digest", "size").agg(F.min(order).alias("first")), "warc-firsts")
    dealt = plain.join(firsts.hint("merge"), ["digest", "size"]).withColumn("first_row", F.col("first.row"))
    dealt = dealt.select("row", "first_row", "page_id", "url", "digest", F.when(F.col("row") == F.col("first_row"), F.col("payload")).alias("payload"))
    name = lambda row: f"urn:uuid:{uuid.UUID(int=(0x7469646D << 96) | row)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, first, page_id, url, digest, payload in zip(*(x.to_pylist() for x in batch.columns)):
                safe = "".join(x if "!" <= x <= "~" else "".join(f"%{b:02X}" for b in x.encode()) for x in url)
                out += records(name(row), page_id, safe, digest, payload, name(first), segment)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    removed(spark, kept)


_PARSED = "record_id string, record_type string, page_id long, url string, refers_to_id string, digest string, origin_id string, segment long, total long, block binary"
_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _PARSED.split(", ")])


def parse(content: bytes) -> Iterator[tuple]:
    """The records of an archive; empty lines between them don't matter."""
    at, n = 0, len(content)
    while True:
        while content[at : at + 2] == b"\r\n":
            at += 2
        if at >= n:
            return
        end = content.index(_END, at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        got = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(got["content-length"])
        bare = lambda k: got[k].strip("<>") if k in got else None
        number = lambda k: int(got[k]) if k in got else None
        block = content[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut short")
        yield bare("warc-record-id"), got.get("warc-type"), number("x-page-id"), got.get("warc-target-uri"), bare("warc-refers-to"), got.get("warc-payload-digest", "").removeprefix("sha1:"), bare("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block
        at = end + 4 + size


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id, url, refers_to_id, digest (as declared), payload and problem of each record
    of the files part-* in path, which may be gzip files.

    Continuations are joined to their first record. payload is null for revisits and where problem tells
    what is wrong: a missing segment, a total length that differs, broken framing. Segments that are there
    twice count once. Other record types are left out.
    """
    bounded_batches(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_py()
                for x in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append(x)
                    if len(rows) == 500:
                        yield _batch(rows, _ARROW)
                        rows = []
                if rows:
                    yield _batch(rows, _ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parts = files.mapInArrow(split, _PARSED).where(F.col("record_type").isin("response", "revisit", "continuation"))
    # used twice, for single records and for segments, so the files are opened once
    parts = written(parts.withColumn("whole", F.coalesce("origin_id", "record_id")), "warc-parts")
    fields = pa.schema([*(f for f in _ARROW if f.name in ("record_id", "record_type", "page_id", "url", "refers_to_id", "digest")), ("payload", pa.binary()), ("problem", pa.string())])

    def finish(rows: list[tuple]) -> tuple:
        rows.sort(key=lambda x: x[7] or 1)
        kept = [x for i, x in enumerate(rows) if not i or (x[7] or 1) != (rows[i - 1][7] or 1)]
        first, payload, problem = kept[0], None, None
        total = next((x[8] for x in kept if x[8] is not None), None)
        block = b"".join(x[9] for x in kept)
        if first[1] == "continuation":
            problem = "first segment missing"
        elif [x[7] or 1 for x in kept] != list(range(1, len(kept) + 1)) or (first[7] is not None and total is None):
            problem = "segment missing"
        elif total is not None and total != len(block):
            problem = "total length differs"
        elif first[1] == "response":
            try:
                payload = http_payload(block)
            except ValueError as x:
                problem = f"broken framing: {x}"
        return (*first[:6], payload, problem)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rows, out = None, [], []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if x[-1] != whole and rows:
                    out.append(finish(rows))
                    rows = []
                whole = x[-1]
                rows.append(x)
            if out:
                yield _batch(out, fields)
                out = []
        if rows:
            out.append(finish(rows))
        if out:
            yield _batch(out, fields)

    # records of one segment need no grouping; the others meet in the order of their segments
    result = "record_id string, record_type string, page_id long, url string, refers_to_id string, digest string, payload binary, problem string"
    alone = F.col("origin_id").isNull() & F.col("segment").isNull()
    single = parts.where(alone).mapInArrow(lambda batches: (_batch([finish([x]) for x in zip(*(c.to_pylist() for c in b.columns))], fields) for b in batches if b.num_rows), result)
    several = parts.where(~alone).repartition("whole").sortWithinPartitions("whole", "segment").mapInArrow(join, result)
    return single.union(several)


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, from the archives of all pages."""
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path, segment)
    read = read_archives(spark, path)
    read = read.select("record_id", "page_id", "record_type", "refers_to_id", "problem", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "digest")
    read = written(read, "warc-read")
    removed(spark, path)
    bad = F.col("problem").isNotNull() | (F.col("payload_digest") != F.col("digest"))
    read = read.withColumn("page_id", F.when(bad, F.raise_error(F.concat(F.lit("broken record "), "record_id"))).otherwise(F.col("page_id")))
    first = read.where("record_type = 'response'").select(F.col("record_id").alias("first_id"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    own = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read.where("record_type = 'revisit'").join(first.hint("merge"), F.col("refers_to_id") == F.col("first_id"), "left")
    again = again.select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), "record_type", F.col("first_page").alias("refers_to"))
    return own.union(again)


def oracle_sql() -> str:
    """round_trip() over the view pages, for DuckDB; page_id must be unique."""
    part = " || ".join(f"to_base(('0x' || substr(h, {10 * i + 1}, 10))::BIGINT, 32, 8)" for i in range(4))
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, translate(upper({part}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p
    """
