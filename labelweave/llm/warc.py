"""WARC archives whose repeated payloads are revisit records, written and read by Spark.

An archive is a sequence of gzip members, one per record. Spark's text writer puts them on storage, so files are committed
as any other output of a job is, and a lost executor costs a task. The writer ends each row with a separator: it is the
zero byte that ends a gzip member of less than 16 MiB, and larger records get an empty member behind them.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.shared import stored
from labelweave.session import shared_dir

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_ID = "urn:record:"
#: Raw bytes of records that one archive file holds on average at most.
FILE_BYTES = 48 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: each ten hex digits are forty bits, or eight letters."""
    parts = [
        F.lpad(F.conv(F.substring(F.sha1(payload), at, 10), 16, 32), 8, "0") for at in range(1, 41, 10)
    ]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def headers(pages: DataFrame) -> DataFrame:
    """What decides a record's type, without its payload: page_id, payload_bytes, payload_digest."""
    payload = payload_of(F.col("html"))
    return pages.select(
        "page_id", F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )


def originals(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Revisits and the record each of them revisits: page_id, payload_digest, refers_to.

    Headers meet by payload digest. A digest's smallest page_id is its response; only digests with a second page come
    back to their headers, as a written table, so that Spark knows its size, and splits a hot digest.
    """
    eligible = heads.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    shared = (
        eligible.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
        .filter("refers_to < last")
        .drop("last")
    )
    return (
        eligible.join(stored(shared, "digests"), "payload_digest")
        .filter("page_id > refers_to")
        .select("page_id", "payload_digest", "refers_to")
        .distinct()
    )


def _member(record: bytes) -> bytes:
    """A gzip member without the zero byte that ends it."""
    packed = gzip.compress(record, 6, mtime=0)
    return (packed if packed[-1] == 0 else packed + gzip.compress(b"", mtime=0))[:-1]


def _record(row) -> bytes:
    revisit = not pd.isna(row.refers_to)
    payload = b"" if revisit else (row.html or "").encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{RECORD_ID}{'' if pd.isna(row.page_id) else int(row.page_id)}>"),
        ("WARC-Date", row.date),
        ("WARC-Target-URI", "".join((row.url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{row.payload_digest}"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD_ID}{int(row.refers_to)}>")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"{VERSION}\r\n{head}\r\n".encode() + payload + b"\r\n\r\n"


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"member": [_member(_record(row)) for row in batch.itertuples(index=False)]})


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` (page_id, url, html) with fresh headers below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a response with the
    payload, the others are revisits without it. A null html is an empty payload, a null url an empty target; white space
    goes from a target. A row without page_id is a response with an empty id. Rows that repeat a page_id are written as
    often as they stand there, each by its own payload: a revisit is found by page_id and digest together. Other columns
    are ignored.
    """
    heads = headers(pages)
    revisits = stored(originals(heads, min_bytes), "revisits")
    size = heads.agg(F.avg("payload_bytes")).first()[0] or 0
    records = (
        pages.select(
            "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
            base32_sha1(payload_of(F.col("html"))).alias("payload_digest"),
        )
        .join(revisits, ["page_id", "payload_digest"], "left")
        .select(
            "page_id", "refers_to", "url", "payload_digest",
            F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), F.lit(date).alias("date"),
        )
    )
    (
        records.mapInPandas(_pack, "member binary")
        .select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", "\u0000")
        .option("maxRecordsPerFile", max(1, int(FILE_BYTES // (size + 400))))
        .text(path)
    )


def _members(content: bytes) -> Iterator[bytes]:
    """Records of an archive; one member at a time is unpacked."""
    view = memoryview(content)
    while view:
        unpack = zlib.decompressobj(wbits=31)
        record = unpack.decompress(view)
        rest = len(unpack.unused_data)
        view = view[len(view) - rest :]
        if record:
            yield record


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; a block is as long as its header says."""
    head, _, block = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:80]!r}")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    length = int(fields["content-length"])
    if len(block) != length + 4:
        raise ValueError(f"a block of {len(block) - 4} bytes, {length} announced")
    return fields, block[:length]


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = (
        "warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-refers-to",
    )
    for batch in batches:
        for content in batch["content"]:
            rows, held = [], 0
            for record in _members(content):
                fields, block = parse_record(record)
                rows.append((*(fields.get(name) for name in names), block))
                held += len(block)
                if len(rows) >= 1000 or held > 8 << 20:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=COLUMNS)


COLUMNS = ["record_id", "record_type", "target_uri", "record_date", "payload_digest", "refers_to", "block"]
READ = ", ".join(f"{c} {'binary' if c == 'block' else 'string'}" for c in COLUMNS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``, a row each; a file is a task's, its records are unpacked one by one."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_unpack, READ)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the size and digest of the full payload, which revisits take from the response they refer to.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit meets its response by page_id and
    digest, so a page_id that stands for several payloads keeps each. Only headers are shuffled.
    """
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("long")
    heads = records.select(
        number(F.col("record_id")).alias("page_id"), F.octet_length("block").cast("long").alias("stored_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
    heads = stored(heads, "heads")
    wanted = stored(heads.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct(), "wanted")
    responses = (
        heads.filter("record_type = 'response'")
        .join(wanted.withColumnRenamed("refers_to", "page_id"), ["page_id", "payload_digest"], "left_semi")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.min("stored_bytes").alias("original_bytes"))
    )
    return heads.join(stored(responses, "responses"), ["refers_to", "payload_digest"], "left").select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("original_bytes")).otherwise(F.col("stored_bytes")).alias(
            "payload_bytes"
        ),
        "payload_digest", "record_type", "refers_to",
    )


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, min_bytes)
    return resolved(read_archives(spark, path))
