"""WARC archives without repeated payloads: revisit records are resolved by digest, written, and read back.

Defined results: a null html is an empty payload; a null url has no target field; a null page_id sorts last; rows that
share page_id and payload get the same kind of record; an empty table gives no files and no rows; extra columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilattice.llm.files import FILE_BYTES, Files, read_files
from epilattice.llm.rows import as_bytes, chunks, pick
from epilattice.session import scratch_path, settle

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids are made from page id and digest below this name, so a task that runs again writes the same ones.
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "page-records")
#: Date of the records where the table has none.
DATE = "1970-01-01T00:00:00Z"
GZIP_LEVEL = 4


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, first_id, first_url``: the original's page where a row repeats its payload, else nulls.

    Only headers (page_id, url, digest, size) are shuffled by digest. The original is an aggregate with map-side
    combine, so the most common payload costs one row per task; rows with html are shuffled once, by page.
    """
    rows = pages.withColumn("payload", F.coalesce("html", F.lit("")).cast("binary"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload")).drop("payload")
    headers = rows.select("page_id", "url", "sha", "size").filter(F.col("size") >= least_bytes)
    page = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    firsts = headers.groupBy("sha", "size").agg(F.min(page).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeats = (
        headers.select("page_id", "sha", "size").distinct().join(firsts, ["sha", "size"])
        .filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
        .select(F.col("page_id").isNull().alias("k0"), F.coalesce("page_id", F.lit(0)).alias("k1"), F.col("sha").alias("k2"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    keyed = rows.select("page_id", "url", "html", F.col("page_id").isNull().alias("p0"), F.coalesce("page_id", F.lit(0)).alias("p1"), "sha")
    met = keyed.join(repeats, (F.col("p0") == F.col("k0")) & (F.col("p1") == F.col("k1")) & (F.col("sha") == F.col("k2")), "left")
    known = F.col("k1").isNotNull()
    return met.select("page_id", "url", F.when(~known, F.col("html")).alias("html"), "sha", known.alias("repeat"), "first_id", "first_url")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, repeat: bool, first_id: int | None, first_url: str | None, date: str = DATE) -> bytes:
    """One record with fresh headers, without its compression."""
    identity = lambda page: f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}/{digest}')}>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if repeat else head + payload
    fields = [
        ("WARC-Type", "revisit" if repeat else "response"),
        ("WARC-Record-ID", identity(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("WARC-Profile", PROFILE if repeat else None),
        ("WARC-Refers-To", identity(first_id) if repeat else None),
        ("WARC-Refers-To-Target-URI", _uri(first_url) if repeat else None),
        ("WARC-Refers-To-Date", date if repeat else None),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields if value is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    """A target that fits on a header line: white space and control signs are percent-encoded."""
    return None if url is None else "".join(quote(c) if c.isspace() or ord(c) < 33 or ord(c) == 127 else c for c in url)


def members(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each from its own gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            piece = view[at : at + 65536]
            if not len(piece):
                raise ValueError("the archive ends within a record")
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; its block digest has to hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return fields, block.partition(b"\r\n\r\n")[2]


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) below ``folder``; returns the committed files (``file, n``)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, parts, size = Files(folder, ".warc.gz"), [], [], 0
        for part in chunks(batches):
            page_ids, urls, htmls, shas, repeats, first_ids, first_urls = (as_bytes(c) if i == 2 else c.to_pylist() for i, c in enumerate(part.columns))
            for page_id, url, html, sha, repeat, first_id, first_url in zip(page_ids, urls, htmls, shas, repeats, first_ids, first_urls, strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = zlib.compress(record(page_id, url, html, digest, repeat, first_id, first_url), GZIP_LEVEL, 31)
                parts.append(data)
                size += len(data)
                if size >= file_bytes:
                    done.append((out.write(b"".join(parts)), len(parts)))
                    parts, size = [], 0
        if parts:
            done.append((out.write(b"".join(parts)), len(parts)))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["file", "n"])

    rows = resolve(pages, least_bytes)
    return settle(rows.mapInArrow(write, "file string, n long"), "warc-files")


RECORDS = "page_id long, url string, record_id string, record_type string, refers_id string, payload_digest string, payload_bytes long, payload binary"


def read_records(spark: SparkSession, folder: str, listed: DataFrame, payloads: bool = True) -> DataFrame:
    """Each record as it stands in the archives (see ``RECORDS``); a revisit has no payload of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in members(content.as_py()):
                    fields, payload = parse(data)
                    own = fields["WARC-Type"] == "response"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if own and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"record {fields['WARC-Record-ID']} has another payload than its digest says")
                    page = fields.get("X-Page-ID")
                    rows.append((None if page is None else int(page), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), digest, len(payload) if own else None, payload if own and payloads else None))
                    held += len(payload)
                    if held >= 8 << 20 or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return read_files(spark, folder, listed).select("content").mapInArrow(read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: a revisit gets page, size and payload of the response that it names."""
    own = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    named = records.filter("record_type = 'response'").groupBy("record_id").agg(
        F.min("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload").alias("payload"), F.first("payload_digest").alias("named_digest")
    )
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload").join(named.withColumnRenamed("record_id", "refers_id"), "refers_id", "left")
    wrong = F.col("named_digest").isNull() | (F.col("named_digest") != F.col("payload_digest"))
    revisits = revisits.withColumn("record_type", F.when(wrong, F.raise_error(F.lit("a revisit names no response with its payload"))).otherwise(F.col("record_type")))
    columns = [*own.columns]
    return own.unionByName(revisits.select(*columns))


def archive(pages: DataFrame, least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write all pages, read the archives back and resolve the revisits; payloads come back on demand."""
    spark = pages.sparkSession
    rows = pick(pages, page_id="page_id", url="url", html="html")
    folder = scratch_path(spark, "warc")
    listed = write_warc(rows, folder, least_bytes)
    if not listed.take(1):
        return spark.createDataFrame([], RECORDS + ", refers_to long")
    records = settle(read_records(spark, folder, listed, payloads), "warc-records")
    return resolved(records)
