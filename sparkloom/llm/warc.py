"""WARC: archives that are one gzip stream, normalised to one member per record with a sidecar offset index.

write_archives() writes records through Spark's text sink with gzip, so each file is a single stream. normalise() inflates
each such stream once, piece by piece, rewrites every record as a gzip member of its own and writes a sidecar beside the archive, a line
(offset, length, record id) a record; it holds one record and a piece, however long the archive. read_archives() reads an archive along its
sidecar in one task and inflates single members. Files are named after their source, written under another name and renamed, so a
task that runs twice leaves one whole file.

Of pages with equal payloads of `least` bytes or more, the largest page_id is stored; the others are revisit records. That is
decided on rows of (page_id, url, digest, size); revisits are written from these, and no payload is shuffled (see common.without).

Defined results: a null html is an empty payload. Pages with the same payload and page_id (repeated rows) are all response.
A null page_id revisits if any page_id of its payload is known, else it is response. URLs lose control characters; a null or
empty one becomes urn:page:ID. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.files import opened, written

from .common import TABLE_KEYS, Scratch, new_folder, remove, stored, without

LEAST = 1000
RECORDS_PER_FILE = 20_000
LEVEL = 4
_HEAD_END = b"\r\n\r\n"
#: Fixed value: archives carry no clock time, so that reruns give the same bytes.
DATE = "2000-01-01T00:00:00Z"


def _record(again: bool, payload: Column | None) -> Column:
    """A record without its last line end, from page_id, url, digest, n and, of revisits, first."""
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    refers = [F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\n")] if again else []
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: " + ("revisit" if again else "response") + "\r\nWARC-Record-ID: <"), name,
        F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), F.when(uri == "", name).otherwise(uri),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), *refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + (0 if again else F.col("n"))).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, http, *([] if again else [payload]), F.lit("\r\n")).alias("value")


def records(pages: DataFrame, least: int = LEAST, most: int = TABLE_KEYS) -> DataFrame:
    """One row `value` per page: the record without its last line end."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("n", F.octet_length("payload"))
    p = p.withColumn("key", F.concat_ws(":", "digest", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    narrow = stored(p.drop("payload"), "warc-digests")
    first = narrow.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1 and first is not null").drop("c")
    again = stored(narrow.join(first, "digest").filter("not page_id <=> first"), "warc-revisits", few=True)
    whole = without(p, "key", again, narrow, most)
    return again.select(_record(True, None)).union(whole.select(_record(False, F.col("payload"))))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, per_file: int = RECORDS_PER_FILE) -> None:
    with Scratch(pages.sparkSession):
        records(pages, least).write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).text(folder)


def inflate(source: BinaryIO, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, piece by piece."""
    z, held = None, b""
    while chunk := held or source.read(piece):
        z = z or zlib.decompressobj(31)
        out = z.decompress(chunk, piece)
        if out:
            yield out
        held = z.unconsumed_tail
        if z.eof:
            z, held = None, z.unused_data
    if z is not None:
        while out := z.decompress(z.unconsumed_tail, piece):
            yield out
        if not z.eof:
            raise ValueError("a gzip stream ends early")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, headers to the two line ends after the block. Holds one record and a piece."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(_HEAD_END, at)) >= 0:
            size = re.search(rb"\r\nContent-Length: *(\d+)", held[at : end + 2])
            if not size:
                raise ValueError("a record has no Content-Length")
            stop = end + 4 + int(size[1]) + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError("an archive ends within a record")


INDEX = "file string, position bigint, length bigint, record_id string"
SIDECAR = ".offsets"
_ROWS = 2000


def normalise(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """archives has path (Spark's binaryFile). Writes each again to `folder`, its sidecar beside it, and returns the index rows."""

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(name: str, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["file", "position", "length", "record_id"])

        for part in parts:
            for path in part.column("path").to_pylist():
                name = hashlib.sha1(path.encode()).hexdigest()[:12] + "-" + path.rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
                at, rows = 0, []
                with opened(path) as source, written(f"{folder}/{name}{SIDECAR}") as index, written(f"{folder}/{name}") as out:
                    for record in split_records(inflate(source)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        rows.append((at, len(member), re.search(rb"\r\nWARC-Record-ID: *<([^>]*)>", record)[1].decode()))
                        index.write("{} {} {}\n".format(*rows[-1]).encode())
                        out.write(member)
                        at += len(member)
                        if len(rows) == _ROWS:
                            yield batch(name, rows)
                            rows = []
                yield batch(name, rows)

    return archives.select("path").mapInArrow(rewrite, INDEX)


PARSED = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"


def parse(record: bytes) -> tuple:
    """page_id, url, payload bytes, payload digest (of the stored payload; a revisit's as its header has it), type, page it refers to, html."""
    head, _, block = record.partition(_HEAD_END)
    fields = dict(re.findall(r"\r\n([^:\r\n]+): *([^\r\n]*)", head.decode()))
    page = lambda x: None if x is None or x.endswith(":null>") else int(x[10:-1])
    http, _, rest = block.partition(_HEAD_END)
    kind = fields["WARC-Type"]
    payload = rest[:-4] if kind == "response" else None
    digest = hashlib.sha1(payload).hexdigest() if payload is not None else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = len(payload) if payload is not None else int(re.search(rb"\r\nContent-Length: *(\d+)", http)[1])
    if payload is not None and fields["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, page(fields.get("WARC-Refers-To")), None if payload is None else payload.decode()


def read_archives(files: DataFrame, html: bool = True) -> DataFrame:
    """The records of archives (path), each inflated from its own member, whose place the archive's sidecar has."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        for part in parts:
            for path in part.column("path").to_pylist():
                at, rows, held = 0, [], 0
                with opened(path) as source, opened(path + SIDECAR) as index:
                    for line in index:
                        position, length, _ = line.split(b" ", 2)
                        if int(position) != at:
                            raise ValueError(f"the index of {path} has a gap at {at}")
                        member = source.read(int(length))
                        at += len(member)
                        row = parse(zlib.decompress(member, 31))
                        rows.append(row if html else (*row[:-1], None))
                        held += row[2] if html else 0
                        if len(rows) == _ROWS or held > 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return files.select("path").mapInArrow(read, PARSED)


def read_record(archive: str, position: int, length: int) -> tuple:
    """One record by its place in the index, without the rest of the archive."""
    with opened(archive) as source:
        source.seek(position)
        return parse(zlib.decompress(source.read(length), 31))


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST, html: bool = True) -> DataFrame:
    """Writes pages to `folder` (a new one in the shared folder by default): whole-stream archives in raw/, one member a record and the
    sidecars in members/, the index as a table in index/; then reads all records back along the sidecars. Without a given folder raw/ goes
    when it has been normalised."""
    spark = pages.sparkSession
    own = folder is None
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, f"{folder}/raw", least)
    paths = lambda d: spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{folder}/{d}").select("path")
    normalise(paths("raw"), f"{folder}/members").write.parquet(f"{folder}/index")
    if own:
        remove(spark, f"{folder}/raw")
    if spark.read.schema(INDEX).parquet(f"{folder}/index").isEmpty():
        return spark.createDataFrame([], PARSED)
    return read_archives(paths("members"), html)
