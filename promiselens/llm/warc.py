"""WARC archives: written by Spark, read through a Python data source.

Writing is a DataFrame job: each page is one record (headers, blank line, payload) and Spark's text writer puts the
records into files, with the two line ends that close a record as separator. Of records with equal payloads the one
with the largest id is a response; the others are revisits that name it and carry no payload.

Reading plans one partition per file, takes equality and IN predicates on ``record_type`` and on headers as pushed
filters, parses a record's headers first and steps over payloads that no pushed filter or column asks for.

Defined cases: a null payload is empty; a null id or url is an empty header and reads as null; a null url does not
matter to revisits; repeated rows (same id, same payload) are responses both; an empty table gives no records; a record
cut off by the end of the file ends the file. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from promiselens.llm.common import counted, null_safe
from promiselens.session import shared_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"
VERSION = b"WARC/1.1"
SCHEMA = (
    "record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)
HEADER_OF = {"record_type": b"warc-type", "payload_digest": b"warc-payload-digest", "target_uri": b"warc-target-uri"}
BATCH_BYTES = 4 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: every five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    digits = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*digits)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages that revisit another one. Only ids and digests are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digests = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    digests = digests.filter((F.col("n") >= least_bytes) & F.col("page_id").isNotNull())
    largest = digests.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"))
    repeated = largest.filter("low < refers_to").select("digest", "n", "refers_to")
    return digests.join(repeated, ["digest", "n"]).filter("page_id < refers_to").select("page_id", "refers_to").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0, records_per_file: int = 50_000) -> None:
    """Write ``pages`` as WARC files into the new folder ``folder``."""
    # One row for each revisited page: broadcast if few, joined by page id otherwise.
    revisits = counted(plan_records(pages, least_bytes))
    payload = F.coalesce(F.col("html"), F.lit(""))
    records = null_safe(pages.select("page_id", "url", payload.alias("payload")), revisits, ["page_id"], "left")
    is_revisit = F.col("refers_to").isNotNull()
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    size = F.octet_length("payload").cast("string")
    lines = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        header("WARC-Target-URI", clean_url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        header("WARC-Payload-Length", size),
        F.when(
            is_revisit,
            F.concat(
                header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                F.lit("Content-Length: 0\r\n"),
            ),
        ).otherwise(header("Content-Length", size)),
        F.lit("\r\n"),
        F.when(is_revisit, F.lit("")).otherwise(F.col("payload")),
    )
    writer = records.select(lines.alias("value")).write.option("lineSep", RECORD_END)
    writer.option("maxRecordsPerFile", records_per_file).text(folder)


def _system(folder: str):
    """(file system, path) of a folder, on any file system that Arrow knows."""
    from pyarrow import fs

    uri = folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///") if re.match("file:/[^/]", uri) else uri)


class WarcFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _page(urn: bytes) -> int | None:
    number = urn.rpartition(b":")[2].rstrip(b">")
    return int(number) if number else None


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names = folder, schema.names
        self.wanted: list[tuple[bytes, set[bytes]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            name = HEADER_OF.get(f.attribute[0]) if values and len(f.attribute) == 1 else None
            if name is None or not all(isinstance(v, str) for v in values):
                yield f
                continue
            prefix = "sha1:" if name == b"warc-payload-digest" else ""
            self.wanted.append((name, {f"{prefix}{v}".encode() for v in values}))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _system(self.folder)
        found = [i for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.size]
        return [WarcFile(i.path) for i in found if not i.base_name.startswith(("_", "."))]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark reads a source that planned no partition
            return
        system, _ = _system(self.folder)
        rows: list[tuple] = []
        held = 0
        with system.open_input_file(partition.value) as raw:
            for row, size in self._records(raw):
                rows.append(row)
                held += size
                if held > BATCH_BYTES or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, self.names)

    def _records(self, raw) -> Iterator[tuple[tuple, int]]:
        """Windows of the file are searched for header ends; an unwanted payload is stepped over by its length."""
        at, total, window, base = 0, raw.size(), b"", 0

        def upto(start: int, end: int) -> bytes:
            """Bytes [start, end) of the file through a window that only moves forward."""
            nonlocal window, base
            if start < base or end > base + len(window):
                raw.seek(start)
                window, base = raw.read(max(end - start, 1 << 16)), start
            return window[start - base : end - base]

        while at < total:
            ahead, head_end = 1 << 11, -1
            while head_end < 0:
                head = upto(at, min(at + ahead, total))
                head_end = head.find(b"\r\n\r\n")
                if head_end < 0 and at + ahead >= total:
                    return
                ahead *= 4
            lines = head[:head_end].split(b"\r\n")
            if lines[0] != VERSION:
                raise ValueError(f"no record starts at byte {at}")
            headers = {k.lower(): v.removeprefix(b" ") for k, _, v in (line.partition(b":") for line in lines[1:])}
            length = int(headers[b"content-length"])
            begin = at + head_end + 4
            at = begin + length + len(RECORD_END)
            if begin + length > total:
                return
            if any(headers.get(name) not in values for name, values in self.wanted):
                continue
            yield self._row(headers, begin, length, upto), length + 200

    def _row(self, headers: dict, begin: int, length: int, upto) -> tuple:
        kind = headers[b"warc-type"].decode()
        stated = headers[b"warc-payload-digest"].rpartition(b":")[2].decode()
        size, payload = int(headers[b"warc-payload-length"]), None
        if kind == "response":
            payload = upto(begin, begin + length)
            size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != stated:
                raise ValueError(f"payload of {headers[b'warc-record-id']!r} does not have its digest")
        refers = headers.get(b"warc-refers-to")
        uri = headers[b"warc-target-uri"].decode() or None
        return (kind, _page(headers[b"warc-record-id"]), uri, size, stated, _page(refers) if refers else None, payload)


class WarcHeaders(WarcReader):
    """The reader without payloads: they are checked against their digests, or skipped, but never handed to Spark."""

    def __init__(self, folder: str, schema: StructType, verify: bool):
        super().__init__(folder, schema)
        self.verify = verify

    def _row(self, headers: dict, begin: int, length: int, upto) -> tuple:
        told = headers if self.verify else headers | {b"warc-type": b"skipped"}
        row = super()._row(told, begin, length, upto)
        return (headers[b"warc-type"].decode(), *row[1:6], None)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; option ``payload``: ``read`` (default), ``verify`` (digest only) or ``skip``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        mode = self.options.get("payload", "read")
        if mode == "read":
            return WarcReader(self.options["path"], schema)
        return WarcHeaders(self.options["path"], schema, mode == "verify")


def read(spark: SparkSession, folder: str, payload: str = "read") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(folder)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/promiselens/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages``, read the archives back, and return what each record says; payload digests are verified."""
    folder = new_folder(pages.sparkSession)
    write(pages, folder, least_bytes)
    found = read(pages.sparkSession, folder, "verify")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
