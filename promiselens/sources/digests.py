"""Digests of files of any size: a Python data source that reads each file as a stream.

A digest is a chain over a file's bytes, so a file is one task, in the memory of one block. The list of files is the plan: large files
are partitions of their own, small ones share one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 4 << 20
PARTITION_BYTES = 128 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class DigestReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        groups: list[list[str]] = []
        held = PARTITION_BYTES
        for path, size in sorted(self.files, key=lambda f: -f[1]):
            if held + size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(g) for g in groups]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        from pyarrow import fs

        for path in partition.value if partition else ():
            system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(place) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
                    size += len(block)
            yield path, size, digest.hexdigest()


class DigestSource(DataSource):
    """``spark.read.format("file_digests")``; option ``files``: JSON list of (path, bytes)."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return DigestReader([tuple(f) for f in json.loads(self.options["files"])])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files that ``path`` names; as in all of Spark's listings, a file without a byte is not there.

    Only names and sizes pass through the driver.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    spark.dataSource.register(DigestSource)
    return spark.read.format("file_digests").option("files", json.dumps([tuple(r) for r in listed])).load()
