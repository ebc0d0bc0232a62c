"""Lines of byte ranges of one file, as a Python data source: a resumed run begins where its rows do.

A range holds the lines that start after its first byte (at it, for the first range of a file) up to its end, the last one
whole: the way in which Spark's own text reader cuts files, so that a place found by one is one for the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of one reading of it.
RANGE = 64 << 20
READ = 4 << 20
SCHEMA = "_file string, _start long, _place long, value string"


class Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def lines(stream, first: int, last: int, read: int = READ) -> Iterator[list[bytes]]:
    """Lots of the lines of a range, without their line feeds."""
    stream.seek(first)
    rest, at, skip = b"", first, first > 0  # `at`: where `rest` begins
    while at <= last:
        data = stream.read(read)
        if not data:
            if rest and not skip:
                yield [rest]
            return
        rest += data
        *whole, tail = rest.split(b"\n")
        found = []
        for line in whole:
            if not skip and at <= last:
                found.append(line)
            skip = False
            at += len(line) + 1
        rest = tail
        if found:
            yield found


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.name, self.first, self.size, self.step = options["path"], int(options["first"]), int(options["size"]), int(options["range"])

    def partitions(self) -> list[InputPartition]:
        return [Range(a, min(a + self.step, self.size)) for a in range(self.first, self.size, self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, path = opened(self.name)
        place = 0
        with where.open_input_file(path) as stream:
            for lot in lines(stream, partition.first, partition.last):
                n = len(lot)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([self.name] * n), pa.array([partition.first] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array(lot, pa.binary()).cast(pa.string(), safe=False)],
                    ["_file", "_start", "_place", "value"],
                )
                place += n


class Ranges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkmill_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return Reader(self.options)


def opened(name: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a local path or an address."""
    return (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)


def reachable(name: str) -> bool:
    """Whether this process, and so a task, can open the file without Spark's file systems."""
    try:
        where, path = opened(name)
        return where.get_file_info(path).type == fs.FileType.File
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False


def read(spark: SparkSession, name: str, first: int, size: int, step: int = RANGE) -> DataFrame:
    spark.dataSource.register(Ranges)
    return spark.read.format("sparkmill_ranges").options(path=name, first=str(first), size=str(size), range=str(step)).load()
