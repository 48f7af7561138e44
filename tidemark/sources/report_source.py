"""HTML reports as a Spark data source: files are shredded into table rows where they are read.

`spark.read.format("html_reports").load(folder)` and `spark.readStream.format("html_reports").load(folder)` give the
table rows of tidemark.sources.html with the path of the file. No page travels as a row: a task reads the files of
its partition one by one, piece by piece, and gives Arrow batches of table rows. Partitions are filled by bytes, largest files first, so that
a very long report gets one of its own. Files are opened by pyarrow, so a folder may be on any file system
it knows; executors must see it under the same name as the driver.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.html import ARROW_KINDS, BATCH_ROWS, ROW_SCHEMA, Shredder, cells_of, row_batches

NAME = "html_reports"
#: Bytes of files for a partition (one or more MB a second), least number of seconds that a file of a stream must be old, bytes that are read at once.
PARTITION_BYTES, SETTLED_S, PIECE = 4 << 20, 0.0, 1 << 20
FILE_SCHEMA = "file_path string, file_size long, " + ROW_SCHEMA.split(", ", 1)[1]
NAMES = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
KINDS = [pa.string(), pa.int64(), *ARROW_KINDS[1:]]


@dataclass
class Files(InputPartition):
    """(path, size) of the files of a partition."""

    files: list[tuple[str, int]]

    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(0)
        self.files = files


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def list_files(folder: str, suffixes: tuple[str, ...]) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, size) of the files below a folder that end in one of suffixes, oldest first; hidden names are left out."""
    system, root = opened(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = lambda p: not any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(suffixes) and shown(f.path))


def by_bytes(files: list[tuple[str, int]], partition_bytes: int) -> list[Files]:
    """Partitions of about equal bytes, none much over partition_bytes but for a file that is larger itself."""
    n = min(len(files), -(-sum(size for _, size in files) // partition_bytes) or 1)
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        filled, i = heapq.heappop(heap)
        out[i].append((path, size))
        heapq.heappush(heap, (filled + size, i))
    return [Files(x) for x in out]


def read_files(folder: str, files: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """Table rows of files in order; bytes that are no UTF-8 become replacement characters. Files without tables give no rows."""
    system, _ = opened(folder)
    for path, size in files:
        page, decoder = Shredder(), codecs.getincrementaldecoder("utf-8")("replace")
        with system.open_input_stream(path) as f:
            while piece := f.read(PIECE):
                page.feed(decoder.decode(piece))
                if len(page.rows) >= BATCH_ROWS:
                    yield from row_batches(page.take(), KINDS, NAMES, path, size)
        page.feed(decoder.decode(b"", True))
        page.close()
        yield from row_batches(page.take(), KINDS, NAMES, path, size)


class _Settings:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".html,.htm").lower().split(","))
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.settled_ns = int(float(options.get("settledSeconds", SETTLED_S)) * 1e9)


class ReportReader(_Settings, DataSourceReader):
    def partitions(self) -> list[Files]:
        return by_bytes([(p, n) for _, p, n in list_files(self.folder, self.suffixes)], self.partition_bytes)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        # Spark reads a source without partitions by one call without a partition
        return read_files(self.folder, partition.files if partition else [])


class ReportStreamReader(_Settings, DataSourceStreamReader):
    """New files in the order of (time of change, path); an offset is the last file taken.

    A batch that is run again lists the same range. Files must not change, and a file must not appear with an older
    time than one already taken; settledSeconds keeps the newest files back until their writers are done.
    """

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        import time

        old = [f for f in list_files(self.folder, self.suffixes) if f[0] <= time.time_ns() - self.settled_ns]
        return {"time": old[-1][0], "path": old[-1][1]} if old else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = ((x["time"], x["path"]) for x in (start, end))
        return by_bytes([(p, n) for t, p, n in list_files(self.folder, self.suffixes) if lo < (t, p) <= hi], self.partition_bytes)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        # Spark reads a source without partitions by one call without a partition
        return read_files(self.folder, partition.files if partition else [])

    def commit(self, end: dict) -> None:
        pass


class HtmlReports(DataSource):
    """Options: suffixes (".html,.htm"), partitionBytes, and for streams settledSeconds."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema: object) -> ReportReader:
        return ReportReader(self.options)

    def streamReader(self, schema: object) -> ReportStreamReader:
        return ReportStreamReader(self.options)


def read_rows(spark: SparkSession, folder: str, stream: bool = False, **options: object) -> DataFrame:
    """file_path, file_size and the rows of all tables of the HTML files below a folder, or a stream of them."""
    spark.dataSource.register(HtmlReports)
    return (spark.readStream if stream else spark.read).format(NAME).options(**options).load(folder)


def read_cells(spark: SparkSession, folder: str, stream: bool = False, **options: object) -> DataFrame:
    """file_path, file_size and the cells of all tables of the HTML files below a folder, or a stream of them."""
    return cells_of(read_rows(spark, folder, stream, **options))
