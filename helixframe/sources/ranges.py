"""Files as byte ranges: a Python data source each of whose partitions is a part of one file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of files that are taken unless others are asked for, and what names a file.
FILES = "*.{txt,pdf,jpg}"
FILE_KEYS = ("path", "dataset", "file_name", "file_size_bytes")
#: Chunks of a file that one partition reads.
RANGE_CHUNKS = 256


def file_system(folder: str):
    """The file system and the path of a folder given by a URI or a path."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))


def patterns(glob: str) -> list[str]:
    """A glob with one pair of braces as globs without."""
    head, brace, rest = glob.partition("{")
    if not brace:
        return [glob]
    inside, _, tail = rest.partition("}")
    return [head + x + tail for x in inside.split(",")]


def listed(path: str, glob: str, recursive: bool = False) -> list[tuple[str, int]]:
    """Files of a folder, and of those below it if asked (or the one file that path names), that fit the glob, by name: path and size."""
    from pyarrow import fs

    system, own = file_system(path)
    found = system.get_file_info(own)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.is_file else [x for x in system.get_file_info(fs.FileSelector(own, recursive=recursive)) if x.is_file and any(fnmatchcase(x.base_name, p) for p in patterns(glob))]
    return sorted((x.path, x.size) for x in files)


def system_files(path: str, folder: str, glob: str) -> list[tuple[str, int]]:
    """listed() of a folder that a file system's own path names; path: any URI of that file system."""
    from pyarrow import fs

    system, _ = file_system(path)
    return [(x.path, x.size) for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file and any(fnmatchcase(x.base_name, p) for p in patterns(glob))]


class Range(InputPartition):
    """Chunks first to last (exclusive) of a file, which is the number-th."""

    def __init__(self, number: int, path: str, size: int, first: int, last: int):
        self.number, self.path, self.size, self.first, self.last = number, path, size, first, last


class FileChunks(DataSource):
    """(_row, path, dataset, file_name, file_size_bytes, chunk, chunks, bytes) of a folder's files: `chunk_bytes` of a file in a row,
    `range_chunks` rows in a partition. Empty files have no row."""

    @classmethod
    def name(cls) -> str:
        return "helix_file_chunks"

    def schema(self) -> str:
        return "_row long, path string, dataset string, file_name string, file_size_bytes long, chunk int, chunks int, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return FileChunksReader(self.options)


class FileChunksReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.glob = options["path"], options.get("glob", FILES)
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.chunk, self.range = int(options["chunk_bytes"]), int(options.get("range_chunks", RANGE_CHUNKS))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for number, (path, size) in enumerate(listed(self.folder, self.glob, self.recursive)):
            chunks = -(-size // self.chunk)
            out += [Range(number, path, size, k, min(chunks, k + self.range)) for k in range(0, chunks, self.range)]
        return out or [Range(0, "", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        system, _ = file_system(self.folder)
        name = part.path.replace("\\", "/").rpartition("/")[2]
        chunks = -(-part.size // self.chunk)
        kinds = pa.schema([("_row", pa.int64()), ("path", pa.string()), ("dataset", pa.string()), ("file_name", pa.string()), ("file_size_bytes", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("bytes", pa.binary())])
        with system.open_input_file(part.path) as f:
            f.seek(part.first * self.chunk)
            for k in range(part.first, part.last):
                raw = f.read(self.chunk)
                if len(raw) != min(self.chunk, part.size - k * self.chunk):
                    raise OSError(f"{part.path} changed while it was read")
                row = [part.number, part.path, name.replace("-", "_"), name, part.size, k, chunks, raw]
                yield pa.RecordBatch.from_arrays([pa.array([x], c.type) for x, c in zip(row, kinds, strict=True)], schema=kinds)


class FileListing(DataSource):
    """(path, file_size_bytes) of a folder's files, empty ones too; a task lists them, and nothing is read."""

    @classmethod
    def name(cls) -> str:
        return "helix_file_listing"

    def schema(self) -> str:
        return "path string, file_size_bytes long"

    def reader(self, schema) -> DataSourceReader:
        return FileListingReader(self.options["path"], self.options.get("glob", FILES))


class FileListingReader(DataSourceReader):
    def __init__(self, folder: str, glob: str):
        self.folder, self.glob = folder, glob

    def read(self, partition) -> Iterator[tuple[str, int]]:
        yield from listed(self.folder, self.glob)


def file_listing(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    spark.dataSource.register(FileListing)
    return spark.read.format(FileListing.name()).option("path", path).option("glob", glob).load()


def file_chunks(spark: SparkSession, path: str, glob: str = FILES, chunk_bytes: int = 64_000, range_chunks: int = RANGE_CHUNKS, recursive: bool = False) -> DataFrame:
    """The rows of FileChunks for a folder or a file. The file system is found by the path's scheme (none: local)."""
    spark.dataSource.register(FileChunks)
    return spark.read.format(FileChunks.name()).option("path", path).option("glob", glob).option("chunk_bytes", chunk_bytes).option("range_chunks", range_chunks).option("recursive", recursive).load()
