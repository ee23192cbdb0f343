"""Metric rows appended to a folder of CSV files, all of a batch or none."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from helixframe.sources.ranges import file_system


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its file, under a name that readers don't see, and the name it is to have."""

    own: str
    name: str


class MetricsCsv(DataSource):
    """Appends to the folder `path`; batch: a name for what is appended (none: a new one). A batch that is written again takes
    the place of itself."""

    @classmethod
    def name(cls) -> str:
        return "helix_metrics_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MetricsWriter(self.options["path"], self.options.get("batch") or uuid.uuid4().hex, schema.names)


class MetricsWriter(DataSourceWriter):
    """Each task writes a file with a header and its rows under a hidden name; commit() gives all files their names, and
    abort() deletes them, and what tasks that failed have left."""

    def __init__(self, folder: str, batch: str, columns: list[str]):
        self.folder, self.batch, self.columns = folder, batch, columns

    def write(self, rows: Iterator) -> Part | None:
        system, folder = file_system(self.folder)
        out, text = None, io.StringIO()
        lines = csv.writer(text, lineterminator="\n")
        for row in rows:
            if out is None:
                name = f"{self.batch}-{TaskContext.get().partitionId():05d}.csv"
                part = Part(f"{folder}/.{name}.{uuid.uuid4().hex}", f"{folder}/{name}")
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(part.own)
                lines.writerow(self.columns)
            lines.writerow([str(x).lower() if isinstance(x, bool) else x for x in row])
            out.write(text.getvalue().encode())
            text.seek(0)
            text.truncate()
        if out is None:
            return Part("", "")
        out.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        system, _ = file_system(self.folder)
        parts = [m for m in messages if m and m.own]
        for p in parts:
            system.move(p.own, p.name)
        self.clear({p.name for p in parts}, f"{self.batch}-")

    def abort(self, messages: list[Part | None]) -> None:
        self.clear(set(), "")

    def clear(self, keep: set[str], prefix: str) -> None:
        """Deletes this batch's hidden files, and of its visible ones those with the prefix that aren't to be kept."""
        from pyarrow import fs

        system, folder = file_system(self.folder)
        if system.get_file_info(folder).type != fs.FileType.Directory:
            return
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith(f".{self.batch}-") or prefix and f.base_name.startswith(prefix) and f.path not in keep:
                system.delete_file(f.path)


def append_rows(metrics: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends metrics to a folder of CSV files that read_metrics() reads: all rows or none."""
    metrics.sparkSession.dataSource.register(MetricsCsv)
    writer = metrics.write.format(MetricsCsv.name()).mode("append").option("path", path)
    (writer.option("batch", batch) if batch else writer).save()
