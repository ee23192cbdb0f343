"""Files to encode, and tables of metrics as CSV."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.sources.ranges import FILES, file_listing, file_system, system_files

_COMMON = "dataset STRING, file_name STRING, file_size_bytes BIGINT, runs INT"
#: Columns of the two kinds of metric tables, in file order (fixed values). Hashes are text: digits alone, or 1e5, would
#: be taken for numbers.
SEQUENTIAL = f"""{_COMMON}, total_ms DOUBLE, lsbm_ms DOUBLE, huffman_ms DOUBLE, encode_ms DOUBLE, std_total_ms DOUBLE, std_lsbm_ms DOUBLE,
std_huffman_ms DOUBLE, std_encode_ms DOUBLE, peak_ram_mb DOUBLE, cpu_percent DOUBLE, encoding_rate_bits_per_nt DOUBLE, gross_rate_bits_per_nt DOUBLE,
gc_mean DOUBLE, gc_var DOUBLE, rll_max INT, rll_violations INT, seq_count INT, storage_seq_count INT, end_violations INT, avg_best_lsbm_len DOUBLE,
segments INT, dna_hash_payload STRING, dna_hash_storage STRING"""
PARALLEL = f"""{_COMMON}, total_ms DOUBLE, std_total_ms DOUBLE, phase_sum_ms DOUBLE, h2d_ms DOUBLE, bits_kernel_ms DOUBLE, lsbm_kernel_ms DOUBLE,
std_lsbm_ms DOUBLE, huffman_cpu_ms DOUBLE, encode_kernel_ms DOUBLE, std_encode_ms DOUBLE, constraint_kernel_ms DOUBLE, assembly_ms DOUBLE, d2h_ms DOUBLE,
encoding_rate_bits_per_nt DOUBLE, gross_rate_bits_per_nt DOUBLE, gc_mean DOUBLE, gc_var DOUBLE, rll_max INT, rll_violations INT, end_violations INT,
seq_count INT, storage_seq_count INT, avg_best_lsbm_len DOUBLE, segments INT, dna_hash_payload STRING, dna_hash_storage STRING"""


def basename(path):
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def file_list(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    """(path, dataset, file_name, file_size_bytes) of a folder's files, empty ones too; none is read."""
    name = basename(F.col("path"))
    return file_listing(spark, path, glob).select("path", F.replace(name, F.lit("-"), F.lit("_")).alias("dataset"), name.alias("file_name"), "file_size_bytes")


def payload_files(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    """(path, dataset, file_name, file_size_bytes, payload) of a folder's files; the tag is the name with _ for -.
    Empty files, which no encoding takes, are left out by Spark's reader."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = basename(F.col("path"))
    return found.select("path", F.replace(name, F.lit("-"), F.lit("_")).alias("dataset"), name.alias("file_name"), F.col("length").alias("file_size_bytes"), F.col("content").alias("payload"))


def write_files(contents: DataFrame, path: str) -> None:
    """A file for each row of contents (name, content): path/<task>/<name>, whose names must differ within a task. Each task writes its own, so
    that no commit goes through them one by one; a task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, own = file_system(f"{path}/{TaskContext.get().partitionId():06d}")
        system.create_dir(own, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with system.open_output_stream(f"{own}/{name}") as f:
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    contents.select("name", "content").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def payload_files_below(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    """payload_files() of the folders in a folder. Tasks list them, a folder each, and read the files, which are dealt out anew: neither
    the driver nor one task knows them all."""
    from pyarrow import fs

    system, own = file_system(path)
    folders = [x.path for x in system.get_file_info(fs.FileSelector(own)) if x.type == fs.FileType.Directory]
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not folders:
        return payload_files(spark, path, glob)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = [x for x in system_files(path, folder, glob) if x[1]]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.int64()))], ["path", "file_size_bytes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(path)
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("file_size_bytes").to_pylist(), strict=True):
                with system.open_input_stream(name) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([f.read()], pa.binary())], ["path", "file_size_bytes", "payload"])

    names = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(min(len(folders), tasks))
    found = names.mapInArrow(listing, "path string, file_size_bytes long").repartition(tasks).mapInArrow(read, "path string, file_size_bytes long, payload binary")
    name = basename(F.col("path"))
    return found.select("path", F.replace(name, F.lit("-"), F.lit("_")).alias("dataset"), name.alias("file_name"), "file_size_bytes", "payload")


def rejected_files(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    """(path, reason) of a folder's files that payload_files() leaves out: those without a byte."""
    return file_list(spark, path, glob).where("file_size_bytes = 0").select("path", F.lit("empty").alias("reason"))


def read_metrics(spark: SparkSession, path: str, schema: str | T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The CSV files of a folder, a glob or a path, as one table of the schema's columns, whatever the order of their own.

    Each file's columns go by the names in its header. A column that a file lacks is that of `defaults` there, which may name other
    columns, or null; columns that the schema lacks are left out. Values that don't parse are null. Files without a line
    have no rows. Files that share a header are read together: there are as many scans as headers.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = {f.name: f.dataType for f in wanted}
    out = None
    for header, paths in headers(spark, path):
        names = next(csv.reader([header]))
        own = T.StructType([T.StructField(c if names.index(c) == k else f"_{k}_{c}", kinds.get(c, T.StringType())) for k, c in enumerate(names)])
        rows = spark.read.schema(own).option("header", True).option("escape", '"').csv(paths)
        rows = rows.select(*[c for c in dict.fromkeys(names) if c in kinds])
        given = {c: v.cast(kinds[c]) for c, v in (defaults or {}).items() if c in kinds and c not in rows.columns}
        rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns and c not in given}).withColumns(given).select(*kinds)
        out = rows if out is None else out.union(rows)
    return spark.createDataFrame([], wanted) if out is None else out


def headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """The first lines of CSV files, and the paths of the files that begin with each; the list of files is as long as the one
    that Spark's own reader holds."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"), F.rtrim("value").alias("value"))
    first = lines.groupBy("path").agg(F.min_by("value", "n").alias("header")).where("length(header) > 0")
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    return [(r["header"], r["paths"]) for r in found]


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Appends to a folder of CSV files, each with its header."""
    metrics.write.mode("append").option("header", True).option("escape", '"').csv(path)


def latest(metrics: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's row with the largest `order`, by its columns in turn; of rows alike in those, the one of the largest other columns."""
    rest = [c for c in metrics.columns if c not in order]
    return metrics.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*[F.col("r").getField(c).alias(c) for c in metrics.columns])
