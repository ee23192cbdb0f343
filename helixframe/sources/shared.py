"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only where that is unset (tests, one machine), a local one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_helix_checkpoints", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        root = spark._helix_checkpoints = tempfile.mkdtemp(prefix="helixframe-")
    return f"{root}/cut-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession) -> str:
    """An empty folder in the shared folder, for files of other kinds than cut()'s; it goes when the session ends."""
    path = shared_folder(spark)
    system, folder = _hadoop(spark, path)
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return path


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path and the path: Spark's readers and writers know no deleting."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing. What
    forget() hasn't deleted goes when the session ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    system, folder = _hadoop(spark, path)
    system.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._helix_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote. To be called when all that was made from them is written itself."""
    for t in tables:
        path = t.__dict__.pop("_helix_path", None)
        if path:
            system, folder = _hadoop(t.sparkSession, path)
            system.delete(folder, True)
