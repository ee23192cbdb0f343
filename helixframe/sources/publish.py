"""Several named frames published together: readers see all of them as of one moment, or what was there before."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.sources.ranges import file_system


def manifests(folder: str) -> list[str]:
    """Names of a folder's manifests, the oldest first."""
    from pyarrow import fs

    system, path = file_system(folder)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return []
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("manifest-"))


def publish(frames: dict[str, DataFrame], folder: str) -> str:
    """Writes each frame as Parquet to a new place below the folder, then one manifest that names them; gives that manifest's
    name. Until it is there readers see the last one; if a frame fails, nothing of this is ever seen."""
    if not frames:
        raise ValueError("no frame to publish")
    version = uuid.uuid4().hex
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/data-{version}/{name}")
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    have = manifests(folder)
    number = int(have[-1].split("-")[1]) + 1 if have else 1
    name = f"manifest-{number:08d}-{version}.json"
    own = f"{path}/.{name}"
    with system.open_output_stream(own) as f:
        f.write(json.dumps({"version": version, "frames": {k: d.schema.json() for k, d in frames.items()}}).encode())
    system.move(own, f"{path}/{name}")
    return name


def published(spark: SparkSession, folder: str, manifest: str | None = None) -> dict[str, DataFrame]:
    """The frames of the last manifest, or of one by its name; none if nothing was published."""
    from pyspark.sql.types import StructType

    have = manifests(folder)
    if not have:
        return {}
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{manifest or have[-1]}") as f:
        about = json.loads(f.read())
    return {k: spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(f"{folder}/data-{about['version']}/{k}") for k, kind in about["frames"].items()}


def retire(folder: str, keep: int = 1) -> None:
    """Deletes what all manifests but the last `keep` name, and frames that no manifest names."""
    from pyarrow import fs

    system, path = file_system(folder)
    have = manifests(folder)
    last = have[len(have) - keep :] if keep else []
    for name in have:
        if name not in last:
            system.delete_file(f"{path}/{name}")
    versions = {name.split("-")[2].removesuffix(".json") for name in last}
    for f in system.get_file_info(fs.FileSelector(path)):
        if f.base_name.startswith("data-") and f.base_name.removeprefix("data-") not in versions:
            system.delete_dir(f.path)
