"""Files that tasks write into the shared folder and that later tasks read.

A task writes under a name of its own attempt and returns a manifest row; Spark commits the
manifest rows of successful attempts only, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.shared import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the folder that the cluster shares."""
    folder = scratch_path(spark, name)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


class OutputFile:
    """One file written front to back; it gets its name when it is complete."""

    def __init__(self, folder: str, suffix: str):
        self.fs, path = _split(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.path = f"{path}/{self.name}"
        self.stream = self.fs.open_output_stream(self.path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def open_input(folder: str, name: str):
    """A seekable reader."""
    files, path = _split(folder)
    return files.open_input_file(f"{path}/{name}")


def open_stream(folder: str, name: str):
    files, path = _split(folder)
    return files.open_input_stream(f"{path}/{name}", compression=None)


def tasks_for(manifest: DataFrame) -> int:
    """Tasks that read the files of a manifest: twice as many as files, so that few meet in one."""
    return max(1, 2 * manifest.count())
