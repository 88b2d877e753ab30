"""Binary files in the shared folder, written by tasks and listed in a table of what was committed.

A task writes under a name of its own and reports it; only files in the table that Spark committed are read. A task that
runs again, after a lost executor or as a copy of a slow one, leaves a file that nothing lists.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task closes a file and begins the next one when it has grown beyond this, so that one task can read a file whole.
FILE_BYTES = 32 << 20


class Files:
    """Writes files below ``folder``, a URI or path that all executors share."""

    def __init__(self, folder: str, suffix: str):
        from pyarrow import fs

        self.suffix = suffix
        self.system, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        self.system.create_dir(self.folder, recursive=True)

    def write(self, content: bytes) -> str:
        """The name of a new file with this content."""
        name = f"{uuid.uuid4().hex}{self.suffix}"
        with self.system.open_output_stream(f"{self.folder}/{name}", compression=None) as out:
            out.write(content)
        return name


def read_files(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """``listed`` (column ``file`` and others) with ``content``: the bytes of each listed file, one row per file."""
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return listed.join(there, "file")
