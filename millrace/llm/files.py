"""Files that executors write and read, in any store pyarrow knows by URI."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark import TaskContext


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (``file:``, ``hdfs:``, ``s3:``, ``gs:``)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def attempt_name(stem: str, suffix: str) -> str:
    """A name that no other attempt of this task takes: a retried or speculative
    task writes a file of its own, and only files named by the tasks that Spark
    committed are ever read."""
    ctx = TaskContext.get()
    return f"{stem}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}{suffix}"


def make_dir(uri: str) -> None:
    fs, path = resolve(uri)
    fs.create_dir(path, recursive=True)


def drop_strays(uri: str, keep: set[str]) -> None:
    """Deletes what failed attempts left in a folder."""
    fs, path = resolve(uri)
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.type == pafs.FileType.File and info.base_name not in keep:
            fs.delete_file(info.path)
