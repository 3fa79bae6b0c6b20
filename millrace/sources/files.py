"""Files that tasks write and read by themselves, in any store that a URI names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession

PIECE = 8 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store, the session's own where it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def attempt() -> str:
    """A name that no other attempt of this task takes."""
    ctx = TaskContext.get()
    return f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}"


def pieces(uri: str) -> Iterator[bytes]:
    """A file's bytes, some at a time."""
    store, path = store_of(uri)
    with store.open_input_stream(path) as f:
        while part := f.read(PIECE):
            yield part


def sha256_of(uri: str) -> tuple[int, str]:
    """Bytes and digest of a file of any size."""
    digest, size = hashlib.sha256(), 0
    for part in pieces(uri):
        digest.update(part)
        size += len(part)
    return size, digest.hexdigest()


def move_once(source: str, target: str) -> None:
    """Renames a file; where an earlier attempt has done so, nothing is left to do."""
    store, a = store_of(source)
    b = store_of(target)[1]
    if store.get_file_info(a).type == pafs.FileType.NotFound and store.get_file_info(b).type == pafs.FileType.File:
        return
    if isinstance(store, pafs.LocalFileSystem):  # a checksum that another writer left beside an older file
        folder, name = b.rsplit("/", 1)
        if store.get_file_info(f"{folder}/.{name}.crc").type == pafs.FileType.File:
            store.delete_file(f"{folder}/.{name}.crc")
    store.move(a, b)
