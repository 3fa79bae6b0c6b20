"""Remote sets as a data source: files that a listing names, read over HTTP by tasks.

``spark.read.format("remote_set")`` takes these options:

* ``listing``: address of a JSON document whose ``parquet_files`` (or ``files``) is a list
  of ``{url, filename, size, split, config}``, the form in which public hubs list a set;
  ``{name}``, ``{subset}``, ``{split}`` and ``{revision}`` in it are filled in.  Relative
  addresses of files are below the listing's own.
* ``name``, ``subset``, ``split``, ``revision``: the set; files of other splits or
  configurations are left out.
* ``text_key``: the column that is read, and no other (``text``).
* ``part_bytes``: bytes that a task reads, about (128 MB); ``files_per_trigger``: files
  of a stream's batch (all there are).

Rows are (file, row, text): the file's name, the row's number in it, and the text; rows
with null or empty text are left out but counted.  A file is planned in parts by its size
alone; a task reads the file's footer by itself and takes its share of the row groups,
fetching only the column's bytes by range.  Files of JSON lines are one part each, read
line by line.

As a stream, the offset is the number of files read, in the order of the listing, with a
digest of their names: a listing may grow at its end, and one whose earlier files have
changed is an error.  With a checkpoint, a restarted stream reads each file once.

Defined cases: no file is an error for a batch and an empty batch for a stream; a fetch
is tried again ``TRIES`` times; a server without ranges sends whole files.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PART_BYTES, AHEAD, ROWS = 128 << 20, 1 << 20, 1024
TRIES, PAUSE, TIMEOUT = 5, 0.2, 60


def fetch(url: str, headers: dict[str, str] | None = None):
    """An open response; what may pass is tried again."""
    for turn in range(TRIES):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=TIMEOUT)
        except urllib.error.HTTPError as e:
            if (e.code < 500 and e.code != 429) or turn == TRIES - 1:
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if turn == TRIES - 1:
                raise
        time.sleep(PAUSE * 2**turn)
    raise AssertionError


class RangeFile(io.RawIOBase):
    """A remote file of known size, read by ranges, some bytes ahead."""

    def __init__(self, url: str, size: int):
        self.url, self.size, self.at = url, size, 0
        self.first, self.held = 0, b""
        self.fetched = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def _load(self, n: int) -> None:
        stop = min(self.size, self.at + max(n, AHEAD))
        with fetch(self.url, {"Range": f"bytes={self.at}-{stop - 1}"}) as r:
            body = r.read()
            self.first = self.at if r.status == 206 else 0
        self.fetched += len(body)
        if len(body) != (stop - self.at if self.first or r.status == 206 else self.size):
            raise OSError(f"{self.url} gave {len(body)} bytes")
        self.held = body

    def readinto(self, out) -> int:
        n = min(len(out), self.size - self.at)
        if n <= 0:
            return 0
        if not (self.first <= self.at and self.at + n <= self.first + len(self.held)):
            self._load(n)
        start = self.at - self.first
        out[:n] = self.held[start : start + n]
        self.at += n
        return n


@dataclass(frozen=True)
class RemoteFile:
    url: str
    name: str
    size: int


def listed_files(options: dict[str, str]) -> list[RemoteFile]:
    """The set's files, in the order of the listing."""
    wanted = {k: options.get(k) for k in ("name", "subset", "split", "revision")}
    url = options["listing"]
    for k, v in wanted.items():
        url = url.replace("{" + k + "}", urllib.parse.quote(v or {"revision": "main", "subset": "default", "split": "train"}.get(k, ""), safe="/"))
    with fetch(url) as r:
        found = json.load(r)
    files = []
    for f in found.get("parquet_files", found.get("files", [])):
        if (wanted["split"] and f.get("split", wanted["split"]) != wanted["split"]) or (wanted["subset"] and f.get("config", wanted["subset"]) != wanted["subset"]):
            continue
        files.append(RemoteFile(urllib.parse.urljoin(url, f["url"]), f.get("filename", f["url"].rsplit("/", 1)[-1]), int(f["size"])))
    return files


@dataclass
class Part(InputPartition):
    file: RemoteFile
    part: int
    parts: int


def planned(files: list[RemoteFile], part_bytes: int) -> list[Part]:
    """Parts by the files' sizes."""
    out = []
    for f in files:
        parts = max(1, -(-f.size // part_bytes)) if f.name.endswith(".parquet") else 1
        out += [Part(f, k, parts) for k in range(parts)]
    return out


def read_part(part: Part, text_key: str) -> Iterator:
    """Record batches of (file, row, text)."""
    import pyarrow as pa

    def batch(first, texts):
        some = [(i, t) for i, t in enumerate(texts, first) if t]
        return pa.RecordBatch.from_arrays([pa.array([part.file.name] * len(some), pa.string()), pa.array([i for i, _ in some], pa.int64()), pa.array([t for _, t in some], pa.string())], names=["file", "row", "text"])

    if not part.file.name.endswith(".parquet"):
        yield from (batch(first, texts) for first, texts in _json_rows(part.file, text_key))
        return
    import pyarrow.parquet as pq

    source = pq.ParquetFile(io.BufferedReader(RangeFile(part.file.url, part.file.size), AHEAD))
    groups = source.num_row_groups
    row = 0
    for g in range(groups):
        if g * part.parts // groups == part.part:
            at = row
            for b in source.iter_batches(ROWS, row_groups=[g], columns=[text_key], use_threads=False):
                yield batch(at, b.column(0).to_pylist())
                at += b.num_rows
        row += source.metadata.row_group(g).num_rows


def _json_rows(file: RemoteFile, text_key: str) -> Iterator[tuple[int, list[str | None]]]:
    held, first = [], 0
    with fetch(file.url) as r:
        for line in io.TextIOWrapper(r, "utf-8", errors="ignore"):
            try:
                found = json.loads(line)
                text = found.get(text_key) if isinstance(found, dict) else None
                held.append(text if isinstance(text, str) and text.encode() else None)
            except ValueError:  # no JSON, or half a UTF-16 pair
                held.append(None)
            if len(held) == ROWS:
                yield first, held
                first, held = first + ROWS, []
    yield first, held


class RemoteSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_set"

    def schema(self) -> str:
        return "file string, row long, text string"

    def reader(self, schema):
        return RemoteReader(dict(self.options))

    def streamReader(self, schema):
        return RemoteStream(dict(self.options))


def _text_key(options: dict[str, str]) -> str:
    return options.get("text_key", "text")


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Part]:
        files = listed_files(self.options)
        if not files:
            raise FileNotFoundError(f"{self.options['listing']} lists no file of {self.options.get('name')}")
        return planned(files, int(self.options.get("part_bytes", PART_BYTES)))

    def read(self, partition: Part) -> Iterator:
        return read_part(partition, _text_key(self.options))


class RemoteStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.seen = 0

    @staticmethod
    def _offset(files: list[RemoteFile], n: int) -> dict:
        return {"files": n, "names": hashlib.sha256("\n".join(f.name for f in files[:n]).encode()).hexdigest()}

    def initialOffset(self) -> dict:
        return self._offset([], 0)

    def latestOffset(self) -> dict:
        files = listed_files(self.options)
        most = int(self.options.get("files_per_trigger", 0)) or len(files)
        self.seen = min(len(files), self.seen + most)
        return self._offset(files, self.seen)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        files = listed_files(self.options)
        for offset in (start, end):
            if offset != self._offset(files, offset["files"]):
                raise ValueError(f"{self.options['listing']} no longer lists the first {offset['files']} files as it did")
        self.seen = max(self.seen, end["files"])
        return planned(files[start["files"] : end["files"]], int(self.options.get("part_bytes", PART_BYTES)))

    def read(self, partition: Part) -> Iterator:
        return read_part(partition, _text_key(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteSet)
