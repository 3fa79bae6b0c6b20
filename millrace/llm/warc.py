"""WARC records in seekable Zstandard bundles.

A bundle is a Zstandard file of independent frames, each of about ``FRAME``
bytes of records.  It ends in two skippable frames: the record map (record
identifier, frame, offset in the unpacked frame, length; sorted by identifier)
and the seek table of the public seekable format.  Any Zstandard program unpacks
the file to a plain WARC; ``Bundle.record`` reads one record by unpacking one
frame.

Records with equal payloads are stored once: the row with the smallest page_id is
a ``response``, the others are ``revisit`` records that name it.

Defined cases: null html is an empty payload; null url gives a ``urn:page:``
target; a null page_id is revisit to an equal payload that has an id, else a
response; rows that repeat page_id and payload are one response, the rest
revisits of it; a payload of any length is one record; an empty table gives no
bundles and no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.files import attempt_name, drop_strays, make_dir, resolve
from millrace.plans.scratch import fresh_path, materialize, bounded_arrow_batches

FRAME = 256 << 10
#: Digests that are broadcast at most; above it, both sides are shuffled.
BROADCAST_KEYS = 500_000
# Fixed values of the Zstandard formats.
SKIPPABLE_MAP = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
MAP_ENTRY = np.dtype([("page_id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4"), ("named", "u1")])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RESULT = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base32_sha1(payload)
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id, digest) if not revisit else record_uri(page_id, 'revisit:' + digest)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Page-Id: {'' if page_id is None else page_id}",
        f"Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and HTTP payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])} if lines[0] == "WARC/1.1" else {}
    if not fields:
        raise ValueError("no WARC record")
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    def __init__(self, uri: str, level: int = 3):
        import zstandard

        fs, path = resolve(uri)
        self.out, self.zstd = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.held = 0
        self.frames: list[tuple[int, int]] = []
        self.map: list[tuple[int, int, int, int, int]] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        self.map.append((page_id or 0, len(self.frames), self.held, len(record), page_id is not None))
        self.parts.append(record)
        self.held += len(record)
        if self.held >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.parts))
            self.out.write(packed)
            self.frames.append((len(packed), self.held))
            self.parts, self.held = [], 0

    def close(self) -> int:
        self.flush()
        entries = np.sort(np.array(self.map, dtype=MAP_ENTRY), order=["page_id", "frame", "offset"]).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_MAP, len(entries)) + entries)
        self.frames.append((8 + len(entries), 0))
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        return len(self.map)


class Bundle:
    """Reads a bundle from its end; unpacks only the frames it is asked for."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = resolve(uri)
        self.file, self.zstd = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = np.frombuffer(self.file.read_at(8 * count, size - 9 - 8 * count), dtype="<u4").reshape(count, 2).astype(np.int64)
        self.sizes = table
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        at, n = int(self.starts[count - 1]), int(table[count - 1, 0])
        self.map = np.frombuffer(self.file.read_at(n - 8, at + 8), dtype=MAP_ENTRY)

    def frame(self, k: int) -> bytes:
        return self.zstd.decompress(self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k])), max_output_size=int(self.sizes[k, 1]))

    def record(self, page_id: int) -> bytes:
        """The first record of a page, by binary search in the map."""
        k = int(np.searchsorted(self.map["page_id"], page_id))
        if k == len(self.map) or self.map["page_id"][k] != page_id or not self.map["named"][k]:
            raise KeyError(page_id)
        e = self.map[k]
        return self.frame(int(e["frame"]))[int(e["offset"]) : int(e["offset"]) + int(e["length"])]

    def scan(self):
        """Every record, frame by frame."""
        order = np.argsort(self.map, order=["frame", "offset"])
        last, data = -1, b""
        for e in self.map[order]:
            if e["frame"] != last:
                last, data = int(e["frame"]), self.frame(int(e["frame"]))
            yield data[int(e["offset"]) : int(e["offset"]) + int(e["length"])]


def with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, digest, the smallest page_id of the equal payloads, and whether the row repeats another.

    Pages stay where they are read.  Only (page_id, digest) pairs are grouped, and
    digests that several pages have come back by a broadcast whose size is counted,
    or, beyond it, by a plain join, in which adaptive execution splits a payload
    that very many pages have.  Rows that repeat (page_id, payload) are numbered, if
    there are any, over a copy of the table.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1("html"))
    pairs = materialize(rows.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("held")), "warc-digests")
    many = pairs.groupBy("digest").agg(F.min("page_id").alias("original"), F.sum("held").alias("copies")).where("copies > 1")
    many = materialize(many.select(F.col("digest").alias("d"), "original"), "warc-copies")
    again = F.lit(False)
    repeated = pairs.where("held > 1").select(F.col("page_id").alias("p"), F.col("digest").alias("q"))
    if not repeated.isEmpty():
        rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "warc-pages", "zstd")
        on = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("q"))
        keys = rows.select("rid", "page_id", "digest").join(_bounded(repeated), on)
        lead = materialize(keys.groupBy("p", "q").agg(F.min("rid").alias("lead")), "warc-repeats")
        rows = rows.join(_bounded(lead), on, "left")
        again = F.coalesce(F.col("rid") != F.col("lead"), F.lit(False))
    rows = rows.join(_bounded(many), F.col("digest") == F.col("d"), "left")
    return rows.select("page_id", "url", "html", "digest", F.coalesce("original", "page_id").alias("original"), again.alias("again"))


def _bounded(keys: DataFrame) -> DataFrame:
    """A broadcast where the number of rows, counted here, allows it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def write_bundles(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[str]:
    """Writes every page as a record; returns the bundles that Spark committed."""
    bounded_arrow_batches(pages.sparkSession)
    make_dir(folder)
    rows = with_originals(pages, id_col, url_col, html_col).sortWithinPartitions("page_id", "digest")

    def write(batches):
        out, name = None, ""
        for b in batches:
            if b.num_rows and out is None:
                name = attempt_name("bundle", ".warc.zst")
                out = BundleWriter(f"{folder}/{name}")
            for page_id, url, html, _, original, again in zip(*[c.to_pylist() for c in b.columns]):
                revisit = again or page_id != original
                out.add(page_id, make_record(page_id, url, html.encode("utf-8", "replace"), original, revisit, date))
        if out is not None:
            n = out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    files = sorted(r["file"] for r in rows.mapInArrow(write, "file string, records long").collect())
    drop_strays(folder, set(files))
    return files


def read_bundles(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """One row per record; a response's payload is hashed anew against its header."""
    if not files:
        return spark.createDataFrame([], RESULT)
    listed = spark.createDataFrame(list(enumerate(files)), "slot int, file string").repartitionById(len(files), F.col("slot"))

    def read(batches):
        for b in batches:
            for file in b.column(1).to_pylist():
                out: list[list] = [[] for _ in RESULT]
                for record in Bundle(f"{folder}/{file}").scan():
                    head, payload = parse_record(record)
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Payload-Length"])
                    if head["WARC-Type"] == "response" and (base32_sha1(payload), len(payload)) != (digest, n):
                        raise ValueError(f"{file}: payload of page {head['Page-Id']} does not match its digest")
                    refers = head.get("Refers-To-Page")
                    row = (int(head["Page-Id"]) if head["Page-Id"] else None, n, digest, head["WARC-Type"], int(refers) if refers else None)
                    for column, x in zip(out, row):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=RESULT.fieldNames())

    return listed.mapInArrow(read, RESULT)


def warc_archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes ``pages`` to bundles and returns what is read back from them."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    return read_bundles(spark, folder, write_bundles(pages, folder, **columns))
