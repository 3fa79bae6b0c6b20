"""Token-ID output: one concatenated id array per shard, document boundaries in Elias-Fano.

File format, little-endian, sections in this order:

* ``ids``: all ids of the shard's documents in a row, 2 or 4 bytes each;
* ``ends``: an Elias-Fano sequence, the end of each document in ids;
* ``names``: an Elias-Fano sequence, each document's id less the shard's smallest
  (documents without an id come first and are only counted);
* a JSON header, its length as 4 bytes, and the 8 bytes ``MRTOKEF1``.

An Elias-Fano sequence of n values below u takes n * (2 + log2(u / n)) bits: the
low bits packed, the high bits in unary, and a 4-byte sample of every 256th one,
from which ``select(i)`` finds a value without a table of 64-bit offsets.

Defined cases: null text is empty and has the end id only; null ``doc_id`` sorts
first; rows that repeat a ``doc_id`` are kept, ordered by a hash of the text and
the ids; a text of any length is encoded whole; an empty table gives no shards and
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.files import attempt_name, drop_strays, make_dir, resolve
from millrace.llm.tokens import encoder
from millrace.plans.scratch import fresh_path, bounded_arrow_batches

MAGIC = b"MRTOKEF1"
SAMPLE = 256
#: Values whose low bits are taken apart at a time.
BLOCK = 1 << 16
#: Ids that are read at a time; a longer document is read whole.
READ_IDS = 1 << 21


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        parts = []
        for at in range(0, n if low_bits else 0, BLOCK):  # a multiple of 8 values fills whole bytes
            bits = (values[at : at + BLOCK, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[at] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k, left = divmod(i, SAMPLE)
        at = int(self.samples[k])
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + ((word & -word).bit_length() - 1) - i
        start = i * self.low_bits
        part = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes(), "little") >> (start & 7)
        return high << self.low_bits | part & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        places = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        for k in range(0, self.n, BLOCK):
            some = min(BLOCK, self.n - k)
            packed = self.low[k * self.low_bits // 8 : -(-(k + some) * self.low_bits // 8)]
            bits = np.unpackbits(packed, bitorder="little")[: some * self.low_bits].reshape(some, self.low_bits)
            high[k : k + some] |= bits.astype(np.uint64) @ places
        return high

    def pack(self) -> bytes:
        head = struct.pack("<QBxxxIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<QBxxxIII", data)
        at = struct.calcsize("<QBxxxIII")
        body = np.frombuffer(data, dtype=np.uint8, offset=at)
        return cls(n, low_bits, body[:a], body[a : a + b], np.frombuffer(data, dtype="<u4", count=c, offset=at + a + b))


class ShardWriter:
    """Streams documents to one file; holds a few bytes a document, never their ids."""

    def __init__(self, uri: str, width: int):
        fs, path = resolve(uri)
        self.out, self.width = fs.open_output_stream(path, compression=None), width
        self.counts: list[int] = []
        self.names: list[int] = []
        self.unnamed = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None:
            self.unnamed += 1
        else:
            self.names.append(doc_id)
        self.out.write(ids)
        self.counts.append(len(ids) // self.width)

    def close(self) -> dict:
        names = np.array(self.names, dtype=np.int64)
        base = int(names[0]) if len(names) else 0
        ends = EliasFano.of(np.cumsum(np.array(self.counts, dtype=np.uint64))).pack()
        given = EliasFano.of((names - base).astype(np.uint64)).pack()
        head = {"docs": len(self.counts), "ids": int(sum(self.counts)), "width": self.width, "unnamed": self.unnamed, "base": base, "ends": len(ends), "names": len(given)}
        text = json.dumps(head).encode()
        self.out.write(ends + given + text + struct.pack("<I", len(text)) + MAGIC)
        self.out.close()
        return head


class ShardReader:
    def __init__(self, uri: str):
        fs, path = resolve(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        (n,) = struct.unpack("<I", tail[:4])
        self.head = json.loads(self.file.read_at(n, size - 12 - n))
        h = self.head
        at = h["ids"] * h["width"]
        self.ends = EliasFano.unpack(self.file.read_at(h["ends"], at))
        self.names = EliasFano.unpack(self.file.read_at(h["names"], at + h["ends"]))
        self.dtype = np.dtype(f"<u{h['width']}")

    def ids(self, start: int, stop: int) -> np.ndarray:
        w = self.head["width"]
        return np.frombuffer(self.file.read_at((stop - start) * w, start * w), dtype=self.dtype)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document by two selects and one read."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def doc_ids(self) -> list[int | None]:
        base = self.head["base"]
        return [None] * self.head["unnamed"] + [base + int(x) for x in self.names.all()]

    def scan(self):
        """(doc_id, start, ids) of every document, in bounded reads."""
        ends = self.ends.all().astype(np.int64)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        names = self.doc_ids()
        k = 0
        while k < len(ends):
            last = max(k + 1, int(np.searchsorted(ends, starts[k] + READ_IDS, side="right")))
            block = self.ids(int(starts[k]), int(ends[last - 1]))
            for i in range(k, last):
                yield names[i], int(starts[i]), block[starts[i] - starts[k] : ends[i] - starts[k]]
            k = last


MANIFEST = T.StructType([T.StructField("part", T.LongType()), T.StructField("file", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encodes ``docs`` to shards under ``folder`` in ascending id order.

    Rows are range-partitioned by (id, hash of the text), so even one id that
    holds many rows is spread, and sorted on disk by Spark; each task streams its
    range to one file.  Returns the manifest, one entry a shard, in order.
    """
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    make_dir(folder)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def write(batches):
        enc, out, name = encoder(tokenizer), None, ""
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            if batch.num_rows and out is None:
                name = attempt_name("tokens", ".ids")
                out = ShardWriter(f"{folder}/{name}", enc.width)
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                out.add(doc_id, ids + end)
        if out is not None:
            head = out.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": name, "docs": head["docs"], "ids": head["ids"]}], schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    shards = sorted((r.asDict() for r in ordered.select("doc_id", "text").mapInArrow(write, MANIFEST).collect()), key=lambda r: r["part"])
    drop_strays(folder, {r["file"] for r in shards})
    return shards


def read_shards(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files alone."""
    if not shards:
        return spark.createDataFrame([], RESULT)
    rows, base = [], 0
    for k, s in enumerate(shards):
        rows.append((k, s["file"], base))
        base += s["ids"]
    listed = spark.createDataFrame(rows, "slot int, file string, base long").repartitionById(len(rows), F.col("slot"))

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out: tuple[list, ...] = ([], [], [], [])
                for doc_id, start, ids in ShardReader(f"{folder}/{file}").scan():
                    for column, x in zip(out, (doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        column.append(x)
                    if len(out[0]) == 8192:
                        yield _batch(out)
                        out = ([], [], [], [])
                yield _batch(out)

    return listed.mapInArrow(read, RESULT)


def _batch(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=RESULT.fieldNames())


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of ``docs`` and returns what is read back from them."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-ids")
    return read_shards(spark, folder, write_shards(docs, tokenizer, folder, end_id, id_col, text_col))
