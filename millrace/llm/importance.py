"""Importance resampling towards a target distribution by external sort-count.

Documents become streams of bucket numbers of their hashed features.  Tasks write
these packed as unsigned 16-bit numbers, one stream a batch of documents with each
document's offset in it, as a table in the shared folder; texts are read once.
Counting reads the streams back: each is sorted and run-length encoded, runs are
added up inside the task and then by Spark, bucket by bucket.  A bucket's gain, its
log ratio in target and corpus, is looked up for the streams as they stand, and
``np.add.reduceat`` at the offsets gives each document's weight.  Documents are drawn
without replacement by weight plus Gumbel noise, which a hash of the id fixes; places
come from a two-pass count over a range partitioning, on ids and scores alone.

What goes through the driver are ``buckets`` counts, 65,536 at most.

Defined cases: null and empty texts have no features and weight 0; a null id is hashed
as an empty one and loses ties; rows that repeat an id have a place each, in an order
fixed within a run; very long texts are split into words a piece at a time and their
streams take two bytes a word; an empty corpus gives no rows, an empty target gains
by its smoothing alone; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.prefix import running_sum
from millrace.plans.scratch import bounded_arrow_batches, discard, materialize

BUCKETS = 10_000
SEED = 2024
#: Fixed value: bytes outside ASCII letters and digits part words; all others belong to them.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of a text that are split at a time, and words a worker remembers before it starts anew.
AT_ONCE, REMEMBERED = 1 << 20, 300_000
#: Features of one stream at most, but for one long text.
STREAM = 1 << 22


class Buckets:
    """Bucket numbers of a text's features; a worker remembers those of single words."""

    def __init__(self, buckets: int, runs: int):
        if not 0 < buckets <= 1 << 16:
            raise ValueError("buckets must fit in 16 bits")
        self.buckets, self.runs = buckets, runs
        self.known: dict[bytes, int] = {}

    def _bucket(self, feature: bytes) -> int:
        return zlib.crc32(feature) % self.buckets

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint16)
        return np.concatenate([np.zeros(0, dtype=np.uint16), *self._parts(text.encode("utf-8", "surrogatepass").lower())])

    def _parts(self, body: bytes) -> Iterator[np.ndarray]:
        held: list[bytes] = []  # the last words, which longer runs begin with
        at = 0
        while at < len(body):
            stop = min(len(body), at + AT_ONCE)
            if stop < len(body):  # up to the end of a word that the piece would cut
                rest = WORDS.match(body, stop)
                stop = rest.end() if rest else stop
            words = WORDS.findall(body, at, stop)
            at = stop
            if len(self.known) > REMEMBERED:
                self.known = {}
            known = self.known
            for w in set(words).difference(known):
                known[w] = self._bucket(w)
            yield np.fromiter(map(known.__getitem__, words), dtype=np.uint16, count=len(words))
            for n in range(2, self.runs + 1):
                line = held[len(held) - min(len(held), n - 1) :] + words
                yield np.fromiter((self._bucket(b" ".join(line[k : k + n])) for k in range(len(line) - n + 1)), dtype=np.uint16)
            held = (held + words)[-(self.runs - 1) :] if self.runs > 1 else []


def bucket_streams(rows: DataFrame, buckets: int = BUCKETS, runs: int = 1) -> DataFrame:
    """id, text -> ids, starts (each document's offset, and the end), stream (packed uint16), written to the shared folder."""
    bounded_arrow_batches(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        made = Buckets(buckets, runs)

        def packed(ids, parts):
            starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
            stream = np.concatenate([np.zeros(0, dtype=np.uint16), *parts]).astype("<u2")
            lists = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([lists(ids), lists(pa.array(starts)), pa.array([stream.tobytes()], pa.binary())], names=["ids", "starts", "stream"])

        for b in batches:
            first, parts, held = 0, [], 0
            for k, text in enumerate(b.column(1).to_pylist()):
                parts.append(made.of(text))
                held += len(parts[-1])
                if held >= STREAM:
                    yield packed(b.column(0).slice(first, k + 1 - first), parts)
                    first, parts, held = k + 1, [], 0
            if parts:
                yield packed(b.column(0).slice(first), parts)

    return materialize(rows.select("id", "text").mapInArrow(run, f"ids array<{kind}>, starts array<long>, stream binary"), "importance-streams")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a stream, ascending, and how often each comes: sorted, then run-length encoded."""
    if not len(stream):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ordered = np.sort(stream, kind="stable")  # a radix sort for 16 bits
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[at].astype(np.int64), np.diff(np.append(at, len(ordered)))


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all streams fall in each bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for packed in b.column(0):
                number, n = run_lengths(np.frombuffer(packed.as_buffer(), dtype="<u2"))
                total[number] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = streams.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log ratio of smoothed shares, rounded down."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(s_all + size)) / (float(s + 1) * float(t_all + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def document_weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_features, weight of every document of the streams."""
    spark = streams.sparkSession
    kind = streams.schema["ids"].dataType.elementType.simpleString()
    shared = spark.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        values = shared.value
        for b in batches:
            for ids, starts, packed in zip(b.column(0), b.column(1), b.column(2)):
                starts = starts.values.to_numpy()
                n = np.diff(starts)
                each = np.append(values[np.frombuffer(packed.as_buffer(), dtype="<u2")], 0)  # the 0 lets empty documents at the end have a place
                weight = np.where(n > 0, np.add.reduceat(each, starts[:-1]), 0)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(weight)], names=["id", "n_features", "weight"])

    return streams.mapInArrow(run, f"id {kind}, n_features long, weight long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least: int = 20,
    buckets: int = BUCKETS,
    runs: int = 1,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document.

    Of the documents with ``least`` features of single words or more, ``percent`` of a hundred are drawn.
    """
    named = lambda df, key, text: df.select(key.alias("id"), F.col(text).alias("text"))
    streams = bucket_streams(named(docs, F.col(id_col), text_col), buckets, runs)
    wanted = bucket_streams(named(target, F.lit(0), target_col), buckets, runs)
    gain = gains(bucket_counts(streams, buckets), bucket_counts(wanted, buckets))
    weighed = document_weights(streams, gain)
    # n words make n + (n - 1) + ... features of up to ``runs`` words
    enough = sum(max(0, least - k) for k in range(runs))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = weighed.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_features") < enough).alias("short"))
    scored = materialize(scored.withColumn("rid", F.monotonically_increasing_id()), "importance-scores")
    discard(streams, wanted)
    drawn = percent * scored.where("not short").count() // 100
    order = scored.withColumn("low", -F.col("score")).withColumn("nameless", F.col("id").isNull()).withColumn("one", F.lit(1))
    placed = running_sum(order, "one", ["short", "low", "nameless", "id", "rid"], into="before")
    rank = F.when(~F.col("short") & (F.col("before") < drawn), F.col("before") + 1)
    return placed.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank.alias("rank"))
