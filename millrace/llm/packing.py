"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of documents in (doc_id) order, a stream of tokens.  Every
round fills one window: each queue with tokens left is served its share of
``window`` tokens, a document being cut where a quantum ends, and the fraction of a
token that a queue is owed is its deficit, carried into the next round.  When a
queue ends within a round, the others share the rest of it in their ratio.

Service is a closed form, so no queue is ever held by one task and no state goes
from window to window.  In virtual time t, queue k has been served
``min(tokens_k, weight_k * t)`` tokens; their sum is piecewise linear in t with one
kink a queue, and round r ends at the time when it is ``r * window``.  The round of
any token, and its place in the stream ordered by (round, queue, place in the
queue), follow from its place in its own queue, which is one two-pass prefix sum.

The stream is cut every ``window`` tokens; as whole tokens are served, a round ends
less than one token per queue before its window does, so a window's share of a
source is its target to within about two tokens per queue.  What is left at the
stream's end is cut at powers of two, so no sequence has padding.

A window cannot hold a fraction of a token: sources whose target is less than one
token a window are served from one common queue with their weights' sum.  So there
are at most ``window`` queues of their own, which bounds what is broadcast.

Weights are target token shares by source (``weights``; others get the least of
them), or each source's tokens to the power ``temperature``: 1 keeps the corpus'
own shares, so that all queues end together, 0 makes all sources equal.

Defined cases: null text is empty and has the end id only; null ``source`` is a
source of its own; null or repeated ``doc_id`` are rows like others; a document of
any length is cut like others; an empty table gives no pieces; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.tokens import encoder
from millrace.plans.prefix import running_sum
from millrace.plans.scratch import bounded_arrow_batches, discard, fresh_path, materialize

PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
#: Numbers of the (rounds, queues) table that are held at once.
CELLS = 1 << 21
#: So much below a whole token counts as one: what rounding may take from a sum.
CLOSE = 1e-6


def tail_lengths(rest: int) -> list[int]:
    """Powers of two that add up to ``rest``, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Schedule:
    """Which tokens of which queue each round serves."""

    def __init__(self, tokens: list[int], weights: list[float], window: int):
        self.window, self.total = window, sum(tokens)
        self.tokens = np.array(tokens, dtype=np.int64)
        self.weights = np.array(weights, dtype=np.float64)
        self.times = np.unique(np.concatenate(([0.0], np.where(self.tokens > 0, self.tokens / self.weights, 0.0))))
        served = [float(np.minimum(self.tokens, self.weights * t).sum()) for t in self.times]
        self.sums = np.maximum.accumulate(np.array(served))
        self.rounds = -(-self.total // window)

    def ends(self, rounds: np.ndarray) -> np.ndarray:
        """Virtual time at which each round ends; never before the end of an earlier one."""
        if len(self.times) < 2:
            return np.zeros(len(rounds))
        sums = rounds.astype(np.float64) * self.window
        k = np.clip(np.searchsorted(self.sums, sums, side="right") - 1, 0, len(self.times) - 2)
        span = self.sums[k + 1] - self.sums[k]
        part = np.divide(sums - self.sums[k], span, out=np.ones(len(sums)), where=span > 0)
        return np.clip(self.times[k] + part * (self.times[k + 1] - self.times[k]), self.times[k], self.times[k + 1])

    def _whole(self, rounds: np.ndarray, times: np.ndarray, tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.floor(np.minimum(tokens, weights * times + CLOSE)).astype(np.int64)
        return np.where(rounds >= self.rounds, tokens, np.where(rounds <= 0, 0, out))

    def served(self, rounds: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """Whole tokens that each queue has been served by the end of each round, one of both at a place."""
        return self._whole(rounds, self.ends(rounds), self.tokens[queues], self.weights[queues])

    def rounds_of(self, queues: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The round that serves each queue's token: an estimate in virtual time, then steps to the exact one."""
        sums = np.interp((tokens + 1) / self.weights[queues], self.times, self.sums)
        r = np.clip(np.ceil(sums / self.window).astype(np.int64), 1, max(1, self.rounds))
        while (early := self.served(r - 1, queues) > tokens).any():
            r -= early
        while (late := self.served(r, queues) <= tokens).any():
            r += late
        return r

    def pieces(self, queues: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of stretches of queues: number of the stretch, place in the queue, place in the stream and length of each piece, in order."""
        first, last = self.rounds_of(queues, begins), self.rounds_of(queues, begins + lengths - 1)
        many = last - first + 1
        of = np.repeat(np.arange(len(queues)), many)
        r = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[of]
        q = queues[of]
        before, after = self.served(r - 1, q), self.served(r, q)
        start, stop = np.maximum(before, begins[of]), np.minimum(after, (begins + lengths)[of])
        # tokens of all queues in earlier rounds, and of earlier queues in this one
        asked, where = np.unique(np.concatenate((r - 1, r)), return_inverse=True)
        both = np.concatenate((q, q))
        ahead, every = np.empty(len(both), dtype=np.int64), np.empty(len(both), dtype=np.int64)
        step = max(1, CELLS // len(self.tokens))
        order = np.argsort(where, kind="stable")
        for at in range(0, len(asked), step):
            part = asked[at : at + step]
            sums = np.cumsum(self._whole(part[:, None], self.ends(part)[:, None], self.tokens, self.weights), axis=1)
            here = order[np.searchsorted(where[order], at) : np.searchsorted(where[order], at + step)]
            row = where[here] - at
            every[here] = sums[row, -1]
            ahead[here] = np.where(both[here] > 0, sums[row, both[here] - 1], 0)
        n = len(r)
        place = every[:n] + ahead[n:] - ahead[:n] + start - before
        some = stop > start
        return of[some], start[some], place[some], (stop - start)[some]


def encode_rows(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Table of row number, doc_id, source, packed ids with the end id, and their count."""
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = "rid long, doc_id long, source string, ids binary, n long"

    def encode(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode(b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary()), pa.array([len(x) // enc.width for x in ids], pa.int64())],
                names=["rid", "doc_id", "source", "ids", "n"],
            )

    path = fresh_path(spark, "pack-ids")
    rows.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def queues(lengths: DataFrame, window: int, weights: Mapping[str, float] | None = None, temperature: float = 1.0) -> tuple[DataFrame, Schedule]:
    """rid, queue, begin of each document, and the schedule of the queues."""
    totals = lengths.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights:
        if min(weights.values()) <= 0:
            raise ValueError("weights must be above 0")
        given = lengths.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "of string, weight double")
        totals = totals.join(F.broadcast(given), F.col("source") == F.col("of"), "left").select("source", "tokens", F.coalesce("weight", F.lit(float(min(weights.values())))).alias("weight"))
    else:
        totals = totals.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(float(temperature))))
    totals = materialize(totals, "pack-sources")
    whole = F.lit(totals.agg(F.sum("weight")).first()[0] or 0.0)
    own = totals.where(F.col("weight") * window >= whole).collect()  # at most ``window`` rows, as the shares add up to 1
    rest = totals.where(F.col("weight") * window < whole).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    own = sorted(own, key=lambda r: (r.source is not None, r.source or ""))
    number = lengths.sparkSession.createDataFrame([(r.source, k) for k, r in enumerate(own)], "of string, queue int")
    plan = Schedule([*[r.tokens for r in own], rest[0]], [*[r.weight for r in own], rest[1]], window)
    named = lengths.join(F.broadcast(number), F.col("source").eqNullSafe(F.col("of")), "left").select("rid", "doc_id", "n", F.coalesce("queue", F.lit(len(own))).alias("queue"))
    placed = running_sum(named, "n", ["doc_id", "rid"], ["queue"], "begin")
    discard(totals)
    return placed.select("rid", "queue", "begin"), plan


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = 2048,
    weights: Mapping[str, float] | None = None,
    temperature: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    table = encode_rows(docs, tokenizer, end_id, id_col, text_col, source_col)
    places, plan = queues(table.select("rid", "doc_id", "source", "n"), window, weights, temperature)
    full = plan.total // window
    bounds = np.cumsum([full * window, *tail_lengths(plan.total - full * window)]).tolist()
    width = encoder(tokenizer).dtype
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    placed = table.select("rid", "doc_id", "ids", "n").join(places, "rid").select("doc_id", "ids", "n", "queue", "begin")

    def cut(batches):
        plan = shared.value
        for b in batches:
            docs, packed, tokens = (b.column(k).to_pylist() for k in (0, 1, 2))
            begins = b.column(4).to_numpy()
            found = plan.pieces(b.column(3).to_numpy().astype(np.int64), begins, b.column(2).to_numpy()) if b.num_rows else ()
            out: list[list] = [[] for _ in PIECES]
            at, ids = -1, np.zeros(0, dtype="<u4")
            for of, start, pos, length in zip(*(x.tolist() for x in found)):
                if of != at:
                    at, ids = of, np.frombuffer(packed[of], dtype=width).astype("<u4")
                first, end = start - int(begins[of]), pos + length
                while pos < end:
                    if pos < bounds[0]:
                        seq = pos // window
                        begin, stop = seq * window, (seq + 1) * window
                    else:
                        k = int(np.searchsorted(bounds, pos, side="right"))
                        seq, begin, stop = full + k - 1, bounds[k - 1], bounds[k]
                    size = min(stop, end) - pos
                    row = (docs[of], first, size, zlib.crc32(ids[first : first + size].tobytes()), tokens[of], seq, pos - begin)
                    for column, x in zip(out, row):
                        column.append(x)
                    pos, first = pos + size, first + size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=PIECES.fieldNames())

    return placed.mapInArrow(cut, PIECES)
