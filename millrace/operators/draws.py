"""Draws of CPython's generator in segments, and the bounded shuffle buffer as a relation of draws.

The generator is a sequence, so its states are stepped through once, a segment of draws
at a time and without keeping any draw; what is kept is a state of 2.5 kB a segment.
Segments are then drawn again by tasks, each from its own state.

A full buffer gives up a drawn slot for each new item.  An item thus leaves at the next
draw of its slot: the ``lead`` over (slot, draw), which tasks know inside a segment, and
a window over one row a slot and segment for the rest.  What is in the buffer at the end
leaves in the order that the generator shuffles the slots to.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import materialize

#: Draws of a segment.
SEGMENT = 1 << 20


def _generator(state: bytes) -> np.random.MT19937:
    out = np.random.MT19937()
    words = np.frombuffer(state, dtype="<u4")
    out.state = {"bit_generator": "MT19937", "state": {"key": words[:-1].copy(), "pos": int(words[-1])}}
    return out


def _state(generator: np.random.MT19937) -> bytes:
    held = generator.state["state"]
    return np.append(held["key"], held["pos"]).astype("<u4").tobytes()


def seeded_state(seed: int) -> bytes:
    """The state that ``random.Random(seed)`` begins with."""
    return np.array(random.Random(seed).getstate()[1], dtype="<u4").tobytes()


def as_random(state: bytes) -> random.Random:
    out = random.Random()
    out.setstate((3, tuple(np.frombuffer(state, dtype="<u4").tolist()), None))
    return out


def below(state: bytes, limit: int, count: int) -> tuple[np.ndarray, bytes]:
    """``count`` numbers as ``randrange(limit)`` draws them one by one, and the state after them.

    A number takes the first bits of a word; words whose bits reach the limit are passed over.
    """
    bits = limit.bit_length()
    if not 0 < bits <= 32:
        raise ValueError("a limit has 1 to 32 bits")
    generator, parts, left = _generator(state), [], count
    while left > 0:
        before = _state(generator)
        words = generator.random_raw(left + (left >> 4) + 16) >> np.uint64(32 - bits)
        good = np.flatnonzero(words < limit)[:left]
        if len(good) == left:  # no word more than the last number takes
            generator = _generator(before)
            generator.random_raw(int(good[-1]) + 1, output=False)
        parts.append(words[good].astype(np.int64))
        left -= len(good)
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts]), _state(generator)


def segment_states(seed: int, limit: int, count: int, segment: int) -> Iterator[tuple[int, bytes]]:
    """(number, state) of every segment of ``count`` draws, and of the one after the last."""
    state = seeded_state(seed)
    yield 0, state
    for k in range(count // segment):
        state = below(state, limit, segment)[1]
        yield k + 1, state


def segments(spark: SparkSession, seed: int, limit: int, count: int, segment: int = SEGMENT) -> DataFrame:
    """segment, state: a row per ``segment`` draws, written to the shared folder."""
    return materialize(spark.createDataFrame(list(segment_states(seed, limit, count, segment)), "segment long, state binary"), "draw-states")


def slot_times(states: DataFrame, slots: int, count: int, segment: int = SEGMENT) -> DataFrame:
    """item, slot, leaves: which slot each of ``slots + count`` items takes, and the draw at which it leaves, null if none."""

    def run(batches):
        for b in batches:
            for number, state in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first = number * segment
                slot = below(state, slots, max(0, min(segment, count - first)))[0]
                order = np.argsort(slot, kind="stable")
                same = slot[order][1:] == slot[order][:-1]
                leaves = np.full(len(slot), -1, dtype=np.int64)
                leaves[order[:-1][same]] = order[1:][same] + first
                opens = np.ones(len(slot), dtype=bool)
                opens[order[1:][same]] = False
                at = np.arange(first, first + len(slot))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(slot), pa.array(leaves, mask=leaves < 0), pa.array(opens), pa.array(np.full(len(slot), number))], names=["at", "slot", "leaves", "opens", "segment"])

    spread = states.repartition(max(1, -(-count // segment)), "segment")
    drawn = materialize(spread.mapInArrow(run, "at long, slot long, leaves long, opens boolean, segment long"), "draws")
    # a slot's last item of a segment leaves at its first draw in a later one; the first items came before all segments
    begin = states.sparkSession.range(slots).select((F.col("id") - slots).alias("at"), F.col("id").alias("slot"), F.lit(None).cast("long").alias("leaves"), F.lit(False).alias("opens"), F.lit(-1).cast("long").alias("segment"))
    every = drawn.unionByName(begin)
    later = Window.partitionBy("slot").orderBy("segment").rangeBetween(1, Window.unboundedFollowing)  # two rows a segment
    edges = every.where("opens or leaves is null").withColumn("next", F.min(F.when(F.col("opens"), F.col("at"))).over(later))
    late = edges.where("leaves is null").select((F.col("at") + slots).alias("item"), "slot", F.col("next").alias("leaves"))
    return every.where("leaves is not null").select((F.col("at") + slots).alias("item"), "slot", "leaves").unionByName(late)


def end_places(sizes: DataFrame, states: DataFrame, slots: int, group: str, segment: int = SEGMENT) -> DataFrame:
    """(group, size) -> group, slot, place: where the items left in the slots stand after the generator's shuffle of them."""
    kind = sizes.schema[group].dataType.simpleString()
    drawn = F.greatest(F.col("size") - slots, F.lit(0))
    asked = sizes.withColumn("drawn", drawn).withColumn("own", F.floor(drawn / segment))
    held = asked.join(states, F.col("own") == F.col("segment")).select(group, "size", "drawn", "own", "state")

    def run(batches):
        for b in batches:
            for k, (size, done, own, state) in enumerate(zip(*[b.column(c).to_pylist() for c in range(1, 5)])):
                rng = as_random(below(state, slots, done - own * segment)[1])
                order = list(range(min(size, slots)))  # as long as the buffer
                rng.shuffle(order)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0).slice(k, 1)] * len(order)) if order else b.column(0).slice(0, 0), pa.array(order, pa.int64()), pa.array(range(len(order)), pa.int64())], names=[group, "slot", "place"])

    return held.mapInArrow(run, f"{group} {kind}, slot long, place long")
