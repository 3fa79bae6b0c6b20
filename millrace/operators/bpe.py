"""Merges of byte-level BPE from a table of pieces, many merges a round.

Pieces stand in blocks of packed symbol numbers, spread over tasks, and pair counts in
a table; both are written anew each round.  A round has three steps.

1. The most frequent pairs, the candidates, come to the driver in their order.
2. Each piece is cut down to its runs: the longest parts all of whose neighbours are
   candidates.  Equal runs are added up.  Every occurrence of a candidate lies in one
   run, so the driver can go on merging in the runs alone, new pairs included, for as
   long as the next pair comes no later than the last candidate.  Any pair that the
   runs do not show stems from neighbours that are no candidates; it comes no more
   often than these, and its new symbol has a higher number, so it comes later.
3. Tasks apply these merges to all pieces; what they change is added to the table.

The driver holds ``RUNS`` distinct runs at most, however many pieces there are: the
number of candidates is lowered until that holds, and with one candidate it always does.
As new symbols are rarer, runs get shorter, and rounds longer.

The result is what the library's trainer learns from the occurrences one by one: equal
counts go by lower numbers, a merge whose string has a number keeps that number, a
merged pair keeps its count in case that later merges bring it back.  A merge of the
kind that reuses a number is a round of its own, as pairs with it are not only new ones.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import bounded_arrow_batches, discard, materialize

#: Distinct runs that the driver merges in at a time, candidates of the first round, and symbols of a block.
RUNS, CANDIDATES, BLOCK = 100_000, 64, 1 << 19


def byte_symbols() -> tuple[list[str], bytes]:
    """Names of the 256 first symbols in order, and the symbol of each byte."""
    from tokenizers import pre_tokenizers

    names = sorted(pre_tokenizers.ByteLevel.alphabet())
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    hidden = [b for b in range(256) if b not in set(shown)]
    at = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    ids = {name: i for i, name in enumerate(names)}
    return names, bytes(ids[at[b]] for b in range(256))


def _merged(word: str, pair: str, new: str) -> tuple[str, list[tuple[str, int]]]:
    """The word with each ``pair`` replaced from the left, and what that does to the counts of its pairs."""
    changes = []
    i = word.find(pair)
    while i >= 0:
        if i:
            changes += [(word[i - 1] + pair[0], -1), (word[i - 1] + new, 1)]
        word = word[:i] + new + word[i + 2 :]
        if i + 1 < len(word):
            changes += [(pair[1] + word[i + 1], -1), (new + word[i + 1], 1)]
        i = word.find(pair, i + 1)
    return word, changes


@dataclass
class Merges:
    """Symbols and merges learned so far; a word is a string with a character per symbol, whose code is the symbol's number."""

    names: list[str]
    entries: int
    least: int
    ids: dict[str, int] = field(init=False)
    merges: dict[str, None] = field(default_factory=dict)
    ended: bool = False

    def __post_init__(self):
        self.ids = {name: k for k, name in enumerate(self.names)}

    def learn(self, words: Iterable[tuple[str, int]], known: dict[str, int] | None = None, last: tuple[int, str] | None = None) -> list[tuple[str, int]]:
        """Merges in (word, n) while there are entries to be had; (pair, symbol) of each.

        With ``known``, the words are the runs of these candidates: their counts are
        given, and learning goes on up to ``last``, (less than nothing its count, pair),
        or to a merge that reuses a number.
        """
        pieces, weights, where = [], array("q"), defaultdict(lambda: array("I"))
        counts: dict[str, int] = defaultdict(int)
        for k, (word, n) in enumerate(words):
            pieces.append(word)
            weights.append(n)
            for pair in map("".join, zip(word, word[1:])):
                counts[pair] += n
                if not (seen := where[pair]) or seen[-1] != k:
                    seen.append(k)
        for pair, n in (known or {}).items():
            counts[pair] = n
            where[pair]  # a pair that came back and went again is still merged, in no word
        # a string of two characters sorts as the pair of numbers does; the third member only parts entries of one pair
        queue = [(-counts[p], p, k, held) for k, (p, held) in enumerate(where.items())]
        made = len(queue)
        del where
        heapify(queue)
        done: list[tuple[str, int]] = []
        while len(self.names) < self.entries and queue:
            n, pair, k, held = heappop(queue)
            if -n != counts[pair]:
                heappush(queue, (-counts[pair], pair, k, held))
                continue
            if known is not None and last is not None and (n, pair) > last:
                return done
            if -n < max(1, self.least):
                break
            name = self.names[ord(pair[0])] + self.names[ord(pair[1])]
            reused = name in self.ids
            if known is not None and reused and done:
                return done
            if not reused:
                self.ids[name] = len(self.names)
                self.names.append(name)
            self.merges.pop(pair, None)
            self.merges[pair] = None
            done.append((pair, self.ids[name]))
            if known is not None and reused:
                return done
            new, found = chr(self.ids[name]), defaultdict(lambda: array("I"))
            for w in held:
                pieces[w], changes = _merged(pieces[w], pair, new)
                for p, change in changes:
                    counts[p] += change * weights[w]
                    if change > 0 and (not (seen := found[p]) or seen[-1] != w):
                        seen.append(w)
            for p, more in found.items():
                if counts[p] > 0:
                    made += 1
                    heappush(queue, (-counts[p], p, made, more))
        self.ended = known is None or last is None or len(self.names) >= self.entries
        return done

    def pairs(self) -> list[tuple[str, str]]:
        return [(self.names[ord(p[0])], self.names[ord(p[1])]) for p in self.merges]


@dataclass
class Block:
    """Words one after the other: their symbols, lengths and counts."""

    symbols: np.ndarray
    sizes: np.ndarray
    n: np.ndarray

    @classmethod
    def unpacked(cls, symbols, sizes, n) -> Block:
        return cls(np.frombuffer(symbols.as_buffer(), dtype="<i4"), np.frombuffer(sizes.as_buffer(), dtype="<i4"), np.frombuffer(n.as_buffer(), dtype="<i8"))

    def packed(self) -> list[bytes]:
        return [self.symbols.astype("<i4").tobytes(), self.sizes.astype("<i4").tobytes(), self.n.astype("<i8").tobytes()]

    def owners(self) -> np.ndarray:
        """The word of each symbol."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def codes(self) -> np.ndarray:
        """At each symbol the pair that it begins, -1 at the end of a word."""
        out = np.full(len(self.symbols), -1, dtype=np.int64)
        out[:-1] = self.symbols[:-1].astype(np.int64) << 32 | self.symbols[1:]
        out[np.cumsum(self.sizes) - 1] = -1
        return out

    def only(self, words: np.ndarray) -> Block:
        return Block(self.symbols[np.repeat(words, self.sizes)], self.sizes[words], self.n[words])


def _places(sought: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the sorted array, -1 if it does not."""
    at = np.minimum(np.searchsorted(sought, codes), len(sought) - 1)
    return np.where(sought[at] == codes, at, -1)


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, their sums, and whether any of a code's numbers is positive."""
    found, at = np.unique(codes, return_inverse=True)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(found)))
    if not len(found):
        return found, n, n > 0
    return found, np.add.reduceat(n[order], first), np.maximum.reduceat(n[order], first) > 0


def pair_counts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    codes = block.codes()
    some = codes >= 0
    return _summed(codes[some], block.n[block.owners()[some]])[:2]


def runs(block: Block, candidates: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Distinct runs of one length and how often they come, length by length."""
    hit = _places(candidates, block.codes()) >= 0
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    first, stop = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) + 1
    n = block.n[block.owners()[first]]
    length = stop - first
    for size in np.unique(length):
        own = length == size
        rows = np.ascontiguousarray(block.symbols[first[own][:, None] + np.arange(size)].astype("<i4"))
        found, at = np.unique(rows.view(np.dtype((np.void, 4 * int(size)))).reshape(-1), return_inverse=True)
        yield [x.tobytes() for x in found], np.bincount(at, weights=n[own]).astype(np.int64)


def apply(block: Block, pairs: np.ndarray, ranks: np.ndarray, symbols: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """The block after merges, in the order of their ranks, and the pairs whose counts change: codes, sums, and whether any came anew.

    ``pairs`` are sorted codes.  Each pass merges in every word the pair of the lowest rank that it has.
    """
    done: list[Block] = []
    codes, changes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    left = block
    while True:
        own = _places(pairs, left.codes()) if len(left.symbols) else np.zeros(0, dtype=np.int64)
        owner = left.owners()
        live = np.zeros(len(left.sizes), dtype=bool)
        live[owner[own >= 0]] = True
        done.append(left.only(~live & (left.sizes > 1)))  # nothing can happen to one symbol
        if not live.any():
            break
        own, left = own[live[owner]], left.only(live)
        owner = left.owners()
        starts = np.cumsum(left.sizes) - left.sizes
        rank = np.where(own >= 0, ranks[own], np.iinfo(np.int64).max)
        match = (own >= 0) & (rank == np.minimum.reduceat(rank, starts)[owner])
        # in a row of one symbol matches overlap: every other one counts, from the left
        begins = match & ~np.concatenate(([False], match[:-1]))
        since = np.arange(len(match)) - np.maximum.accumulate(np.where(begins, np.arange(len(match)), 0))
        at = np.flatnonzero(match & (since % 2 == 0))
        s = left.symbols.astype(np.int64)
        new, n, word = symbols[own[at]].astype(np.int64), left.n[owner[at]], owner[at]
        a, b = s[at], s[at + 1]
        before = at > starts[word]
        after = at + 2 < (starts + left.sizes)[word]
        twice = np.concatenate(([False], (at[1:] == at[:-1] + 2) & (word[1:] == word[:-1])))
        prev = np.where(twice, new, s[at - 1])[before]
        follow = s[np.minimum(at + 2, len(s) - 1)][after]
        codes += [prev << 32 | a[before], prev << 32 | new[before], b[after] << 32 | follow, new[after] << 32 | follow]
        changes += [-n[before], n[before], -n[after], n[after]]
        s[at] = new
        stay = np.ones(len(s), dtype=bool)
        stay[at + 1] = False
        left = Block(s[stay].astype(np.int32), (left.sizes - np.bincount(word, minlength=len(left.sizes))).astype(np.int32), left.n)
    whole = Block(*[np.concatenate([getattr(d, c) for d in done]) for c in ("symbols", "sizes", "n")])
    return whole, *_summed(np.concatenate(codes), np.concatenate(changes))


BLOCK_SCHEMA = "symbols binary, sizes binary, n binary"


def _blocks(pieces: DataFrame, symbols: bytes) -> DataFrame:
    """(piece, n) as blocks; pieces of one symbol, which nothing can happen to, are left out."""

    def run(batches):
        words, n, held = [], [], 0
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(("symbols", "sizes", "n"), Block(np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words]), np.array(n)).packed()))])
        for b in batches:
            for piece, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                word = piece.encode().translate(symbols)
                if len(word) > 1:
                    words.append(word)
                    n.append(k)
                    held += len(word)
                if held >= BLOCK:
                    yield row()
                    words, n, held = [], [], 0
        if words:
            yield row()

    return materialize(pieces.select("piece", "n").mapInArrow(run, BLOCK_SCHEMA), "bpe-blocks")


def _each(blocks: DataFrame, make, schema: str) -> DataFrame:
    """What ``make`` gives of each block, as arrays by column."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for row in zip(*[b.column(c) for c in ("symbols", "sizes", "n")]):
                for columns in make(Block.unpacked(*row)):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return blocks.select("symbols", "sizes", "n").mapInArrow(run, schema)


def _merged_blocks(blocks: DataFrame, done: list[tuple[str, int]]) -> DataFrame:
    """The blocks after merges, each with the pairs whose counts it changes."""
    code = np.array([ord(p[0]) << 32 | ord(p[1]) for p, _ in done], dtype=np.int64)
    order = np.argsort(code)
    plan = blocks.sparkSession.sparkContext.broadcast((code[order], order.astype(np.int64), np.array([s for _, s in done], dtype=np.int64)[order]))  # the merges of a round

    def make(block: Block):
        after, codes, sums, up = apply(block, *plan.value)
        yield [pa.array([x], pa.binary()) for x in (*after.packed(), codes.astype("<i8").tobytes(), sums.astype("<i8").tobytes(), up.tobytes())]

    return materialize(_each(blocks, make, f"{BLOCK_SCHEMA}, codes binary, sums binary, up binary"), "bpe-blocks")


def _changes(blocks: DataFrame) -> DataFrame:
    """code, n, queued of what the last merges changed."""

    def run(batches):
        for b in batches:
            for codes, sums, up in zip(*[b.column(k) for k in range(3)]):
                arrays = [np.frombuffer(x.as_buffer(), dtype=t) for x, t in ((codes, "<i8"), (sums, "<i8"), (up, bool))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["code", "n", "queued"])

    return blocks.select("codes", "sums", "up").mapInArrow(run, "code long, n long, queued boolean")


def learn_merges(counts: DataFrame, entries: int, min_frequency: int, runs_held: int = RUNS) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges of byte-level BPE from (piece, n), a piece standing for all of its n occurrences."""
    bounded_arrow_batches(counts.sparkSession)
    names, symbols = byte_symbols()
    state = Merges(names, entries, min_frequency)
    counts = materialize(counts, "bpe-pieces")
    if counts.count() <= runs_held:  # all pieces are few enough to be their own runs
        state.learn((piece.encode().translate(symbols).decode("latin-1"), n) for piece, n in counts.toLocalIterator())
        discard(counts)
        return state.ids, state.pairs()
    blocks = _blocks(counts, symbols)
    discard(counts)
    table = materialize(_each(blocks, lambda b: [pair_counts(b)], "code long, n long").groupBy("code").agg(F.sum("n").alias("n"), F.lit(True).alias("queued")), "bpe-pairs")
    most = CANDIDATES
    while not state.ended:
        blocks, table, most = _round(state, blocks, table, most, runs_held)
    discard(blocks, table)
    return state.ids, state.pairs()


def _word(code: int) -> str:
    return chr(code >> 32) + chr(code & 0xFFFFFFFF)


def _round(state: Merges, blocks: DataFrame, table: DataFrame, most: int, runs_held: int) -> tuple[DataFrame, DataFrame, int]:
    """Merges as far as ``most`` candidates carry; blocks, pair counts and candidates of the next round."""
    spark = table.sparkSession
    able = table.where(F.col("queued") & (F.col("n") >= max(1, state.least)))
    top = [(r.code, r.n) for r in able.orderBy(F.desc("n"), "code").limit(most).select("code", "n").collect()]  # ``most`` rows
    if not top:
        state.ended = True
        return blocks, table, most
    while True:
        shared = spark.sparkContext.broadcast(np.sort(np.array([c for c, _ in top], dtype=np.int64)))
        found = _each(blocks, lambda b: runs(b, shared.value), "run binary, n long").groupBy("run").agg(F.sum("n").alias("n")).limit(runs_held + 1).toArrow()  # noqa: B023
        if found.num_rows <= runs_held or len(top) == 1:
            break
        most = max(1, len(top) // 4)
        top = top[:most]
    whole = len(top) < most
    last = None if whole else (-top[-1][1], _word(top[-1][0]))
    words = (("".join(map(chr, np.frombuffer(run, dtype="<i4").tolist())), n) for run, n in zip(found.column("run").to_pylist(), found.column("n").to_pylist()))
    done = state.learn(words, {_word(c): n for c, n in top}, last)
    if not done or len(state.names) >= state.entries:
        state.ended = True
        return blocks, table, most
    state.ended = False  # a reused number may have ended the round, not the work
    after = _merged_blocks(blocks, done)
    gone = spark.createDataFrame([(ord(p[0]) << 32 | ord(p[1]),) for p, _ in done], "gone long")
    sums = table.unionByName(_changes(after)).groupBy("code").agg(F.sum("n").alias("n"), F.bool_or("queued").alias("queued"))
    sums = sums.where("n <> 0").join(F.broadcast(gone), F.col("code") == F.col("gone"), "left")
    new = materialize(sums.select("code", "n", (F.col("queued") & F.col("gone").isNull()).alias("queued")), "bpe-pairs")
    discard(blocks, table)
    return after, new, most * 4 if found.num_rows * 4 < runs_held and not whole else most
