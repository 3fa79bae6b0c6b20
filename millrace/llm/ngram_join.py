"""Exact Jaccard join on word shingles by universe partition and pigeonhole.

Two sets with Jaccard similarity num/den or more differ in at most

    H = (den - num) * (|X| + |Y|) // (den + num)

elements.  If hashing deals the universe of shingles to segments, and segment i is
given v_i + 1 units, H + 1 units in all, then some segment differs in at most v_i
elements.  Sets are indexed by the contents of their segments: as they are for
v_i = 0, and with each one element left out besides (the one-deletion
neighbourhood) for v_i = 1.  Two sets that share no indexed content cannot be
similar; those that share one are candidates and are compared in full.

* **Size bands.**  H depends on the sizes, so sizes fall in bands, each with its
  own segments; a set is indexed in its own band and in each lower one that a
  similar set may belong to.  Where similar sets cannot differ at all, one content,
  the whole set, brings equal sets of different words together.
* **Cost-based allocation.**  ``Band.plan`` weighs, for the number of sets there
  are, the contents written against the candidates expected, and chooses how many
  segments get one deletion.
* **Weak segments.**  A segment with few elements (``strong`` less one at most, or
  that few after a deletion) would put strangers together, so it is not indexed.
  ``spare`` units make up for them: a
  set whose weak segments take no more units than are spare is complete.  A set
  that has more is indexed once more under another hash, together with its like
  only, and so on; the last level indexes weak segments too.  A similar pair is
  thus found at the first level at which either of both is complete.
* **Verification.**  Texts of equal words (by a 128-bit digest) are joined
  beforehand, and only one of each class goes on.  Sets that share a content are
  compared with the smallest of them, the hub, so a group costs its size, not its
  square.  Sets of a content that lies in different components then are open, and
  common passages chain most of these together.  Similar sets share one of the first
  n - ceil(n * num / den) + 1 shingles in any order of all shingles; in one by how
  often they come in a sample, passages come last.  Open sets that share such a
  shingle are compared as pairs where up to ``PAIRED`` sets have it.  Of a shingle
  that more sets have, other hubs are
  drawn, a few comparisons for each open set a round, as long as rounds link enough.
  What is left of these is looked at in clusters, in blocks of bounded bytes and rows: first
  by bitmaps that bound the intersection from above, which breaks up the chains that
  common passages make, then in full, and only between components.  A component
  larger than a block has blocks of its own, which never meet each other.
* **Exactness.**  Hashes only propose: every link is accepted by comparing the two
  texts' shingles themselves (``shingles.Reference``).

Contents that very many sets share are salted: hubs are found per salt, and hubs of
hubs after.

Defined cases: null and empty texts have no shingles and link with nothing; rows
without or with a repeated id are documents of their own, and rows equal in id and
text cost one set however often they are repeated; very long texts are split into
words one at a time and take eight bytes a shingle; ties of hubs and of first rows go
to the smallest (id, row number); the component is named by its smallest id; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.shingles import Reference, mix, shingle_sets, split_sets, split_words, words_digest
from millrace.plans.prefix import running_sum
from millrace.plans.scratch import bounded_arrow_batches, discard, materialize, shuffle_partitions

LEVELS = 6
BAND_RATIO = 1.35
#: Share of the sets in a band that one more level may be needed for.
INCOMPLETE = 0.02
#: Planning only: the share of a set's shingles that other sets have by common
#: passages, the share of sets that have the same passage, and how many written
#: contents one comparison is worth.
COMMON, SPREAD, COMPARISON = 0.1, 1e-5, 4.0
#: Bytes of bitmaps, and of texts, in one block of a cluster, and rows in it.
BITMAP_BLOCK, TEXT_BLOCK, BLOCK_ROWS = 4 << 20, 8 << 20, 1024
#: Sets of one first shingle that are compared as pairs at most, open sets that are looked at for an order of shingles, and shingles it ranks.
PAIRED, LOOKED, RANKED = 64, 1 << 15, 1 << 20
#: Rounds of other hubs at most, hubs drawn in one, and the share of comparisons that must link for one more.
ROUNDS, DRAWS, WORTH = 3, 3, 0.1
#: Rows of two or three numbers that are broadcast at most; above it, both sides are shuffled.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Band:
    """Sizes low..high and how sets in it are dealt to segments."""

    number: int
    low: int
    high: int
    differ: int  # H
    deletions: int  # segments with v = 1; they come first
    exact: int  # segments with v = 0
    spare: int
    strong: int  # elements that an indexed content has at least

    @property
    def segments(self) -> int:
        return self.deletions + self.exact

    @staticmethod
    def plan(number: int, low: int, high: int, sets: int, num: int, den: int) -> Band:
        differ = (den - num) * (high + high * den // num) // (den + num)
        best = None
        for strong in (1, 2, 3):
            for share in (0, 0.25, 0.5, 0.75, 1):
                for spare in range(0, 12 + differ // 2):
                    units = differ + 1 + spare
                    deletions = int((units // 2) * share)
                    exact = units - 2 * deletions
                    k = low / (deletions + exact)
                    if deletions + exact > 1:
                        weak = exact * _below(k, strong) + 2 * deletions * _below(k, strong + 1)
                    else:
                        weak = 0.0
                    if _tail(weak, spare) > INCOMPLETE:
                        continue
                    meet = math.exp(k * (COMMON - 1)) - sum(_chance(k, x) * COMMON**x for x in range(strong))
                    written = exact + deletions * (1 + k)
                    cost = written + COMPARISON * sets * SPREAD * (exact * meet + deletions * (1 + k) * meet * COMMON)
                    if best is None or cost < best[0]:
                        best = cost, deletions, exact, spare, strong
                    break
        if best is None:
            best = 0, 0, differ + 1, 0, 1
        return Band(number, low, high, differ, *best[1:])


def _chance(mean: float, x: int) -> float:
    return math.exp(-mean) * mean**x / math.factorial(x)


def _below(mean: float, x: int) -> float:
    """Chance that a Poisson variable is below ``x``."""
    return sum(_chance(mean, k) for k in range(x))


def _tail(mean: float, most: int) -> float:
    """Chance that a Poisson variable exceeds ``most``."""
    term, total = math.exp(-mean), 0.0
    for i in range(most + 1):
        total += term
        term *= mean / (i + 1)
    return max(0.0, 1 - total)


def band_edges(top: int) -> list[tuple[int, int]]:
    edges, low = [], 1
    while low <= top:
        high = max(low, int(low * BAND_RATIO))
        edges.append((low, high))
        low = high + 1
    return edges


class Scheme:
    """All bands for a threshold; ``contents`` gives what a set is indexed by."""

    def __init__(self, num: int, den: int, sets: int):
        self.num, self.den, self.sets = num, den, sets
        self.bands: list[Band] = []

    def _upto(self, size: int) -> None:
        while not self.bands or self.bands[-1].high < size:
            low = self.bands[-1].high + 1 if self.bands else 1
            self.bands.append(Band.plan(len(self.bands), low, max(low, int(low * BAND_RATIO)), self.sets, self.num, self.den))

    def bands_of(self, size: int) -> list[Band]:
        """Bands of sets no larger than this one that may be similar to it."""
        self._upto(size)
        least = -(-size * self.num // self.den)
        out = []
        for b in reversed(self.bands):
            if b.low <= size and b.high >= least:
                out.append(b)
            if b.high < least:
                break
        return out

    def contents(self, s: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of all indexed segment contents of a set."""
        if not len(s):
            return np.zeros(0, dtype=np.uint64)
        return np.concatenate([np.zeros(0, dtype=np.uint64), *[self._in_band(s, b, seed) for b in self.bands_of(len(s))]])

    def _in_band(self, s: np.ndarray, b: Band, seed: int) -> np.ndarray:
        out = []
        m = b.segments
        for level in range(LEVELS):
            salt = np.uint64((seed * LEVELS + level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            e = mix(s ^ salt)
            seg = ((e >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.uint16 if m < 1 << 16 else np.int64)
            count = np.bincount(seg, minlength=m)
            order = np.argsort(seg, kind="stable")
            starts = np.concatenate(([0], np.cumsum(count)[:-1]))
            total = np.add.reduceat(np.append(e[order], np.uint64(0)), np.minimum(starts, len(e)))
            total[count == 0] = 0
            spread = m > 1
            units = spread * (int((count[b.deletions :] < b.strong).sum()) + 2 * int((count[: b.deletions] <= b.strong).sum()))
            whole = units <= b.spare
            all_of_it = not whole and level == LEVELS - 1
            last = whole or all_of_it
            mark = np.uint64((b.number * LEVELS + level) << 32) + np.arange(m, dtype=np.uint64)
            least = b.strong if spread and not all_of_it else 0
            out.append(mix(mix(mark ^ salt) + total)[count >= least])
            if b.deletions:
                left = seg[order] < b.deletions
                owner = seg[order][left].astype(np.int64)
                out.append(mix(mix(mark ^ salt)[owner] + total[owner] - e[order][left])[count[owner] > least])
            if last:
                break
        return np.unique(np.concatenate(out))


@lru_cache(maxsize=8)
def scheme(num: int, den: int, sets: int) -> Scheme:
    """One per worker and size of the task; ``sets`` is rounded, as plans need no more."""
    return Scheme(num, den, sets)


def _index(base: DataFrame, size: int, num: int, den: int, sets: int) -> DataFrame:
    """rid, doc_id, text_hash, n, key (digest of the words), sigs."""
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        sch = scheme(num, den, sets)
        for b in batches:
            n, keys, sigs = [], [], []
            for words, s in split_sets(b.column(3).to_pylist(), size):
                n.append(len(s))
                keys.append(words_digest(words))
                sigs.append(sch.contents(s).view(np.int64))
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in sigs]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *sigs])
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], names=["rid", "doc_id", "text_hash", "n", "key", "sigs"])

    return materialize(base.mapInArrow(run, f"rid long, doc_id {kind}, text_hash long, n long, key binary, sigs array<long>"), "jaccard-index")


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit per element, in four to eight times as many bits, a power of two."""
    size = max(64, 1 << (4 * len(s) - 1).bit_length() if len(s) else 64)
    cells = np.zeros(size, dtype=np.uint8)
    cells[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(cells, bitorder="little").view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in as few 64-bit words as a smaller one has."""
    while len(x) > words:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def most_common(x: np.ndarray, n_x: int, rows: np.ndarray, n_rows: np.ndarray, bits_rows: np.ndarray) -> np.ndarray:
    """No fewer than the set of bitmap ``x`` and each set of the equally wide bitmaps ``rows`` have in common.

    Beyond the shared bits, only elements that share a bit with another of their
    own set can be common.
    """
    spare = np.minimum(n_x - int(np.bitwise_count(x).sum()), n_rows - bits_rows)
    return np.bitwise_count(rows & x).sum(axis=1, dtype=np.int64) + spare


def _bounded(keys: DataFrame) -> DataFrame:
    """A broadcast where the number of rows, counted here, allows it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _similar(pairs: DataFrame, index: DataFrame, base: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by comparing their texts' shingles themselves.

    A ``b`` that very many pairs have is a skewed key of the last join, which
    adaptive execution splits; its text comes once per piece, and in a row.
    """
    sizes = index.select(F.col("rid").alias("r"), "n")
    sized = pairs.join(sizes, F.col("a") == F.col("r")).select("a", "b", F.col("n").alias("na"))
    sized = sized.join(sizes, F.col("b") == F.col("r")).where(F.least("na", "n") * den >= F.greatest("na", "n") * num)
    sized = materialize(sized.select("a", "b"), "jaccard-sized")
    texts = base.select("rid", "text")
    left = texts.join(_bounded(sized), F.col("rid") == F.col("a")).select("a", "b", F.col("text").alias("ta"))
    right = texts.join(_bounded(sized.select(F.col("b").alias("rid")).distinct()), "rid", "left_semi").select(F.col("rid").alias("rb"), F.col("text").alias("tb"))
    both = left.join(right, F.col("b") == F.col("rb")).select("a", "b", "ta", "tb")

    def run(batches):
        at, other = None, None
        for batch in batches:
            held = []
            for b, ta, tb in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if b != at:
                    at, other = b, Reference(split_words(tb), size)
                m, n, common = other.compare(split_words(ta))
                held.append(common * den >= (m + n - common) * num)
            yield batch.select([0, 1]).filter(pa.array(held, pa.bool_()))

    out = materialize(both.mapInArrow(run, "a long, b long"), "jaccard-links")
    discard(sized)
    return out


def _hubs(shared: DataFrame, hot: DataFrame, ranges: int) -> DataFrame:
    """From (sig, rid): the rows of contents that several sets share, with the smallest of these in reach.

    A hot content is one group per salt; ``sig`` then is a hash of both, and ``top`` the content's own.
    """
    top = F.col("hot_sig").alias("top")
    key = F.when(top.isNotNull(), F.xxhash64("sig", F.pmod("rid", F.lit(ranges)))).otherwise(F.col("sig")).alias("key")
    shared = shared.join(_bounded(hot), shared["sig"] == hot["hot_sig"], "left").select(key, "rid", top)
    group = Window.partitionBy("key")
    rows = shared.select("key", "rid", "top", F.min("rid").over(group).alias("hub"), F.count(F.lit(1)).over(group).alias("held"))
    rows = rows.where((F.col("held") > 1) | F.col("top").isNotNull())
    return materialize(rows.select(F.coalesce("top", "key").alias("sig"), "rid", "hub", F.col("top").isNotNull().alias("salted")), "jaccard-shared")


def _relabel(rows: DataFrame, roots: DataFrame, column: str, into: str) -> DataFrame:
    named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(named, F.col(column) == F.col("_node"), "left").withColumn(into, F.coalesce("_root", column)).drop("_node", "_root")


def similar_components(
    docs: DataFrame,
    size: int = 5,
    num: int = 8,
    den: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, first (one row of each component) and text_hash, for every row."""
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    base = materialize(base, "jaccard-texts", "zstd")
    rows = base.count()
    sets_about = 1 << max(10, rows.bit_length())
    ranges = shuffle_partitions(spark)
    indexed = _index(base, size, num, den, sets_about)
    index = materialize(indexed.drop("sigs"), "jaccard-rows")

    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))
    classes = index.where("n > 0").groupBy("key").agg(F.min(order).alias("rep"), F.count(F.lit(1)).alias("held")).where("held > 1")
    classes = materialize(classes.select(F.col("key").alias("of"), F.col("rep.rid").alias("rep")), "jaccard-classes")  # apart from the join, so that a key with very many rows can be split in it
    copies = materialize(index.join(_bounded(classes), F.col("key") == F.col("of")).where("rid <> rep").select("rid", "rep"), "jaccard-copies")

    nodes = indexed.where("n > 0").select("rid", "sigs").join(_bounded(copies.select("rid")), "rid", "left_anti")
    looked = nodes.where(F.pmod(F.xxhash64("rid"), F.lit(64)) == 0)
    often = looked.select(F.explode("sigs").alias("hot_sig")).groupBy("hot_sig").count().where(F.col("count") * 64 > max(1024, rows // (2 * ranges)))
    hot = materialize(often.select("hot_sig"), "jaccard-hot")  # at most (contents a set) * 2 * ranges rows
    shared = _hubs(nodes.select(F.explode("sigs").alias("sig"), "rid"), hot, ranges)
    discard(indexed, hot, classes)

    # each set with its smallest hub first; most other candidates then lie inside one component
    tops = shared.where("salted").select("sig", "hub").distinct()
    least = tops.groupBy("sig").agg(F.min("hub").alias("top"))
    over = tops.join(least, "sig").where("hub <> top").select(F.col("hub").alias("a"), F.col("top").alias("b"))
    one = shared.where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).unionByName(over).groupBy("a").agg(F.min("b").alias("b"))
    links = _similar(materialize(one, "jaccard-first"), index, base, size, num, den)
    roots = connected_components(links)
    contents = materialize(shared.select("sig", "rid").distinct(), "jaccard-contents")
    discard(shared)
    pairs, contents = _first_shared(contents, roots, base, size, num, den)
    close = _similar(pairs, index, base, size, num, den)
    discard(pairs)
    if not close.isEmpty():
        links = links.unionByName(close)
        discard(roots)
        roots = connected_components(links)
    many = not contents.isEmpty()
    for turn in range(ROUNDS if many else 0):
        asked = materialize(_other_hubs(contents, roots, turn), "jaccard-turn")
        compared = asked.count()
        found = _similar(asked, index, base, size, num, den) if compared else asked
        new = found.count() if compared else 0
        discard(asked)
        if new:
            links = links.unionByName(found)
            discard(roots)
            roots = connected_components(links)
        if new < max(1, WORTH * compared):
            break
    late = _within_clusters(contents, roots, index, base, size, num, den) if many else None
    if late is not None and not late.isEmpty():
        discard(roots)
        roots = connected_components(links.unionByName(late))

    node = index.select("rid", "doc_id", "text_hash", "n").join(copies, "rid", "left").withColumn("node", F.coalesce("rep", "rid"))
    named = materialize(_relabel(node, roots, "node", "root").select("rid", "doc_id", "text_hash", "n", "root"), "jaccard-named")
    discard(base, index, copies, contents, links, roots, *([late] if late is not None else []))
    first = named.groupBy("root").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("members"))
    many = first.where("members > 1").select(F.col("root").alias("r"), F.col("least.doc_id").alias("least_id"), F.col("least.rid").alias("least_rid"))
    many = materialize(many, "jaccard-many")  # apart from the join, so that a root with very many rows can be split in it
    out = named.join(_bounded(many), F.col("root") == F.col("r"), "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("r").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"),
        F.coalesce(F.col("least_rid") == F.col("rid"), F.lit(True)).alias("first"),
        "text_hash",
    )


def _ranking(opened: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come most often in a bounded sample of (rid, comp, text), sorted, and how often; at most ``RANKED``."""
    every = max(1, opened.count() // LOOKED)

    def run(batches):
        for b in batches:
            found = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_sets(b.column(0).to_pylist(), size)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["shingle", "n"])

    looked = opened.where(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).select("text").mapInArrow(run, "shingle long, n long")
    often = looked.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n")).limit(RANKED).toArrow()
    shingles, n = often.column("shingle").to_numpy().astype(np.uint64), often.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def first_shingles(s: np.ndarray, shingles: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first of a sorted set, in the order of (n or 0, hash), of which any similar set has one among its own first."""
    often = np.zeros(len(s), dtype=np.int64)
    if len(shingles):
        at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
        often = np.where(shingles[at] == s, n[at], 0)
    return s[np.argsort(often, kind="stable")[: len(s) - -(-len(s) * num // den) + 1]]


def _first_shared(contents: DataFrame, roots: DataFrame, base: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of the sets of a content that lies in several components: pairs (a, b) that share a first shingle, and (sig, rid) of such shingles that many sets have."""
    spark = base.sparkSession
    rows = _relabel(contents, roots, "rid", "comp")
    parted = rows.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select(F.col("sig").alias("s"))
    own = materialize(rows.join(parted, F.col("sig") == F.col("s")).select("rid", "comp").distinct(), "jaccard-open")
    texts = base.select(F.col("rid").alias("r"), "text")
    opened = texts.join(_bounded(own), F.col("r") == F.col("rid")).select("rid", "comp", "text")
    order = spark.sparkContext.broadcast(_ranking(opened, size))  # RANKED numbers

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(2).to_pylist(), size))
            firsts = [first_shingles(s, *order.value, num, den) for s in sets]
            held = [len(x) for x in firsts]
            columns = [np.repeat(x, held) for x in (b.column(0).to_numpy(), b.column(1).to_numpy(), np.array([len(s) for s in sets], dtype=np.int64))]
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *firsts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat, *columns)], names=["sig", "rid", "comp", "n"])

    firsts = materialize(opened.mapInArrow(run, "sig long, rid long, comp long, n long"), "jaccard-firsts")
    held = firsts.groupBy("sig").agg(F.count(F.lit(1)).alias("held"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    held = materialize(held.select(F.col("sig").alias("s"), "held"), "jaccard-held")
    met = materialize(firsts.join(_bounded(held), F.col("sig") == F.col("s")).drop("s"), "jaccard-met")
    discard(own, firsts, held)
    few = met.where(F.col("held") <= PAIRED)
    other = few.select(F.col("sig").alias("s"), F.col("rid").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"))
    near = F.least("n", "n_b") * den >= F.greatest("n", "n_b") * num
    pairs = few.join(other, (F.col("sig") == F.col("s")) & (F.col("rid") > F.col("b")) & (F.col("comp") != F.col("comp_b")) & near)
    pairs = materialize(pairs.select(F.col("rid").alias("a"), "b").distinct(), "jaccard-pairs")
    many = materialize(met.where(F.col("held") > PAIRED).select("sig", "rid"), "jaccard-many-sets")
    discard(met, contents)
    return pairs, many


def _parted(contents: DataFrame, roots: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(sig, rid, comp) with components so far, and of each content that is in several: s, and the hubs drawn this turn with their components."""
    rows = _relabel(contents, roots, "rid", "comp")
    drawn = [F.min(F.struct(F.xxhash64("rid", F.lit(turn * DRAWS + k)).alias("h"), F.col("rid"), F.col("comp"))).alias(f"hub{k}") for k in range(DRAWS)]
    groups = rows.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), *drawn).where("c0 <> c1")
    return rows, groups.select(F.col("sig").alias("s"), *[f"hub{k}" for k in range(DRAWS)])


def _other_hubs(contents: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set whose contents lie in several components, with drawn hubs of other components, one a draw."""
    rows, groups = _parted(contents, roots, turn)
    both = rows.join(groups, F.col("sig") == F.col("s"))
    near = [F.min(F.when(F.col("comp") != F.col(f"hub{k}.comp"), F.struct(F.xxhash64("sig", F.lit(turn * DRAWS + k)), F.col(f"hub{k}.rid").alias("rid")))).alias(f"b{k}") for k in range(DRAWS)]
    chosen = both.groupBy(F.col("rid").alias("a")).agg(*near)
    return chosen.select("a", F.explode(F.array(*[F.col(f"b{k}.rid") for k in range(DRAWS)])).alias("b")).where("b is not null").distinct()


def _within_clusters(contents: DataFrame, roots: DataFrame, index: DataFrame, base: DataFrame, size: int, num: int, den: int) -> DataFrame | None:
    """Links among sets that share a content but lie in different components so far."""
    rows, groups = _parted(contents, roots, ROUNDS)
    open_rows = materialize(rows.join(groups, F.col("sig") == F.col("s")).select("rid", "comp", F.col("hub0.rid").alias("hub")), "jaccard-open")
    if open_rows.isEmpty():
        discard(open_rows)
        return None
    chained = connected_components(open_rows.select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct())
    own = materialize(_relabel(open_rows.select("rid", "comp").distinct(), chained, "rid", "cluster"), "jaccard-clusters")
    discard(open_rows, chained)

    def bits(batches):
        for b in batches:
            sets = shingle_sets(b.column(4).to_pylist(), size)
            found = [(len(s), bitmap(s).tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["rid", "comp", "cluster", "n", "bits"])

    texts = base.select(F.col("rid").alias("r"), "text")
    whole = texts.join(_bounded(own), F.col("r") == F.col("rid")).select("rid", "comp", "cluster", F.lit(0).cast("long").alias("n"), "text")
    own = materialize(whole.mapInArrow(bits, "rid long, comp long, cluster long, n long, bits binary"), "jaccard-own")

    near = _compare(own, size, num, den, BITMAP_BLOCK, F.length("bits"))
    family = connected_components(near.unionByName(own.select(F.col("rid").alias("a"), F.col("comp").alias("b"))))
    parted = _relabel(own.drop("cluster"), family, "rid", "cluster")
    mixed = parted.groupBy("cluster").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select(F.col("cluster").alias("c"))
    left = materialize(parted.join(mixed, F.col("cluster") == F.col("c"), "left_semi"), "jaccard-families")
    discard(own, near, family)
    spoken = texts.join(_bounded(left), F.col("r") == F.col("rid")).select("rid", "comp", "cluster", "n", "bits", "text")
    out = _compare(materialize(spoken, "jaccard-spoken"), size, num, den, TEXT_BLOCK, F.length("bits") + F.octet_length("text"))
    discard(left)
    return out


def _compare(own: DataFrame, size: int, num: int, den: int, block_bytes: int, bytes_each: Column) -> DataFrame:
    """(a, b) of sets of one cluster that pass, less what other pairs already join.

    A set passes by its bitmap, and by its shingles if ``own`` has texts.  A cluster
    is cut into blocks of ``BLOCK_ROWS`` rows and ``block_bytes`` bytes at most but
    for one row, first by component where that fills a block, then by size; two
    blocks meet if they hold more than one component and their sizes are near enough.
    """
    full = "text" in own.columns
    many = own.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= BLOCK_ROWS)
    many = many.select(F.col("cluster").alias("mc"), F.col("comp").alias("big"))
    cost = F.greatest(bytes_each.cast("long"), F.lit(block_bytes // BLOCK_ROWS))
    slim = own.select("rid", "comp", "cluster", "n", cost.alias("cost")).join(_bounded(many), (F.col("cluster") == F.col("mc")) & (F.col("comp") == F.col("big")), "left")
    slim = slim.select("rid", "comp", "cluster", "n", "cost", F.coalesce("big", F.lit(-1)).alias("big"))
    placed = running_sum(slim, "cost", ["n", "rid"], ["cluster", "big"], "before")
    placed = materialize(placed.withColumn("block", F.floor(F.col("before") / block_bytes)), "jaccard-blocks")
    blocks = placed.groupBy("cluster", "big", "block").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.count_distinct("comp").alias("comps"))
    other = blocks.select(F.col("cluster").alias("c"), F.col("big").alias("big_j"), F.col("block").alias("j"), F.col("least_n").alias("least_j"), F.col("most_n").alias("most_j"))
    here, there = F.struct("big", "block"), F.struct("big_j", "j")
    apart = (here < there) & ((F.col("big") < 0) | (F.col("big") != F.col("big_j")))
    near = (F.col("most_n") * den >= F.col("least_j") * num) & (F.col("most_j") * den >= F.col("least_n") * num)
    meet = blocks.join(other, (F.col("cluster") == F.col("c")) & (apart | ((here == there) & (F.col("comps") > 1))) & near)
    ends = [F.struct(F.col("big").alias("big"), F.col("block").alias("block")), F.struct(F.col("big_j").alias("big"), F.col("j").alias("block"))]
    meet = meet.select(F.col("cluster").alias("c"), F.xxhash64("big", "block").alias("i"), F.xxhash64("big_j", "j").alias("k"), F.explode(F.array_distinct(F.array(*ends))).alias("member"))
    at = placed.select(F.col("rid").alias("pr"), F.col("cluster").alias("pc"), F.struct("big", "block").alias("place"))
    dealt = at.join(meet, (F.col("pc") == F.col("c")) & (F.col("place") == F.col("member"))).select("pr", "i", "k", F.xxhash64("place.big", "place.block").alias("block"))
    dealt = own.join(dealt, F.col("rid") == F.col("pr")).drop("pr")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _compare_blocks(table, key[1].as_py() != key[2].as_py(), size if full else 0, num, den)

    out = materialize(dealt.groupBy("cluster", "i", "k").applyInArrow(compare, "a long, b long"), "jaccard-near")
    discard(placed)
    return out


def _compare_blocks(table: pa.Table, crossing: bool, size: int, num: int, den: int) -> pa.Table:
    """All pairs of different components in one block, or across two, each row against a row of smaller size at once."""
    table = table.sort_by([("n", "ascending"), ("rid", "ascending")])
    rid, n, side = (table.column(c).to_numpy() for c in ("rid", "n", "block"))
    label = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
    bits = [np.frombuffer(x, dtype=np.uint64) for x in table.column("bits").to_pylist()]
    width = np.array([len(x) for x in bits])
    parts = [(v, np.flatnonzero(width == v)) for v in np.unique(width)]
    parts = [(v, at, np.stack([bits[k] for k in at])) for v, at in parts]
    counted = np.array([int(np.bitwise_count(x).sum()) for x in bits])
    texts = table.column("text").to_pylist() if size else []
    sets: dict[int, np.ndarray] = {}

    def hashed(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = next(shingle_sets([texts[k]], size))
        return sets[k]

    a, b = [], []
    for x in range(len(rid)):
        low = int(np.searchsorted(n, -(-int(n[x]) * num // den)))
        open_to = label[low:x] != label[x]
        if crossing:
            open_to &= side[low:x] != side[x]
        if not open_to.any():
            continue
        passed: list[np.ndarray] = []
        for v, at, rows in parts:
            near = np.flatnonzero((at >= low) & (at < x))
            near = near[open_to[at[near] - low]]
            if len(near):
                y = at[near]
                common = most_common(folded(bits[x], v), int(n[x]), rows[near], n[y], counted[y])
                passed.append(y[common * den >= (n[x] + n[y] - common) * num])
        whole = None
        for y in map(int, np.concatenate(passed) if passed else ()):
            if label[x] == label[y]:
                continue
            if size:
                common = len(np.intersect1d(hashed(x), hashed(y), assume_unique=True))
                if common * den < (int(n[x] + n[y]) - common) * num:
                    continue
                whole = whole or Reference(split_words(texts[x]), size)
                p, q, common = whole.compare(split_words(texts[y]))
                if common * den < (p + q - common) * num:
                    continue
            label[label == label[y]] = label[x]
            a.append(int(rid[x]))
            b.append(int(rid[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def ngram_join(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its number of shingles and its component's smallest id."""
    return similar_components(docs, size, num, den, id_col, text_col).drop("first", "text_hash")
