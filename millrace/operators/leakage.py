"""How much of a validation set has near copies in the training set.

Each document becomes a MinHash sketch: for ``K`` hash functions the smallest value over
its word shingles.  Sketches merge by their smaller values, so a document or a set may be
sketched in pieces.  The share of equal values estimates the Jaccard similarity, with a
standard error of sqrt(J (1 - J) / K).  Sketches are cut into bands; documents that agree
in a band are candidates, which two sets of similarity J are with a chance of
1 - (1 - J^rows)^bands.

Equal sketches are one candidate, however many documents have them.  A validation
document is first compared with a drawn training document of each of its bands, which
settles nearly all of a large group of copies, and only while it has found no near copy
with all others of its bands.  Estimates at or above the threshold count as near copies.

Defined cases: null and empty texts, and texts without a word, have no shingles and no
near copy; texts with fewer words than a shingle has are one shingle; very long texts are
sketched some shingles at a time; rows that repeat an id are documents of their own;
null ids may stand in any column; an empty side gives no near copy or no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import bounded_arrow_batches, discard, materialize

#: Values of a sketch, its bands, words of a shingle, and the similarity of near copies.
K, BANDS, SIZE, THRESHOLD = 128, 16, 5, 0.8
#: Turns of drawn training documents before all others are looked at, and shingles that are sketched at a time.
TURNS, AT_ONCE = 2, 4096
_SALTS = np.array([xxhash.xxh3_64_intdigest(b"sketch", k) for k in range(K)], dtype=np.uint64)
NONE = np.uint64((1 << 64) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """A hash of every run of ``size`` lower-cased words, distinct; all words where there are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    acc = _mixed(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(acc)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest value under each of ``K`` functions."""
    out = np.full(K, NONE)
    for k in range(0, len(hashes), AT_ONCE):
        out = merged(out, _mixed(hashes[k : k + AT_ONCE, None] ^ _SALTS).min(axis=0))
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both sets together."""
    return np.minimum(a, b)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimate of the Jaccard similarity, and its standard error."""
    j = float((a == b).mean())
    return j, float(np.sqrt(j * (1 - j) / len(a)))


def band_keys(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(part.tobytes(), k) for k, part in enumerate(np.split(s, bands))], dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, keep: list[str], text_col: str = "text", size: int = SIZE, bands: int = BANDS) -> DataFrame:
    """The columns to keep, n_words, n_shingles, and of documents with shingles sketch (binary) and keys (of its bands)."""
    bounded_arrow_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for b in batches:
            words, n, made, keys = [], [], [], []
            for text in b.column(len(keep)).to_pylist():
                h = shingle_hashes(text, size)
                s = sketch(h)
                words.append(len(text.split()) if text else 0)
                n.append(len(h))
                made.append(s.tobytes() if len(h) else None)
                keys.append(band_keys(s, bands).tolist() if len(h) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(made, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[*keep, "n_words", "n_shingles", "sketch", "keys"])

    return rows.mapInArrow(run, f"{schema}, n_words long, n_shingles long, sketch binary, keys array<long>")


def _near(pairs: DataFrame, asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Of (v, t), places of different sketches, those that reach the threshold, with the estimate and its error."""
    left = pairs.join(asked.select(F.col("digest").alias("d"), F.col("sketch").alias("a")), F.col("v") == F.col("d")).drop("d")
    both = left.join(known.select(F.col("digest").alias("d"), F.col("sketch").alias("b")), F.col("t") == F.col("d")).select("v", "t", "a", "b")

    def run(batches):
        for batch in batches:
            found = [similarity(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([j for j, _ in found], pa.float64()), pa.array([e for _, e in found], pa.float64())], names=["v", "t", "similarity", "error"])
            yield out.filter(pa.array([j >= threshold for j, _ in found], pa.bool_()))

    return both.mapInArrow(run, "v binary, t binary, similarity double, error double")


def leaked_documents(docs: DataFrame, validation: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), size: int = SIZE, bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """Of each validation row: its id and kept columns, n_words, n_shingles, leaked, partner_id (the smallest id of a training sketch found), similarity and error."""
    columns = [id_col, *keep, "is_val"]
    rows = materialize(sketches(docs.withColumn("is_val", F.coalesce(validation, F.lit(False))), columns, text_col, size, bands).withColumn("digest", F.unhex(F.sha2("sketch", 256))), "leak-sketches")
    digests = lambda side: rows.where(side & F.col("digest").isNotNull()).groupBy("digest").agg(F.min(id_col).alias("least"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    asked = materialize(digests(F.col("is_val")).drop("least"), "leak-asked")
    wanted = materialize(asked.select(F.col("digest").alias("v"), F.explode("keys").alias("key")), "leak-keys")
    known = materialize(digests(~F.col("is_val")), "leak-known")
    shared = known.select(F.col("digest").alias("t"), F.explode("keys").alias("key")).join(wanted.select("key").distinct(), "key", "left_semi")
    shared = materialize(shared, "leak-shared")
    found = materialize(_near(asked.join(known.select(F.col("digest").alias("t")), F.col("digest") == F.col("t")).select(F.col("digest").alias("v"), "t"), asked, known, threshold), "leak-equal")
    for turn in range(TURNS + 1):
        open_keys = wanted.join(found.select("v").distinct(), "v", "left_anti")
        if turn < TURNS:
            own = shared.groupBy("key").agg(F.min(F.struct(F.xxhash64("t", F.lit(turn)).alias("h"), "t")).alias("drawn")).select("key", "drawn.t")
        else:
            own = shared
        pairs = open_keys.join(own, "key").select("v", "t").distinct()
        more = materialize(_near(pairs, asked, known, threshold), "leak-found")
        found = found.unionByName(more)
    best = found.groupBy("v").agg(F.max(F.struct("similarity", "error", "t")).alias("best")).select("v", "best.*")
    named = materialize(best.join(known.select(F.col("digest").alias("d"), "least"), F.col("t") == F.col("d")).select("v", "similarity", "error", "least"), "leak-named")
    out = rows.where("is_val").join(named, F.col("digest") == F.col("v"), "left")
    discard(asked, wanted, shared)
    return out.select(id_col, *keep, "n_words", "n_shingles", F.col("v").isNotNull().alias("leaked"), F.col("least").alias("partner_id"), "similarity", "error")


def leakage(found: DataFrame, group: str) -> DataFrame:
    """By group: documents and words of the validation set, and how many of them have near copies in the training set."""
    hit = F.col("leaked")
    sums = found.groupBy(group).agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(hit).alias("leaked_docs"), F.sum("n_words").alias("words"), F.sum(F.when(hit, F.col("n_words")).otherwise(0)).alias("leaked_words"),
    )
    return sums.withColumn("leaked_share", F.col("leaked_words") / F.greatest(F.col("words"), F.lit(1)))
