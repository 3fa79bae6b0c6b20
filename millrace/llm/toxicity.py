"""Toxicity by a linear classifier that is held to the same score when identity terms are swapped.

Features are a text's distinct words and their beginnings, each with the logarithm of
its count; so a few insults weigh the same in a short text as in a very long one.
The classifier is a logistic regression with an L1 penalty, and one term more: in
every labelled sentence that names a group, each identity term is swapped for the
others of its kind (and for the plain word for people), and the mean square of the
score's change is added to the loss, times ``FAIRNESS``.  A group that toxic texts
often mention thus gives no evidence by its name.

Fit: at most ``SAMPLE`` labelled documents a label, those with the smallest hashes of
their id, whole texts; features are counted on the executors, by batch and then by
Spark, and the ``FEATURES`` that tell the labels apart best are kept.  The matrix of
this bounded sample, not of the corpus, is fitted on the driver.  The score is the
probability of label 1 under the sample's balance of labels.

Defined cases: null and empty texts have no features and score by the intercept; rows
with null label or null id are not learned from; of several labels of an id the
largest counts; rows that repeat an id are learned from as often as they come; null
ids are not held out; with no labelled document every score is 0; with labels of one
kind only, the score is near that label for all; texts of any length are scored whole;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import bounded_arrow_batches, discard, materialize

#: Labelled documents learned from, for each label, and features of the classifier, at most.
SAMPLE, FEATURES = 4000, 1 << 15
#: Weights of the L1 penalty and of score changes under swaps.
SPARSITY, FAIRNESS = 3e-4, 1.0
#: Lengths of the beginnings of words, documents that a feature must be in, and steps of the fit.
HEADS, SUPPORT, STEPS = (4, 5, 6), 3, 400
REMEMBERED = 300_000
WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]+")
# Words for groups of people, by kind; each list begins with a word that names no group.
IDENTITIES = [
    ["people", "women", "men", "girls", "boys"],
    ["person", "woman", "man", "girl", "boy"],
    ["people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["personal", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["ordinary", "black", "white", "asian", "latino", "arab", "african", "european", "american", "mexican", "chinese", "indian"],
    ["ordinary", "gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["people", "immigrants", "refugees", "natives", "foreigners"],
    ["ordinary", "disabled", "deaf", "blind", "elderly", "young"],
    ["gens", "femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "athées", "immigrés", "réfugiés", "étrangers"],
    ["ordinaire", "noir", "blanc", "arabe", "asiatique", "africain", "européen", "homosexuel", "hétérosexuel"],
    ["leute", "frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "atheisten", "einwanderer", "flüchtlinge", "ausländer"],
    ["gewöhnlich", "schwarz", "weiß", "arabisch", "asiatisch", "afrikanisch", "europäisch", "schwul", "lesbisch"],
    ["personas", "mujeres", "hombres", "niñas", "niños", "musulmanes", "cristianos", "judíos", "ateos", "inmigrantes", "refugiados", "extranjeros"],
    ["corriente", "negro", "blanco", "árabe", "asiático", "africano", "europeo", "homosexual", "heterosexual"],
]
#: What a term may be swapped for.
SWAPS = {term: sorted({other for kind in IDENTITIES if term in kind[1:] for other in kind} - {term}) for kind in IDENTITIES for term in kind[1:]}


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    return (xxhash.xxh3_64_intdigest("=" + word), *[xxhash.xxh3_64_intdigest("^" + word[:k]) for k in HEADS if len(word) > k])


class Features:
    """Feature counts of texts; a worker remembers words."""

    def __init__(self, only: np.ndarray | None = None):
        """``only``: the sorted hashes to look for; all if None."""
        self.places = None if only is None else {h: k for k, h in enumerate(only.tolist())}
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        return found if self.places is None else tuple(self.places[h] for h in found if h in self.places)

    def counts(self, text: str | None) -> Counter:
        """By feature (its hash, or its place among those looked for): how often the text has it."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        out: Counter = Counter()
        for word, n in Counter(WORDS.findall(text.lower()) if text else ()).items():
            found = self.known.get(word)
            if found is None:
                found = self.known[word] = self._of(word)
            for f in found:
                out[f] += n
        return out


def swapped(sentence: str) -> list[str]:
    """The sentence, lower-cased, with all identity terms of each one's kind swapped, once for each other term."""
    low = sentence.lower()
    out = []
    for term in sorted(set(WORDS.findall(low)) & SWAPS.keys()):
        out += [WORDS.sub(lambda m: other if m[0] == term else m[0], low) for other in SWAPS[term]]  # noqa: B023
    return out


@dataclass
class Classifier:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -math.inf


@dataclass
class Matrix:
    """Rows of a sparse matrix, one after the other."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    size: int

    @classmethod
    def of(cls, columns: pa.ChunkedArray, values: pa.ChunkedArray) -> Matrix:
        n = pc.list_value_length(columns).to_numpy().astype(np.int64)
        return cls(np.repeat(np.arange(len(n), dtype=np.int32), n), pc.list_flatten(columns).to_numpy(), pc.list_flatten(values).to_numpy(), len(n))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each row with ``x`` by column."""
        return np.bincount(self.row, weights=self.value * x[self.column], minlength=self.size)

    def spread(self, x: np.ndarray, width: int) -> np.ndarray:
        """Of each column with ``x`` by row."""
        return np.bincount(self.column, weights=self.value * x[self.row], minlength=width)


def fit_weights(rows: Matrix, labels: np.ndarray, swaps: Matrix, times: np.ndarray, size: int, sparsity: float, fairness: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal steps, each weight with a step width of its own.

    ``swaps`` holds by how much swaps change features, and ``times`` how often each such change comes.
    """
    n = rows.size
    share = fairness * times / max(1.0, times.sum())
    steep = Matrix(swaps.row, swaps.column, np.abs(swaps.value), swaps.size)
    curve = rows.spread(rows.sums(np.ones(size)), size) / (4 * n) + steep.spread(2 * share * steep.sums(np.ones(size)), size) + 1e-6
    rate = (labels.sum() + 0.5) / (n + 1)
    w, b = np.zeros(size), math.log(rate / (1 - rate))
    z, zb, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows.sums(z) + zb, -500, 500)))
        off = (p - labels) / n
        slope = rows.spread(off, size) + swaps.spread(2 * share * swaps.sums(z), size)
        new = z - slope / curve
        new = np.sign(new) * np.maximum(np.abs(new) - sparsity / curve, 0)
        new_b = zb - 2 * off.sum()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


def fold(id_col: str):
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """label, text of the documents learned from."""
    own = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("label")).where(F.col("lid").isNotNull() & F.col("label").isin(0, 1))
    own = own.where(fold("lid") != 0).groupBy("lid").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("lid"))
    own = materialize(own, "toxic-own")
    sizes = dict(own.groupBy("label").count().collect())  # two rows
    # thinned by hash to about twice the bound, then ranked: what is sorted does not grow with the labels
    share = F.when(F.col("label") == 1, 2.0 * sample / max(1, sizes.get(1, 1))).otherwise(2.0 * sample / max(1, sizes.get(0, 1)))
    thin = own.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "lid"))
    chosen = materialize(thin.withColumn("place", place).where(F.col("place") <= sample).select("lid", "label"), "toxic-labels")  # 2 * sample rows
    discard(own)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("lid")).select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, sparsity: float = SPARSITY, fairness: float = FAIRNESS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    chosen = materialize(labelled_sample(docs, labels, sample, id_col, text_col, label_col), "toxic-sample")

    def count(batches):
        made = Features()
        for b in batches:
            found, marks = [], []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                here = np.fromiter(made.counts(text), dtype=np.uint64)
                found.append(here)
                marks.append(np.full(len(here), label, dtype=np.int64))
            hashes, at = np.unique(np.concatenate(found), return_inverse=True)
            toxic = np.bincount(at, weights=np.concatenate(marks), minlength=len(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(at, minlength=len(hashes))), pa.array(toxic)], names=["h", "docs", "toxic"])

    sizes = {x.label: x.n for x in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if not sizes:
        return Classifier()
    rate = sizes.get(1, 0) / sum(sizes.values())
    counted = chosen.mapInArrow(count, "h long, docs long, toxic long").groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")).where(F.col("docs") >= SUPPORT)
    apart = F.pow(F.col("toxic") - F.lit(rate) * F.col("docs"), 2) / F.col("docs")  # the chi-square of a feature but for a factor
    kept = counted.orderBy(apart.desc(), "h").limit(features).select("h").toArrow()  # ``features`` rows
    hashes = np.sort(kept.column("h").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(hashes)

    def rows(batches):
        made = Features(shared.value)
        for b in batches:
            kind, label, at, value = [], [], [], []
            for mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                put = [(0, {k: math.log1p(n) for k, n in made.counts(text).items()})]
                for sentence in SENTENCES.findall(text or ""):
                    others = swapped(sentence)
                    if others:
                        here = made.counts(sentence)
                        for other in others:
                            there = made.counts(other)
                            change = {k: math.log1p(there[k]) - math.log1p(here[k]) for k in here.keys() | there.keys() if here[k] != there[k]}
                            put += [(1, change)] if change else []
                for what, found in put:
                    kind.append(what)
                    label.append(mark)
                    order = sorted(found)
                    at.append(order)
                    value.append([found[k] for k in order])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(label, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["kind", "label", "at", "value"])

    made = materialize(chosen.mapInArrow(rows, "kind int, label int, at array<int>, value array<float>"), "toxic-rows")
    texts = made.where("kind = 0").select("label", "at", "value").toArrow()  # 2 * sample rows, or more if ids repeat
    swaps = made.where("kind = 1").groupBy("at", "value").agg(F.count(F.lit(1)).cast("double").alias("times")).toArrow()  # kinds of change: pairs of terms, counts in a sentence
    discard(chosen, made)
    matrices = [Matrix.of(x.column("at"), x.column("value")) for x in (texts, swaps)]
    weights, intercept = fit_weights(matrices[0], texts.column("label").to_numpy().astype(float), matrices[1], swaps.column("times").to_numpy(), len(hashes), sparsity, fairness, STEPS)
    used = weights != 0
    return Classifier(hashes[used], weights[used], intercept)


def toxicity(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # ``FEATURES`` numbers at most

    def run(batches):
        model = shared.value
        made = Features(model.hashes)
        weights = model.weights.tolist()
        for b in batches:
            sums = np.array([model.intercept + sum(weights[k] * math.log1p(n) for k, n in made.counts(t).items()) for t in b.column(2).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(sums, -700, 700)))
            score[~np.isfinite(sums)] = 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
