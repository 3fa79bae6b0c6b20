"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language, over the letters of lower-cased words
with their ends marked; letters inside codes with digits count only where a text has
nothing else.  The grams of all languages stand in one sorted array of hashes per
order, each with the languages that have it and their log probabilities, and no number
for the others; contexts have back-off weights in arrays of the same kind.  A word's
score is the same wherever it stands, so a worker remembers it.  The language with the
lowest cross-entropy per character is chosen.

Fit: whole texts of at most ``sample`` labelled documents per language, those with the
smallest hashes of (doc_id, text).  All their grams are counted on the executors, and
each language's model is made there from its own; what is broadcast grows with the
grams of that sample, whose bytes are counted before.  A fifth of the sample is kept
from the counts and calibrates the rejection.  It looks at the cross-entropy of a text
whose words may each be of the language that suits it best, less the mean cross-entropy
of those languages, so that a text of several known languages passes; and that in
deviations, where the variance has a part per document and a part that shrinks with the
number of characters.  A document is rejected if it lies more than ``REACH`` times as far out as the quantile
``TAIL`` of those held-out documents.

Defined cases: null text and text without a letter are ``und`` with score 0 and
rejected; with no labelled document every row is ``und``; rows with null ``lang``
are predicted but not learned from; null ids are not held out and not learned
from; ties go to the language first in order; a text of any length is scored whole;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shingles import mix
from millrace.plans.scratch import bounded_arrow_batches, discard, materialize

ORDER = 4
SAMPLE = 2000
#: A document is rejected beyond ``REACH`` times the quantile ``TAIL`` of held-out deviations.
TAIL, REACH = 0.999, 2.0
DISCOUNT = 0.75
UNKNOWN = "und"
LANGUAGES_BROADCAST = 10_000
#: Variance that any document has.
LEAST = 1e-6
#: Characters whose evidence the score counts; longer texts would all give 1.
EVIDENCE = 40
#: Bytes of models that are broadcast at most; a sample whose models take more is an error.
MODEL_BYTES = 1 << 30
#: Numbers a worker remembers of words before it starts anew, and numbers it makes at a time.
REMEMBERED, AT_ONCE = 1_000_000, 1 << 22
WORDS, RUNS = re.compile(r"\b[^\W\d_]+\b"), re.compile(r"[^\W\d_]+")
BEGIN, END = 1, 2  # code points that no letter has


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points; rows of different lengths differ."""
    h = np.full(len(codes), codes.shape[1], dtype=np.uint64)
    for k in range(codes.shape[1]):
        h = mix(h * np.uint64(0x100000001B3) + codes[:, k].astype(np.uint64) + np.uint64(1))
    return h


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of order ORDER of the words, and how many each word has."""
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    pad = ORDER - 1
    text = (chr(BEGIN) * pad).join(w + chr(END) for w in words)
    codes = np.frombuffer((chr(BEGIN) * pad + text).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    first = np.concatenate(([0], np.cumsum(counts + pad)[:-1]))
    at = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    return np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at], counts


def text_words(text: str | None) -> list[str]:
    """Lower-cased words; where there are none, the letters of codes; nothing if the text has no letter."""
    for kind in (WORDS, RUNS) if text else ():
        words = kind.findall(text.lower())
        if any(any(c.isalpha() for c in w) for w in words):
            return words
    return []


@dataclass
class Sparse:
    """Numbers by (hash, language): the languages and values of each hash stand together, hashes in order."""

    hashes: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        """parts: by language, its hashes and their values."""
        every = np.concatenate([h for h, _ in parts])
        order = np.argsort(every, kind="stable")
        hashes, starts = np.unique(every[order], return_index=True)
        language = np.repeat(np.arange(len(parts), dtype=np.uint16 if len(parts) < 1 << 16 else np.uint32), [len(h) for h, _ in parts])
        return cls(hashes, np.append(starts, len(every)), language[order], np.concatenate([v for _, v in parts])[order])

    @property
    def bytes(self) -> int:
        return self.hashes.nbytes + self.starts.nbytes + self.languages.nbytes + self.values.nbytes

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``h``, language and value of every entry that there is for it."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        rows = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, dtype=np.int64)
        first = self.starts[at[rows]]
        n = self.starts[at[rows] + 1] - first
        entry = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(rows) else first
        return np.repeat(rows, n), self.languages[entry], self.values[entry]


def language_levels(codes: np.ndarray, number: np.ndarray, letters: int) -> tuple[list[tuple[np.ndarray, ...]], float]:
    """The model of one language, from its distinct grams of order ORDER and how often each came.

    By order: gram hashes with log probabilities, context hashes with log back-off weights; and
    the log probability of a letter never seen.
    """
    levels = [(codes, number.astype(np.float64))]
    for _ in range(ORDER - 1):  # a shorter gram counts the different letters it was seen after
        shorter, kinds = np.unique(levels[0][0][:, 1:], axis=0, return_counts=True)
        levels.insert(0, (shorter, kinds.astype(np.float64)))
    out, floor = [], -math.log(letters)
    known_hashes, known_logs = np.zeros(0, dtype=np.uint64), np.zeros(0)
    for order, (grams, count) in enumerate(levels, start=1):
        heads, of = np.unique(grams[:, :-1], axis=0, return_inverse=True) if order > 1 else (np.zeros((1, 0), dtype=grams.dtype), np.zeros(len(grams), dtype=np.int64))
        of = of.reshape(-1)
        total = np.bincount(of, weights=count, minlength=len(heads))
        gamma = DISCOUNT * np.bincount(of, minlength=len(heads)) / total
        if order == 1:
            lower = np.full(len(grams), floor)
            floor += math.log(gamma[0])
        else:  # the end of a seen gram was seen itself
            lower = known_logs[np.searchsorted(known_hashes, gram_hash(grams[:, 1:]))]
        logs = np.log(np.maximum(count - DISCOUNT, 0) / total[of] + gamma[of] * np.exp(lower))
        hashes = gram_hash(grams)
        by_hash = np.argsort(hashes)
        known_hashes, known_logs = hashes[by_hash], logs[by_hash]
        out.append((known_hashes, known_logs, gram_hash(heads), np.log(gamma)))
    return out, floor


@dataclass
class KneserNey:
    """Models of several languages in common sorted hash arrays, which hold what the languages have and nothing else."""

    languages: list[str]
    grams: list[Sparse] = field(default_factory=list)  # by order - 1: log probabilities
    contexts: list[Sparse] = field(default_factory=list)  # by order - 1: log back-off weights
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log probability of a letter never seen
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))  # cross-entropy of held-out texts
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))  # mean and variances of their excess over what is expected
    per_text: np.ndarray = field(default_factory=lambda: np.zeros(0))
    per_letter: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reject: float = math.inf

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> KneserNey:
        """counts: by language, distinct grams of order ORDER and how often each came."""
        letters = len(np.unique(np.concatenate([c[:, -1] for c, _ in counts.values()]))) + 1
        return cls.joined({lang: language_levels(*counts[lang], letters) for lang in counts})

    @classmethod
    def joined(cls, models: dict[str, tuple[list[tuple[np.ndarray, ...]], float]]) -> KneserNey:
        names = sorted(models)
        model = cls(names, floor=np.array([models[x][1] for x in names]))
        for order in range(ORDER):
            model.grams.append(Sparse.of([models[x][0][order][:2] for x in names]))
            model.contexts.append(Sparse.of([models[x][0][order][2:] for x in names]))
        return model

    @property
    def bytes(self) -> int:
        return sum(x.bytes for x in self.grams + self.contexts)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last letter after the others, per language."""
        order = codes.shape[1]
        if order == 0:
            return np.tile(self.floor, (len(codes), 1))
        out = self.log_prob(codes[:, 1:])
        if order > 1:
            row, lang, weight = self.contexts[order - 1].find(gram_hash(codes[:, :-1]))
            out[row, lang] += weight
        row, lang, logs = self.grams[order - 1].find(gram_hash(codes))
        out[row, lang] = logs
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Per word: summed log probability by language, by how much the highest of them falls short of what is expected of its language, and its number of letters with the end."""
        codes, counts = word_grams(words)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        sums = np.add.reduceat(self.log_prob(codes), starts, axis=0)
        expected = self.mean[sums.argmax(axis=1)] if len(self.mean) else 0.0
        return np.column_stack((sums, sums.max(axis=1) + expected * counts, counts))


class Scorer:
    """Scores texts in a worker; remembers words."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages) + 2))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per letter by language, the excess over what is expected with each word in its best language, and letters."""
        split = [text_words(t) for t in texts]
        width = self.table.shape[1]
        if len(self.places) * width > REMEMBERED:
            self.places, self.table = {}, self.table[:0]
        new = list(set().union(*split).difference(self.places)) if split else []
        if new:
            at = len(self.places)
            self.places.update(zip(new, range(at, at + len(new))))
            ends = np.cumsum([(len(w) + 1) * width for w in new]) // AT_ONCE  # some words at a time, as each letter has a number a language
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(new)]
            self.table = np.concatenate([self.table, *[self.model.word_scores(new[i:j]) for i, j in zip(cuts, cuts[1:])]])
        sums = np.zeros((len(texts), self.table.shape[1]))
        for k, words in enumerate(split):
            if words:
                sums[k] = self.table[np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        n = sums[:, -1]
        entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        return entropy[:, :-1], entropy[:, -1], n


_scorers: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    if shared.id not in _scorers:
        _scorers.clear()
        _scorers[shared.id] = Scorer(shared.value)
    return _scorers[shared.id]


class _Shared:
    """A broadcast model with a name of its own, so a reused worker knows when it changed."""

    def __init__(self, spark, model: KneserNey):
        self.held = spark.sparkContext.broadcast(model)
        self.id = self.held._jbroadcast.id() if self.held._jbroadcast is not None else id(model)

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self) -> KneserNey:
        return self.held.value


def fold(id_col: str):
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, sample: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, part, text of at most ``sample`` learnable documents per language."""
    keyed = docs.select(F.col(lang_col).alias("lang"), fold(id_col).alias("part"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    keyed = keyed.where(F.col("lang").isNotNull() & (F.col("part") != 0) & F.col("text").isNotNull())
    known = materialize(docs.where(F.col(lang_col).isNotNull() & (fold(id_col) != 0)).groupBy(F.col(lang_col).alias("of")).count(), "lang-counts")
    if known.count() <= LANGUAGES_BROADCAST:
        known = F.broadcast(known)
    # thin out by hash to about twice the bound, then rank: no large group is ever sorted
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("count"))
    near = keyed.join(known, F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return near.withColumn("place", place).where(F.col("place") <= sample).select("lang", "part", "text")


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KneserNey | None:
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    chosen = materialize(labelled_sample(docs, sample, id_col, text_col, lang_col), "lang-sample")

    def grams(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                words = [w for x, t in zip(langs, texts) if x == lang for w in text_words(t)]
                if words:
                    found, number = np.unique(word_grams(words)[0], axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array([r.tobytes() for r in np.ascontiguousarray(found, dtype="<u4")], pa.binary()), pa.array(number, pa.int64())], names=["lang", "gram", "n"]
                    )

    parts = chosen.where("part <> 1").select("lang", "text").mapInArrow(grams, "lang string, gram binary, n long")
    counted = materialize(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    last = F.substring("gram", 4 * ORDER - 3, 4)
    letters = counted.agg(F.count_distinct(last)).first()[0] + 1

    def levels(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(table.column("gram").to_pylist()), dtype="<u4").reshape(-1, ORDER)
        found, floor = language_levels(codes, table.column("n").to_numpy(), letters)
        arrays = [[x.tobytes() for x in one] for one in found]
        return pa.table({"lang": [key[0].as_py()] * ORDER, "level": list(range(ORDER)), "floor": [floor] * ORDER, **{c: pa.array([x[k] for x in arrays], pa.binary()) for k, c in enumerate(("grams", "logs", "contexts", "weights"))}})

    # a task has the grams of one language, which its ``sample`` texts bound
    made = materialize(counted.groupBy("lang").applyInArrow(levels, "lang string, level long, floor double, grams binary, logs binary, contexts binary, weights binary"), "lang-models")
    size = made.agg(F.sum(F.length("grams") + F.length("logs") + F.length("contexts") + F.length("weights"))).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"the models of this sample take {size} bytes, more than {MODEL_BYTES}: choose a smaller sample")
    models: dict[str, tuple[list, float]] = {}
    for r in made.orderBy("lang", "level").toLocalIterator():
        held = models.setdefault(r.lang, ([], r.floor))[0]
        held.append(tuple(np.frombuffer(r[c], dtype=np.uint64 if c in ("grams", "contexts") else np.float64) for c in ("grams", "logs", "contexts", "weights")))
    model = KneserNey.joined(models) if models else None
    if model:
        _calibrate(chosen, model)
    discard(chosen, counted, made)
    return model


def _calibrate(chosen: DataFrame, model: KneserNey) -> None:
    """What is expected of the fifth left out: first its mean cross-entropy by language, then its excess over that."""
    model.mean = _moments(_excess(chosen, model), model)[0]
    scored = materialize(_excess(chosen, model), "lang-calibration")
    model.centre, model.per_text, model.per_letter = _moments(scored, model)
    spread = scored.sparkSession.createDataFrame(list(zip(model.languages, *([float(x) for x in v] for v in (model.centre, model.per_text, model.per_letter)))), "of string, centre double, per_text double, per_letter double")
    away = (F.col("ce") - F.col("centre")) / F.sqrt(F.col("per_text") + F.col("per_letter") / F.col("n") + LEAST)
    tail = scored.join(F.broadcast(spread), F.col("lang") == F.col("of")).agg(F.percentile(away, TAIL)).first()[0]  # a row a language is broadcast
    if tail is not None:
        model.reject = REACH * tail
    discard(scored)


def _excess(chosen: DataFrame, model: KneserNey) -> DataFrame:
    """lang, ce, n of the texts left out that have letters, in languages that have a model."""
    shared = _Shared(chosen.sparkSession, model)

    def score(batches):
        for b in batches:
            _, mixed, n = _scorer(shared).entropies(b.column(1).to_pylist())
            langs = [x if k and x in model.languages else None for x, k in zip(b.column(0).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(mixed), pa.array(n)], names=["lang", "ce", "n"])

    return chosen.where("part = 1").select("lang", "text").mapInArrow(score, "lang string, ce double, n double").where("lang is not null")


def _moments(scored: DataFrame, model: KneserNey) -> list[np.ndarray]:
    """By language: the mean by letter, and the variance by text and by letter; the average of the others where a language has no text."""
    means = scored.groupBy("lang").agg((F.sum(F.col("ce") * F.col("n")) / F.sum("n")).alias("mean"))
    off = scored.join(means, "lang").withColumn("sq", F.pow(F.col("ce") - F.col("mean"), 2))
    stats = off.groupBy("lang").agg(F.first("mean").alias("mean"), F.avg("sq").alias("per_text"), F.avg(F.col("sq") * F.least("n", F.lit(200.0))).alias("per_letter"))
    got = {r["lang"]: r for r in stats.collect()}  # a row a language
    out = []
    for k in ("mean", "per_text", "per_letter"):
        general = np.mean([r[k] for r in got.values()]) if got else 0.0
        out.append(np.array([got[x][k] if x in got else general for x in model.languages]))
    return out


def identify(docs: DataFrame, model: KneserNey | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every row; and text_hash, xxhash64 of the text."""
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = _Shared(spark, model) if model else None
    names = ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected", "text_hash"]

    def run(batches):
        for b in batches:
            size = b.num_rows
            lang, score = [UNKNOWN] * size, np.zeros(size)
            ce, rejected = np.full(size, np.nan), np.ones(size, dtype=bool)
            if shared is not None:
                m = _scorer(shared).model
                every, mixed, n = _scorer(shared).entropies(b.column(3).to_pylist())
                some = n > 0
                best = every.argmin(axis=1)
                at = np.arange(size)
                weight = np.exp((every[at, best][:, None] - every) * np.minimum(n, EVIDENCE)[:, None])
                score = np.where(some, 1 / weight.sum(axis=1), 0.0)
                ce = np.where(some, every[at, best], np.nan)
                away = (mixed - m.centre[best]) / np.sqrt(m.per_text[best] + m.per_letter[best] / np.maximum(n, 1) + LEAST)
                rejected = ~some | (away > m.reject)
                lang = [m.languages[k] if s else UNKNOWN for k, s in zip(best, some)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(rejected, pa.bool_()), b.column(2)], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean, text_hash long")


def language_id(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the labelled rows outside the held-out fold and predicts all rows."""
    model = fit(docs, sample, id_col, text_col, lang_col)
    return identify(docs, model, id_col, text_col).drop("text_hash")
