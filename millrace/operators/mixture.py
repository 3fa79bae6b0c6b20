"""Weighted mixture of sources into one order.

``stride`` gives each document a virtual time, the length its source has sent
before it divided by the source's weight, and orders by that: token shares hold by
construction, without random numbers, up to one document per source.  ``replay``
repeats a seeded weighted draw instead; it needs lengths only.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import global_rank
from millrace.plans.prefix import joined_back, running_sum, running_sums
from millrace.plans.scratch import fresh_path, materialize

#: Lengths that a part of a replay holds at most.
HELD = 1 << 21
UNITS = {"chars": F.length, "bytes": F.octet_length}


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    if not weights:
        raise ValueError("a mixture needs sources")
    if min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    whole = sum(weights.values())
    return {k: v / whole for k, v in weights.items()}


def weight_of(weights: Mapping[str, float], source: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[source]


def with_length(df: DataFrame, unit: str | Column = "chars", text_col: str = "text") -> DataFrame:
    """Adds ``len`` in characters, bytes, documents (always 1) or an expression of one's own."""
    if isinstance(unit, Column):
        return df.withColumn("len", unit.cast("long"))
    if unit == "documents":
        return df.withColumn("len", F.lit(1).cast("long"))
    if unit not in UNITS:
        raise ValueError(f"unit is chars, bytes or documents, not {unit!r}")
    return df.withColumn("len", UNITS[unit](text_col).cast("long"))


def stride(df: DataFrame, weights: Mapping[str, float], source: str = "source", order_by: str = "ord") -> DataFrame:
    """Adds ``pos``, the place in the mixture; rows of sources without weight go.

    ``df`` has ``len`` (``with_length``), and (source, order) name a row.  Both passes
    see these three columns only.
    """
    w = {k: v for k, v in weights.items() if v > 0}
    normalised(w)
    own = df.where(F.col(source).isin(*w))
    sent = running_sum(own.select(source, order_by, "len"), "len", [order_by], [source], "sent")
    timed = sent.withColumn("vt", F.col("sent").cast("double") / weight_of(w, F.col(source)))
    placed = global_rank(timed, ["vt", source, order_by], "pos").drop("sent")
    return placed if set(df.columns) == {source, order_by, "len"} else joined_back(own, placed, [source, order_by])


@dataclass
class Draws:
    """A seeded weighted draw between sources, as far as it has come: all that the next part needs.

    By ``token``, a source's chance is its weight over the mean length of what it
    has sent, 1.0 before the first; by ``document`` its weight.  A draw from an
    empty source takes it out and counts for nothing else.
    """

    share: dict[str, float]
    sizes: dict[str, int]
    weighting: str
    state: tuple
    names: list[str]
    sent: dict[str, int]
    total: dict[str, int]

    @classmethod
    def begin(cls, sizes: Mapping[str, int], weights: Mapping[str, float], seed: int, weighting: str = "token") -> Draws:
        if weighting not in ("token", "document"):
            raise ValueError(f"weighting is token or document, not {weighting!r}")
        share = normalised({k: weights[k] for k in sizes})
        return cls(share, dict(sizes), weighting, random.Random(seed).getstate(), list(sizes), dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0))

    def part(self, lengths: Mapping[str, Sequence[int]], most: int | None = None) -> list[tuple[str, int]]:
        """(source, ordinal) of the next ``most`` documents; ``lengths`` are those of each source's next ones, as many at least or all."""
        rng = random.Random()
        rng.setstate(self.state)
        share, sent, total, names = self.share, self.sent, self.total, self.names
        first = dict(sent)
        out: list[tuple[str, int]] = []
        while names and (most is None or len(out) < most):
            if self.weighting == "token":
                chance = [share[s] / (total[s] / sent[s] if sent[s] else 1.0) for s in names]
            else:
                chance = [share[s] for s in names]
            s = rng.choices(names, weights=chance)[0]
            if sent[s] == self.sizes[s]:
                names.remove(s)
                continue
            out.append((s, sent[s]))
            total[s] += lengths[s][sent[s] - first[s]]
            sent[s] += 1
        self.state = rng.getstate()
        return out


def replay_draws(lengths: Mapping[str, list[int]], weights: Mapping[str, float], seed: int, weighting: str = "token") -> list[tuple[str, int]]:
    """(source, ordinal) in the order of a seeded weighted draw; see ``Draws``."""
    return Draws.begin({s: len(x) for s, x in lengths.items()}, weights, seed, weighting).part(lengths)


def replay(df: DataFrame, weights: Mapping[str, float], seed: int, weighting: str = "token", source: str = "source", order_by: str = "ord", held: int = HELD) -> DataFrame:
    """Adds ``pos`` by the seeded draw.

    The draw is one sequence by definition.  It is replayed in parts, one task after the
    other: a part sees ``held`` lengths at most, those of the next documents of each
    source, and hands on the generator's state and what each source has sent.  Texts are
    joined back by a shuffle.
    """
    spark = df.sparkSession
    own = df.where(F.col(source).isin(*weights))
    ranked = materialize(global_rank(own.select(source, order_by, "len"), [order_by], "nth", [source]), "replay-ranks")
    sizes = {r[0]: r[1] for r in ranked.groupBy(source).count().collect()}  # a row a source that has a weight
    draws = Draws.begin({s: sizes.get(s, 0) for s in weights}, weights, seed, weighting)
    step = max(1, held // len(weights))
    folder, done, k = fresh_path(spark, "replay-order"), 0, 0
    schema = "source string, nth long, pos long, state binary"
    while draws.names:
        near = F.lit(False)
        for s in draws.names:
            near = near | ((F.col(source) == s) & F.col("nth").between(draws.sent[s], draws.sent[s] + step - 1))
        after = _replay_part(ranked.where(near).select(F.col(source).cast("string").alias("source"), "nth", F.col("len").cast("long").alias("len")), draws, step, done)
        path = f"{folder}/part={k}"
        after.write.parquet(path)
        draws = pickle.loads(spark.read.schema(schema).parquet(path).where("state is not null").first().state)
        done, k = sum(draws.sent.values()), k + 1
    order = spark.read.schema(schema + ", part int").parquet(folder).where("state is null").select(F.col("source").alias("__s"), F.col("nth").alias("__n"), "pos") if k else spark.createDataFrame([], "__s string, __n long, pos long")
    placed = ranked.join(order, (F.col(source) == F.col("__s")) & (F.col("nth") == F.col("__n"))).drop("__s", "__n", "nth")
    return placed if set(df.columns) == {source, order_by, "len"} else joined_back(own, placed, [source, order_by])


def _replay_part(rows: DataFrame, draws: Draws, most: int, done: int) -> DataFrame:
    """source, nth, pos of the next part; and one row with the state after it."""
    spark = rows.sparkSession
    begin = spark.createDataFrame([(None, None, None)], "source string, nth long, len long")  # so that an empty part has a task too

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["source"].notna()].sort_values("nth")
        lengths = {s: x["len"].astype("int64").tolist() for s, x in pdf.groupby("source")}
        order = draws.part(lengths, most)
        out = pd.DataFrame({"source": [s for s, _ in order], "nth": [n for _, n in order], "pos": range(done, done + len(order)), "state": None})
        return pd.concat([out.astype(object), pd.DataFrame([{"source": None, "nth": None, "pos": None, "state": pickle.dumps(draws)}])])

    return rows.unionByName(begin).groupBy(F.lit(0).alias("all")).applyInPandas(draw, "source string, nth long, pos long, state binary")


def realised_shares(mixed: DataFrame, source: str = "source") -> DataFrame:
    """Documents, length and share of the length by source."""
    per = mixed.groupBy(source).agg(F.count(F.lit(1)).alias("docs"), F.sum("len").alias("length"))
    return per.withColumn("share", F.col("length") / F.sum("length").over(Window.partitionBy()))


def exhaustion(mixed: DataFrame, source: str = "source") -> DataFrame:
    """Where each source ends, and whether it is the first to."""
    ends = mixed.groupBy(source).agg(F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("docs"))
    return ends.withColumn("ends_first", F.col("last_pos") == F.min("last_pos").over(Window.partitionBy()))


def running_means(df: DataFrame, source: str = "source", order_by: str = "ord") -> DataFrame:
    """Adds ``mean_before``: the mean length of what the source sent before, 1.0 at first."""
    one = df.withColumn("one", F.lit(1))
    sums = running_sums(one, {"len_before": "len", "docs_before": "one"}, [order_by], [source])
    mean = F.when(F.col("docs_before") > 0, F.col("len_before") / F.col("docs_before")).otherwise(F.lit(1.0))
    return sums.withColumn("mean_before", mean).drop("one", "len_before", "docs_before")
