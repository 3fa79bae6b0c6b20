"""Interaction audit of filters by lattice edges.

What a filter removes depends only on which filters ran before it, not on their
order.  Five filters have 5 * 2^4 = 80 such edges (set of filters already applied,
next filter), and each of the 120 orders is a path of five edges through the lattice
of sets.  Documents are therefore summed once, by part and by the set of conditions
they fail; these sums contribute to the 80 edges, and the edges are joined to the 600
steps of the orders.  No document is looked at per order.

Texts are read once, for their failures and a digest.  Copies are found by an
aggregate on the digest that is summed map-side, so a text with very many copies
costs a row a task; only (digest, part, flags) sums are joined afterwards.

Defined cases: a null text is empty; a null part is the empty string, and joins rows
whose part is empty; a row without id fails no E and makes no other row fail it, and
has no labels; rows that repeat an id count each, and fail E only if a smaller id has
the text; of several labels of an id, 1 wins over 0 and null; texts are equal if their
SHA-256 digests are; very long texts are read whole; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.scratch import materialize

FILTERS = "ABCDE"
#: Fixed value: white space between words.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of labels that are broadcast at most; above it, both sides are shuffled.
BROADCAST_LABELS = 1_000_000


def text_failures(text: Column) -> Column:
    """Bits of A to D: too few words, repeated words, capitals, symbols."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    failed = lambda w: [
        F.size(w) < 50,
        F.lit(100) * F.size(F.array_distinct(w)).cast("long") < F.lit(65) * F.size(w).cast("long"),
        F.lit(100) * capitals.cast("long") > F.lit(5) * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failed(words))), F.lit(0))


def lattice_edges() -> Column:
    """The 80 edges: done (bits of the filters applied), next (bit) and orders (in how many orders it is)."""
    edges = []
    for k in range(len(FILTERS)):
        others = [j for j in range(len(FILTERS)) if j != k]
        for size in range(len(FILTERS)):
            orders = factorial(size) * factorial(len(others) - size)
            edges += [(sum(1 << j for j in some), 1 << k, orders) for some in combinations(others, size)]
    return F.array(*[F.struct(F.lit(done).alias("done"), F.lit(bit).alias("next"), F.lit(orders).alias("orders")) for done, bit, orders in edges])


def order_steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, at_done, at_next: the 600 steps as edges."""
    rows = []
    for order in permutations(FILTERS):
        done = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            rows.append(f"('{''.join(order)}', {k + 1}, {done}, {bit})")
            done |= bit
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(filter_order, step, at_done, at_next)")


def failure_counts(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, failed (bits of A to E), good, toxic, n: as many rows as kinds of documents there are in the parts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("failed"))
    flags = labels.select(F.col("doc_id").alias("lid"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where("lid is not null and (q or t)")
    flags = flags.groupBy("lid").agg(F.coalesce(F.bool_or("q"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("t"), F.lit(False)).alias("toxic"))
    flags = materialize(flags, "audit-labels")
    if flags.count() <= BROADCAST_LABELS:
        flags = F.broadcast(flags)
    # rows without id would all meet in one task: their digest deals them out
    rows = rows.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    flagged = rows.join(flags.withColumn("ldeal", F.lit(0).cast("long")), (F.col("id") == F.col("lid")) & (F.col("deal") == F.col("ldeal")), "left")
    flagged = flagged.select("id", "part", "digest", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kinds = ["part", "failed", "good", "toxic"]
    # by text and kind: rows, the smallest id and how many rows have it
    least = F.min("id").alias("least")
    same = flagged.groupBy("digest", *kinds, "id").agg(F.count(F.lit(1)).alias("rows"))
    same = same.groupBy("digest", *kinds).agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("rows")).otherwise(0)).alias("nameless"), least, F.min_by("rows", "id").alias("at_least"))
    same = materialize(same, "audit-texts")
    first = same.groupBy("digest").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(F.col("digest").alias("d"), "first")
    both = same.join(first, F.col("digest") == F.col("d"), "left")
    # a text of one kind has its smallest id among its own rows
    original = F.col("nameless") + F.when(F.col("least") == F.coalesce("first", "least"), F.col("at_least")).otherwise(0)
    copied = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.lit(0).alias("e"), original.alias("m")), F.struct(F.lit(copied).alias("e"), (F.col("n") - original).alias("m"))))
    parts = both.select("part", "failed", "good", "toxic", split.alias("s")).where("s.m > 0")
    return parts.groupBy("part", F.col("failed").bitwiseOR(F.col("s.e")).alias("failed"), "good", "toxic").agg(F.sum("s.m").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps, removes and loses."""
    spark = docs.sparkSession
    counts = materialize(failure_counts(docs, labels, part_col, id_col, text_col), "audit-counts")
    failed, done, bit = F.col("failed"), F.col("done"), F.col("next")
    fails, earlier = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(done) != 0
    removed = fails & ~earlier
    total = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    edges = counts.select("part", "failed", "good", "toxic", "n", F.explode(lattice_edges()).alias("edge")).select("part", "failed", "good", "toxic", "n", "edge.*")
    edges = edges.groupBy("part", "done", "next", "orders").agg(
        total(~fails & ~earlier, "kept"), total(removed, "removed"), total(fails & earlier, "redundant"), total(failed == bit, "unique_fails"),
        total(removed & F.col("good"), "good_lost"), total(removed & F.col("toxic"), "toxic_lost"),
    )
    edges = materialize(edges, "audit-edges")
    shares = edges.groupBy(F.col("part").alias("of"), F.col("next").alias("bit")).agg(F.sum(F.col("removed") * F.col("orders")).cast("long").alias("shapley"))
    valued = edges.join(shares, (F.col("part") == F.col("of")) & (F.col("next") == F.col("bit")))
    paths = valued.join(F.broadcast(order_steps(spark)), (F.col("done") == F.col("at_done")) & (F.col("next") == F.col("at_next")))
    return paths.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
