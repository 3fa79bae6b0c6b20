"""Orders and samples that do not depend on how rows are laid out."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.draws import SEGMENT, end_places, segments, slot_times
from millrace.plans.prefix import joined_back, running_sum
from millrace.plans.scratch import materialize


def seeded_key(seed: int, *columns: str) -> Column:
    """A pseudo-random but fixed key: SHA-256 of the seed and the columns."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def global_rank(df: DataFrame, order_by: Sequence[str], into: str = "pos", group_by: Sequence[str] = ()) -> DataFrame:
    """Adds the 0-based place of each row in the order, by a two-pass count."""
    counted = running_sum(df.withColumn("__one", F.lit(1)), "__one", order_by, group_by, into)
    return counted.drop("__one")


def hash_shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """A full shuffle: ``pos`` is the place by seeded hash of the key, which names a row."""
    slim = global_rank(df.select(seeded_key(seed, key).alias("__h"), key), ["__h", key], "pos").drop("__h")
    return slim if df.columns == [key] else joined_back(df, slim, [key])


def buffered_order(count: int, seed: int, buffer_size: int) -> list[int]:
    """Ordinals in the order of a bounded shuffle buffer.

    A full buffer gives up a random slot for each new item; the rest is shuffled at
    the end.  Only the count matters, so texts are not needed.
    """
    if buffer_size <= 1:
        return list(range(count))
    rng, held, out = random.Random(seed), [], []
    for i in range(count):
        if len(held) < buffer_size:
            held.append(i)
        else:
            k = rng.randrange(buffer_size)
            out.append(held[k])
            held[k] = i
    rng.shuffle(held)
    return out + held


def shuffled_files(files: Sequence[str], seed: int | None) -> list[str]:
    """Shard names in order, or shuffled from that order by a seed."""
    out = sorted(files)
    if seed is not None:
        random.Random(seed).shuffle(out)
    return out


def buffer_shuffle(df: DataFrame, seed: int, buffer_size: int, order_by: str, group_by: str, segment: int = SEGMENT) -> DataFrame:
    """Adds ``pos``: the place of each row after the buffer shuffle of its group.

    The same order as ``buffered_order`` gives each group's rows, as a relation: no task
    holds a list of a group's rows, but one as long as the buffer.  (group, order) name a row.
    """
    spark = df.sparkSession
    ranked = materialize(global_rank(df.select(group_by, order_by), [order_by], "__nth", [group_by]), "buffer-ranks")
    if buffer_size <= 1:
        placed = ranked.withColumn("pos", F.col("__nth"))
    else:
        sizes = materialize(ranked.groupBy(group_by).agg(F.count(F.lit(1)).alias("size")), "buffer-sizes")
        count = max(0, (sizes.agg(F.max("size")).first()[0] or 0) - buffer_size)
        states = segments(spark, seed, buffer_size, count, segment)
        times = slot_times(states, buffer_size, count, segment)
        ends = end_places(sizes, states, buffer_size, group_by, segment)
        own = sizes.select(F.col(group_by).alias("__g"), F.greatest(F.col("size") - buffer_size, F.lit(0)).alias("__drawn"))
        timed = ranked.join(times, F.col("__nth") == F.col("item")).join(own, F.col(group_by).eqNullSafe(F.col("__g"))).drop("__g")
        early = F.coalesce(F.col("leaves") < F.col("__drawn"), F.lit(False))
        left = timed.where(~early).join(ends.select(F.col(group_by).alias("__g"), F.col("slot").alias("__slot"), "place"), F.col(group_by).eqNullSafe(F.col("__g")) & (F.col("slot") == F.col("__slot")))
        columns = [group_by, order_by]
        placed = timed.where(early).select(*columns, F.col("leaves").alias("pos")).unionByName(left.select(*columns, (F.col("__drawn") + F.col("place")).alias("pos")))
    placed = placed.drop("__nth")
    return placed if set(df.columns) == {group_by, order_by} else joined_back(df, placed, [group_by, order_by])


def seeded_sample(df: DataFrame, n: int | None, seed: int, key: str) -> DataFrame:
    """``n`` rows without replacement, the same on any layout; all rows if n is None."""
    if n is None:
        return df
    return df.withColumn("__h", seeded_key(seed, key)).orderBy("__h", key).limit(n).drop("__h")


#: Hexadecimal digits that a histogram of keys goes by, and rows with one beginning that are ranked at most.
DIGITS, EDGE_ROWS = 4, 100_000


def split_smallest(keyed: DataFrame, takes: DataFrame, label: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keyed``, which has ``__h``, a hexadecimal hash: of each label the ``take`` smallest by (hash, key), and the others.

    ``takes`` has a row (label, take) for each label.  Beginnings of hashes are counted by
    label; that tells which rows are in and which out, but for those with the beginning at
    which a label's number is reached.  Only these are ranked; while they are many, a
    longer beginning is counted.  No label is sorted.
    """
    takes = takes.select(F.col(label).alias("__l"), F.col("take"), F.lit("").alias("__edge"))
    digits = 0
    while True:
        digits += DIGITS
        near = keyed.join(F.broadcast(takes), F.col(label).eqNullSafe(F.col("__l")) & F.col("__h").startswith(F.col("__edge")))  # a row a label
        counts = near.groupBy("__l", "take", F.substring("__h", 1, digits).alias("__head")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("__l").orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)  # 16^DIGITS rows at most
        reached = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where((F.col("before") < F.col("take")) & (F.col("take") < F.col("before") + F.col("n")))
        edges = materialize(reached.select("__l", (F.col("take") - F.col("before")).alias("take"), F.col("__head").alias("__edge"), "n"), "sample-edges")
        done = edges.where(F.col("n") > EDGE_ROWS).isEmpty() or digits >= 64
        found = [edges.drop("n")] if done else [edges.where(F.col("n") <= EDGE_ROWS).drop("n")]
        # labels whose numbers end between two beginnings: all up to the last one are in
        whole = counts.join(edges.select(F.col("__l").alias("__e")), F.col("__l").eqNullSafe(F.col("__e")), "left_anti")
        whole = whole.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < F.col("take")).groupBy("__l").agg(F.max("__head").alias("__edge"))
        found.append(whole.select("__l", F.lit(None).cast("long").alias("take"), "__edge"))
        cut = found[0].unionByName(found[1])
        cuts = cut if digits == DIGITS else cuts.unionByName(cut)  # noqa: F821
        if done:
            break
        takes = edges.where(F.col("n") > EDGE_ROWS).drop("n")
    cuts = materialize(cuts, "sample-cuts")
    own = keyed.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("__l")), "left")
    head = F.col("__h").substr(F.lit(1), F.length("__edge"))
    own = own.withColumn("__at", F.when(F.col("__edge").isNull(), 1).when(head < F.col("__edge"), 0).when(head > F.col("__edge"), 1).when(F.col("take").isNull(), 0).otherwise(2))
    edge = own.where("__at = 2").withColumn("__place", F.row_number().over(Window.partitionBy(label).orderBy("__h", key)))
    columns = keyed.columns
    inside = own.where("__at = 0").select(*columns).unionByName(edge.where(F.col("__place") <= F.col("take")).select(*columns))
    outside = own.where("__at = 1").select(*columns).unionByName(edge.where(F.col("__place") > F.col("take")).select(*columns))
    return inside, outside


def stratified_sample(df: DataFrame, n: int, seed: int, key: str, label: str, strict: bool = True) -> DataFrame:
    """``n // labels`` rows of each label, topped up to ``n`` from the rest.

    ``picked`` tells how: ``stratum`` or ``top-up``.  With ``strict``, a label that
    has too few rows is an error.
    """
    spark = df.sparkSession
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per label
    if not sizes:
        return df.withColumn("picked", F.lit("stratum"))
    per = n // len(sizes)
    short = sorted(str(k) for k, c in sizes.items() if c < per)
    if short and strict:
        raise ValueError(f"labels with fewer than {per} rows: {', '.join(short)}")
    keyed = df.withColumn("__h", seeded_key(seed, key))
    kind = df.schema[label].dataType.simpleString()
    first, rest = split_smallest(keyed, spark.createDataFrame([(k, per) for k in sizes], f"{label} {kind}, take long"), label, key)
    more = max(0, n - sum(min(per, c) for c in sizes.values()))
    every = rest.withColumn("__all", F.lit(0))
    rest = split_smallest(every, spark.createDataFrame([(0, more)], "__all int, take long"), "__all", key)[0].drop("__all")
    return first.withColumn("picked", F.lit("stratum")).unionByName(rest.withColumn("picked", F.lit("top-up"))).drop("__h")
