"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters of their normalised bytes, sorted
on disk inside each range, and a row is compared in full with its neighbours: a
group is a run of equal texts.  The splitters hold the first ``PREFIX``
characters, a hash of the whole text and the salt, so what the driver samples is
small however long texts are, and texts with one beginning spread all the same.

A text whose copies would overfill a range (counted beforehand by hash, with
map-side sums) is salted over all ranges; its few runs, at most one per salt, are
put together afterwards.  At most ``2 * ranges`` texts can be that frequent, so
that list and the result for it are broadcast.

Defined cases: null text is empty; a null id loses to any other; of rows that
repeat id and text, one stays; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import materialize, shuffle_partitions

PREFIX = 32
#: Copies below this number are never salted.
FEW = 32


def exact_groups(
    docs: DataFrame,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; and text_hash, xxhash64 of the text as given."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    given = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.xxhash64(given).alias("text_hash"), (normalise(given) if normalise else given).alias("body"))
    ranges = shuffle_partitions(docs.sparkSession)
    rows = rows.withColumn("h", F.xxhash64("body"))
    crowd = max(FEW, docs.count() // (2 * ranges))
    hot = rows.groupBy("h").count().where(F.col("count") > crowd).select(F.col("h").alias("hot_h"))
    hot = materialize(hot, "dedup-hot")  # at most 2 * ranges rows
    salt = F.when(F.col("hot_h").isNotNull(), F.pmod("rid", F.lit(ranges))).otherwise(F.lit(-1)).alias("salt")
    dealt = rows.join(F.broadcast(hot), rows["h"] == hot["hot_h"], "left").select("rid", "doc_id", "text_hash", "body", "h", salt, F.substring("body", 1, PREFIX).alias("head"))

    order = [F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last(), F.col("rid").asc()]
    ranged = dealt.repartitionByRange("head", "h", "salt")
    run = Window.partitionBy("head", "h", "salt", "body")
    first = run.orderBy(*order)
    runs = ranged.select(
        "rid", "doc_id", "text_hash", "h", "salt",
        F.sha2("body", 256).alias("text_sha256"),
        F.row_number().over(first).alias("place"),
        F.first("doc_id").over(first).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"),
    )
    runs = materialize(runs, "dedup-runs")

    group = Window.partitionBy("text_sha256")
    heads = runs.where((F.col("salt") >= 0) & (F.col("place") == 1))
    merged = heads.select(
        F.col("text_sha256").alias("sha"),
        F.row_number().over(group.orderBy(*order)).alias("nth"),
        F.sum("group_size").over(group).alias("all_copies"),
        F.col("doc_id").alias("stays"),
        F.col("rid").alias("stays_rid"),
    ).where("nth = 1")
    joined = runs.join(F.broadcast(merged), (F.col("salt") >= 0) & (F.col("text_sha256") == F.col("sha")), "left")
    split = F.col("sha").isNotNull()
    return joined.select(
        "doc_id",
        F.when(split, F.col("stays")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(split, F.col("all_copies")).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        F.when(split, F.col("rid") == F.col("stays_rid")).otherwise(F.col("place") == 1).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too."""
    return exact_groups(docs, keep, normalise, id_col, text_col).drop("text_hash")
