"""Budgets and shards along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import global_rank
from millrace.plans.prefix import joined_back, running_sums


def cut_to_budget(df: DataFrame, order_by: Sequence[str], budgets: dict[str, int]) -> DataFrame:
    """Rows up to and with the one at which the first budget is reached.

    ``budgets`` maps columns to their limits.  The first row always stays.  One pass
    over the order and the budgeted columns makes all sums.  Rows that ``order_by`` does
    not tell apart come in some order, each once.
    """
    slim = df.select(*order_by, *[c for c in budgets if c not in order_by], F.lit(1).alias("__one"))
    sums = running_sums(slim, {"__pos": "__one", **{f"__b{k}": c for k, c in enumerate(budgets)}}, order_by)
    keep = F.lit(True)
    for k, limit in enumerate(budgets.values()):
        keep = keep & (F.col(f"__b{k}") < limit)
    kept = sums.where((F.col("__pos") == 0) | keep)
    return kept.select(*df.columns) if set(df.columns) <= set(slim.columns) else joined_back(df, kept.select(*slim.drop("__one").columns), order_by)


def assign_shards(df: DataFrame, order_by: Sequence[str], per_shard: int) -> DataFrame:
    """Adds ``shard`` and the row's place in it."""
    placed = global_rank(df.select(*order_by), order_by, "__pos")
    placed = placed.withColumn("shard", F.floor(F.col("__pos") / per_shard).cast("long")).withColumn("in_shard", F.col("__pos") % per_shard).drop("__pos")
    return placed if df.columns == list(order_by) else joined_back(df, placed, order_by)


def totals(df: DataFrame, text_col: str = "text", tokens: str | None = None) -> DataFrame:
    """Documents, bytes, characters and, where a column is given, tokens."""
    sums = [F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.length(text_col).cast("long")), F.lit(0)).alias("chars")]
    return df.agg(*sums, *([F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")] if tokens else []))
