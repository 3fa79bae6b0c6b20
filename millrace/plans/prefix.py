"""Running sums over a global order without a one-task window.

``running_sums`` range-partitions rows on (group, order), fixes that layout as a
table together with the partition number, sums per (partition, group), and adds
the sums of the partitions before.  The only single-task window works on one row
per (partition, group) pair that a range partition really holds: partitions plus
groups, not rows.

All columns of the input travel through both shuffles, so callers pass keys and
lengths only and bring positions back to texts once, with ``joined_back``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import materialize


def running_sums(
    df: DataFrame,
    sums: Mapping[str, str],
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Adds, for each (into, value) of ``sums``, the sum of ``value`` over earlier rows of the same group.

    Rows of a group that ``order_by`` does not tell apart come in some order.  Nulls in
    a value count as 0; null group keys form a group of their own.
    """
    keys = [*group_by, *order_by]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *keys) if keys else df
    fixed = materialize(ranged.withColumn("__part", F.spark_partition_id()), "prefix")
    amount = {into: F.coalesce(F.col(value), F.lit(0)).cast("long") for into, value in sums.items()}
    totals = fixed.groupBy("__part", *group_by).agg(*[F.sum(x).alias(f"__total_{into}") for into, x in amount.items()])
    upto = Window.partitionBy(*group_by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group_by)], *[F.coalesce(F.sum(f"__total_{into}").over(upto), F.lit(0)).alias(f"__base_{into}") for into in sums])
    inner = Window.partitionBy("__part", *group_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = fixed.select("*", *[F.coalesce(F.sum(x).over(inner), F.lit(0)).alias(f"__local_{into}") for into, x in amount.items()])
    on = local["__part"] == bases["__p"]
    for i, g in enumerate(group_by):
        on = on & local[g].eqNullSafe(bases[f"__g{i}"])
    joined = local.join(bases, on, "left")
    return joined.select(*df.columns, *[(F.col(f"__local_{into}") + F.col(f"__base_{into}")).cast("long").alias(into) for into in sums])


def running_sum(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    into: str = "running_before",
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over earlier rows of the same group; see ``running_sums``."""
    return running_sums(df, {into: value}, order_by, group_by, partitions)


def joined_back(df: DataFrame, slim: DataFrame, keys: Sequence[str], unique: bool = False) -> DataFrame:
    """Rows of ``df`` that ``slim`` has, with its other columns; ``keys``, which may be null, name a row in both.

    Where keys repeat, which is looked for in ``slim`` unless they are known to be ``unique``, each row
    still comes once: rows are paired by all columns that both have, and one by one where these repeat too.
    """
    more = [c for c in slim.columns if c not in df.columns]
    common = list(keys)
    if not unique and not slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
        common += [c for c in slim.columns if c in df.columns and c not in keys]
        nth = F.row_number().over(Window.partitionBy(*common).orderBy(F.lit(0))).alias("__nth")
        df, slim = df.select("*", nth), slim.select("*", nth)
        common.append("__nth")
    right = slim.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(common)], *more)
    on = F.lit(True)
    for i, k in enumerate(common):
        on = on & df[k].eqNullSafe(right[f"__key{i}"])
    return df.join(right, on).drop("__nth", *[f"__key{i}" for i in range(len(common))])
