"""Connected components by alternating large and small stars.

Each step is one aggregation and one join on edges, written to the shared folder,
so neither edges nor components ever meet in one task or on the driver.  The
smallest neighbours are summed map-side and written too: the join then is one of
two plain shuffles, and adaptive execution splits a node with very many edges.
The tables of a step are deleted after the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import discard, materialize


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """edges: (a, b) with a > b.  Hangs neighbours on the smallest node around; the second frame is what it reads besides."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "cc-least")
    hung = near.join(least, F.col("u") == F.col("w"))
    if large:
        out = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.where("w <> m").select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct(), least


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node that links reach, for all nodes but the roots."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "cc-links")
    before = _digest(edges)
    while before[0]:
        hung, one = _star(edges, large=True)
        hung, two = _star(hung, large=False)
        after = materialize(hung, "cc-stars")
        discard(edges, one, two)
        edges = after
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
