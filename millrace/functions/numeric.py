"""Schedules, sizes and score arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cosine_factor(step: Column, total: int, warmup_ratio: float, floor: float) -> Column:
    """Share of the peak rate: up in a line over the warm-up, then a cosine down to ``floor``."""
    warmup = max(1, int(total * warmup_ratio))
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    down = F.lit(floor) + F.lit(1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, step / F.lit(float(warmup))).when(step >= total, F.lit(floor)).otherwise(down)


def ffn_width(width: Column, kind: Column, multiple: int = 128) -> Column:
    """Gated layers take 8/3 of the width, others four times; rounded up to ``multiple``."""
    wanted = F.when(kind == "gelu", width * 4).otherwise(F.floor(width * 8 / 3))
    return (F.ceil(wanted / F.lit(multiple)) * multiple).cast("long")


def grad_accumulation(batch_tokens: Column, micro_batch: Column, context: Column, world: Column) -> Column:
    """Steps whose gradients are added up for a batch of ``batch_tokens``; 1 at least."""
    return F.greatest(F.lit(1), F.floor(batch_tokens / (micro_batch * context * world))).cast("long")


def flops_per_token(parameters: Column) -> Column:
    return parameters * 6


def kv_cache_bytes(layers: Column, kv_heads: Column, head_dim: Column, tokens: Column, batch: Column, bytes_each: int = 2) -> Column:
    return layers * kv_heads * head_dim * tokens * batch * (2 * bytes_each)


def rotary_angles(rows: DataFrame, position: str, dim: int, base: float = 10000.0) -> DataFrame:
    """pos, pair, cos, sin for each row's position and each pair of dimensions."""
    angle = F.col("pos") * F.pow(F.lit(base), -2.0 * F.col("pair") / dim)
    grid = rows.select(F.col(position).alias("pos"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dim // 2 - 1).cast("long"))).alias("pair"))
    return grid.select("pos", "pair", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def rotary_table(spark: SparkSession, positions: int, dim: int, base: float = 10000.0) -> DataFrame:
    """``rotary_angles`` of the positions from 0 on."""
    return rotary_angles(spark.range(positions), "id", dim, base)


def log_softmax_at(logits: Column, index: Column) -> Column:
    """Log probability of one entry of an array of logits, shifted by the maximum."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.element_at(logits, index + 1) - top - F.ln(total)


def perplexity(loss: Column, limit: float = 50.0) -> Column:
    return F.when(loss < limit, F.exp(loss)).otherwise(F.lit(math.inf))


def seen(token: Column, history: Column) -> Column:
    """Whether a token is among the different ones of a history."""
    return F.array_contains(F.array_distinct(history), token.cast("long"))


def repetition_penalty(score: Column, seen: Column, penalty: float) -> Column:
    return F.when(seen, F.when(score < 0, score * penalty).otherwise(score / penalty)).otherwise(score)


def keep_top_k(rows: DataFrame, k: int, group: str, score: str) -> DataFrame:
    """Rows whose score is among the k highest of their group; all ties of the k-th stay."""
    place = F.rank().over(Window.partitionBy(group).orderBy(F.desc(score)))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def keep_top_p(rows: DataFrame, p: float, group: str, score: str, tie: str) -> DataFrame:
    """Rows up to and with the one at which the summed softmax passes ``p``."""
    top = F.max(score).over(Window.partitionBy(group))
    weighed = rows.withColumn("_w", F.exp(F.col(score) - top))
    weighed = weighed.withColumn("_p", F.col("_w") / F.sum("_w").over(Window.partitionBy(group)))
    before = Window.partitionBy(group).orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, -1)
    return weighed.withColumn("_before", F.coalesce(F.sum("_p").over(before), F.lit(0.0))).where(F.col("_before") <= p).drop("_w", "_p", "_before")
