"""Fixed-length blocks over the joined token streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.prefix import joined_back, running_sum
from millrace.plans.scratch import materialize


def pack_blocks(docs: DataFrame, block: int, order_by: str = "ord", tokens: str = "tokens", whole: bool = True) -> DataFrame:
    """block_id, tokens: the stream cut every ``block`` tokens; a last, shorter part is dropped unless ``whole`` is false.

    A document's place in the stream is a two-pass running sum of lengths, which sees
    no tokens; documents of one place come in some order.  Each document is cut into the parts that fall in different blocks, so
    what is shuffled are slices, not single tokens.  ``docs`` is read more than once, so
    it should be a table.
    """
    sized = docs.withColumn("__n", F.size(tokens).cast("long")).where(F.col("__n") > 0)
    placed = joined_back(sized, running_sum(sized.select(order_by, "__n"), "__n", [order_by], into="__at"), [order_by])
    last = F.floor((F.col("__at") + F.col("__n") - 1) / block)
    parts = placed.withColumn("block_id", F.explode(F.sequence(F.floor(F.col("__at") / block), last)))
    begin = F.greatest(F.col("block_id") * block, F.col("__at"))
    stop = F.least((F.col("block_id") + 1) * block, F.col("__at") + F.col("__n"))
    parts = parts.select("block_id", begin.alias("__begin"), F.slice(tokens, (begin - F.col("__at") + 1).cast("int"), (stop - begin).cast("int")).alias("__part"))
    joined = parts.groupBy("block_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__begin", "__part"))), lambda x: x["__part"])).alias("tokens"))
    return joined.where(F.size("tokens") == block) if whole else joined


def shard_of(blocks: DataFrame, rank: int, world: int, skip: int = 0) -> DataFrame:
    """Every ``world``-th block from ``rank`` on, without this shard's first ``skip``."""
    return blocks.where((F.col("block_id") % world == rank) & (F.floor(F.col("block_id") / world) >= skip))


def next_tokens(blocks: DataFrame) -> DataFrame:
    """block_id, pos, token, next: what each position of a block predicts."""
    pairs = F.arrays_zip(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))).alias("token"), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))).alias("next"))
    return blocks.select("block_id", F.posexplode(pairs).alias("pos", "pair")).select("block_id", "pos", "pair.token", "pair.next")


def next_token_counts(docs: DataFrame, block: int, order_by: str = "ord", tokens: str = "tokens") -> DataFrame:
    """token, next, n: how often each pair comes in ``next_tokens`` of whole blocks of ``block`` tokens.

    No block is put together: a document's place tells which of its neighbours lie in
    one block, and a token before the end of a document and the one after it meet by
    their place.  ``docs`` is read more than once, so it should be a table.
    """
    sized = docs.withColumn("__n", F.size(tokens).cast("long")).where(F.col("__n") > 0)
    sized = sized.withColumn("__first", F.get(tokens, F.lit(0))).withColumn("__last", F.get(tokens, F.size(tokens) - 1))
    slim = materialize(running_sum(sized.select(order_by, "__n", "__first", "__last"), "__n", [order_by], into="__at"), "blocks-places")
    whole = (slim.agg(F.sum("__n")).first()[0] or 0) // block * block
    more = F.greatest(F.size(tokens) - 1, F.lit(0))
    inside = F.arrays_zip(F.slice(tokens, 1, more).alias("token"), F.slice(tokens, 2, more).alias("next"))
    pairs = joined_back(sized, slim, [order_by]).select("__at", F.posexplode(inside).alias("__pos", "pair"))
    pairs = pairs.select((F.col("__at") + F.col("__pos") + 1).alias("at"), "pair.token", "pair.next")
    ends = slim.select((F.col("__at") + F.col("__n")).alias("at"), F.col("__last").alias("token"))
    across = ends.join(slim.select(F.col("__at").alias("begin"), F.col("__first").alias("next")), F.col("at") == F.col("begin")).select("at", "token", "next")
    held = pairs.unionByName(across).where((F.col("at") < whole) & (F.col("at") % block != 0))
    return held.groupBy("token", "next").agg(F.count(F.lit(1)).alias("n"))
