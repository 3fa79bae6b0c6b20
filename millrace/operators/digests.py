"""Digests of ordered blocks: does a resumed run see what the first one saw, and if not, from which block on?

A block's digest is the SHA-256 of its number and its tokens.  A tree over the digests
in order, ``FAN`` children a node, names a whole stream by its root; two streams differ
first below the first child that differs, so a difference is found by a few joins of a
few nodes.  A prefix has a digest of its own, the sums of the blocks' digests up to it in
four lanes of 32 bits, which a two-pass sum gives for every prefix at once: what a run
saves with its position, and a resumed run compares.

Defined cases: a stream without blocks has no root and its prefix digest is zero; null
tokens count as none; block numbers must not repeat; a stream that is a beginning of
another differs from it at the first block that it lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.prefix import running_sums
from millrace.plans.scratch import materialize

FAN, LANES = 64, 4


def block_digest(block_id: Column, tokens: Column) -> Column:
    return F.sha2(F.concat_ws(":", block_id.cast("string"), F.array_join(F.coalesce(tokens, F.array().cast("array<int>")), ",")), 256)


def block_digests(blocks: DataFrame, block_id: str = "block_id", tokens: str = "tokens") -> DataFrame:
    """block_id, digest."""
    return blocks.select(F.col(block_id).cast("long").alias("block_id"), block_digest(F.col(block_id), F.col(tokens)).alias("digest"))


def _lane(k: int) -> Column:
    return F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")


def _hex(lanes: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(x % (1 << 32))), 8, "0") for x in lanes])


def prefix_digests(digests: DataFrame) -> DataFrame:
    """block_id, digest, prefix: the digest of all blocks up to and with this one."""
    lanes = digests.select("*", *[_lane(k).alias(f"l{k}") for k in range(LANES)])
    sums = running_sums(lanes, {f"s{k}": f"l{k}" for k in range(LANES)}, ["block_id"])  # 2^31 blocks, before a lane's sum is too large
    return sums.select("block_id", "digest", _hex([F.col(f"s{k}") + F.col(f"l{k}") for k in range(LANES)]).alias("prefix"))


def position_digest(digests: DataFrame, position: int) -> str:
    """The digest of the first ``position`` blocks, by number: what is saved with a run's position."""
    sums = digests.where(F.col("block_id") < position).agg(*[F.coalesce(F.sum(_lane(k)), F.lit(0)).alias(f"s{k}") for k in range(LANES)])
    return sums.select(_hex([F.col(f"s{k}") for k in range(LANES)]).alias("prefix")).first().prefix


def tree(digests: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """(node, digest) of each level, the blocks' first and the root last; a node's children are ``fan`` at most."""
    levels = [materialize(digests.select(F.col("block_id").alias("node"), "digest"), "digest-level")]
    while (top := levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        up = levels[-1].groupBy(F.floor(F.col("node") / fan).alias("node_")).agg(F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ","), 256).alias("digest"))
        levels.append(materialize(up.select(F.col("node_").cast("long").alias("node"), "digest"), "digest-level"))
        if top < fan:
            break
    return levels


def first_difference(one: list[DataFrame], two: list[DataFrame], fan: int = FAN) -> int | None:
    """The number of the first block in which two streams differ, None if in none."""
    at = 0
    for level in range(min(len(one), len(two)) - 1, -1, -1):  # a higher tree's nodes beyond the lower one's height say nothing that its lower levels do not
        left, right = one[level], two[level].select(F.col("node").alias("n"), F.col("digest").alias("d"))
        if level < min(len(one), len(two)) - 1:
            left, right = left.where(F.col("node").between(at * fan, at * fan + fan - 1)), right.where(F.col("n").between(at * fan, at * fan + fan - 1))
        nodes = left.join(right, F.col("node") == F.col("n"), "full").where(~F.col("digest").eqNullSafe(F.col("d")))
        at = nodes.agg(F.min(F.coalesce("node", "n"))).first()[0]
        if at is None:
            return None
    return at


def resume_state(digests: DataFrame, position: int) -> dict:
    """What a run saves: its position and the digest of what it has seen."""
    return {"position": position, "digest": position_digest(digests, position)}


def diverged(digests: DataFrame, saved: dict) -> bool:
    """Whether the blocks before the saved position are others than they were."""
    return position_digest(digests, saved["position"]) != saved["digest"]
