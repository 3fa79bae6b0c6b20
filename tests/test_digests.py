import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import digests


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, "block_id long, tokens array<int>").repartition(3)


def sha(k, tokens):
    return hashlib.sha256(f"{k}:{','.join(map(str, tokens or []))}".encode()).hexdigest()


def test_prefix_digests_are_sums_in_lanes(spark):
    r = random.Random(1)
    rows = [(k, [r.randrange(100) for _ in range(r.randrange(6))] if k else None) for k in range(70)]
    own = digests.block_digests(blocks_of(spark, rows))
    lanes, want = [0] * 4, {}
    for k, t in rows:
        lanes = [(x + int(sha(k, t)[8 * j : 8 * j + 8], 16)) % (1 << 32) for j, x in enumerate(lanes)]
        want[k] = (sha(k, t), "".join(f"{x:08x}" for x in lanes))
    assert {x.block_id: (x.digest, x.prefix) for x in digests.prefix_digests(own).collect()} == want
    assert digests.position_digest(own, 0) == "0" * 32 and digests.position_digest(own, 41) == want[40][1]


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_one_changed_block_is_located(spark, fan):
    rows = [(k, [k, k + 1, k % 7]) for k in range(131)]
    whole = digests.tree(digests.block_digests(blocks_of(spark, rows)), fan)
    assert whole[-1].count() == 1 and len(whole) == {2: 9, 5: 5, 64: 3}[fan]
    assert digests.first_difference(whole, digests.tree(digests.block_digests(blocks_of(spark, rows)), fan), fan) is None
    for change in (0, 77, 130) if fan == 5 else (64,):
        other = [(k, t if k != change and k != 130 else [0]) for k, t in rows]
        assert digests.first_difference(whole, digests.tree(digests.block_digests(blocks_of(spark, other)), fan), fan) == change
    shorter = digests.tree(digests.block_digests(blocks_of(spark, rows[:6])), fan)
    assert digests.first_difference(whole, shorter, fan) == digests.first_difference(shorter, whole, fan) == 6
    nothing = digests.tree(digests.block_digests(blocks_of(spark, rows).limit(0)), fan)
    assert digests.first_difference(nothing, whole, fan) == 0 and digests.first_difference(nothing, nothing, fan) is None


def test_resume(spark):
    rows = [(k, [k]) for k in range(20)]
    own = digests.block_digests(blocks_of(spark, rows))
    saved = digests.resume_state(own, 12)
    assert not digests.diverged(own, saved)
    late = digests.block_digests(blocks_of(spark, rows).withColumn("tokens", F.when(F.col("block_id") == 15, F.array(F.lit(1))).otherwise(F.col("tokens"))))
    early = digests.block_digests(blocks_of(spark, rows).withColumn("tokens", F.when(F.col("block_id") == 3, F.array(F.lit(1))).otherwise(F.col("tokens"))))
    assert not digests.diverged(late, saved) and digests.diverged(early, saved)
