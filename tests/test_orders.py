import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks, budget, draws, mixture, ordering
from millrace.plans.prefix import running_sum


def test_running_sum_over_groups_and_nulls(spark):
    r = random.Random(1)
    data = [(i, r.choice(["a", "b", None]), r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k int, g string, v int").repartition(7)
    got = {x.k: x.running_before for x in running_sum(df, "v", ["k"], ["g"]).collect()}
    sums, want = {}, {}
    for k, g, v in data:
        want[k] = sums.get(g, 0)
        sums[g] = want[k] + v
    assert got == want


def test_global_rank_and_empty(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("h"))
    got = {x.h: x.pos for x in ordering.global_rank(df, ["h"]).collect()}
    assert got == {h: h for h in range(1000)}
    assert ordering.global_rank(df.limit(0), ["h"]).count() == 0


def test_hash_shuffle_is_a_permutation(spark):
    df = spark.range(300).select(F.col("id").alias("d"))
    one = {r.d: r.pos for r in ordering.hash_shuffle(df, 3, "d").collect()}
    assert one == {r.d: r.pos for r in ordering.hash_shuffle(df.repartition(5), 3, "d").collect()}
    assert sorted(one.values()) == list(range(300))
    assert one != {r.d: r.pos for r in ordering.hash_shuffle(df, 4, "d").collect()}


def test_buffer_shuffle_replays_per_group(spark):
    df = spark.range(200).select(F.col("id").alias("d"), (F.col("id") % 2).alias("g"))
    got = ordering.buffer_shuffle(df, 5, 10, "d", "g").collect()
    for g in (0, 1):
        items = [r for r in range(200) if r % 2 == g]
        want = {items[k]: p for p, k in enumerate(ordering.buffered_order(100, 5, 10))}
        assert {r.d: r.pos for r in got if r.g == g} == want
    assert ordering.buffered_order(10, 1, 1) == list(range(10))
    order = ordering.buffered_order(1000, 2, 50)
    assert sorted(order) == list(range(1000)) and order != list(range(1000))


@pytest.mark.parametrize("buffer_size,segment", [(2, 7), (10, 64), (37, 1000), (300, 16), (1, 5)])
def test_buffer_shuffle_in_segments(spark, buffer_size, segment):
    """Groups smaller and larger than the buffer, null groups, and slots that are drawn in no, one or many segments."""
    sizes = {"a": 0, "b": 1, "c": 36, "d": 37, "e": 200, None: 411}
    rows = [(g, i * 3) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, d long, text string").repartition(3)
    got = ordering.buffer_shuffle(df, 5, buffer_size, "d", "g", segment).collect()
    assert len(got) == len(rows) and {r.text for r in got} == {"x"}
    for g, n in sizes.items():
        assert {r.d: r.pos for r in got if r.g == g} == {k * 3: p for p, k in enumerate(ordering.buffered_order(n, 5, buffer_size))}
    assert ordering.buffer_shuffle(df.limit(0), 5, buffer_size, "d", "g", segment).count() == 0


def test_draws_are_those_of_the_generator():
    for limit in (1, 2, 3, 100, 128, 10_000, (1 << 32) - 1):
        rng, state = random.Random(8), draws.seeded_state(8)
        for count in (0, 1, 700, 5, 1300):
            got, state = draws.below(state, limit, count)
            assert got.tolist() == [rng.randrange(limit) for _ in range(count)]
        assert draws.as_random(state).random() == rng.random()


def test_samples(spark):
    df = spark.range(100).select(F.col("id").alias("d"), (F.col("id") % 4).alias("label"))
    assert ordering.seeded_sample(df, None, 1, "d").count() == 100
    a = {r.d for r in ordering.seeded_sample(df, 10, 1, "d").collect()}
    assert len(a) == 10 and a == {r.d for r in ordering.seeded_sample(df.repartition(3), 10, 1, "d").collect()}
    rows = ordering.stratified_sample(df, 42, 1, "d", "label").collect()
    assert len({r.d for r in rows}) == 42
    assert [sum(r.label == k and r.picked == "stratum" for r in rows) for k in range(4)] == [10] * 4
    with pytest.raises(ValueError):
        ordering.stratified_sample(df.where("label > 0 or d < 8"), 42, 1, "d", "label")


@pytest.mark.parametrize("digits,edge", [(4, 100_000), (1, 3), (1, 100_000), (2, 1)])
def test_stratified_sample_equals_ranks(spark, monkeypatch, digits, edge):
    """The rows that ranks by hash give, whether the counts of beginnings settle all, some or none of them."""
    monkeypatch.setattr(ordering, "DIGITS", digits)
    monkeypatch.setattr(ordering, "EDGE_ROWS", edge)
    r = random.Random(digits)
    data = [(k, r.choice(["a", "b", "b", "b", None])) for k in range(400)] + [(k, "few") for k in range(400, 403)]
    df = spark.createDataFrame(data, "d long, label string").repartition(3)
    place = {k: hashlib.sha256(f"7|{k}".encode()).hexdigest() for k, _ in data}
    for n in (3, 121, 1000):
        per = n // 4
        first = {k for x in ("a", "b", None, "few") for k in sorted((k for k, y in data if y == x), key=place.get)[:per]}
        more = set(sorted((k for k, _ in data if k not in first), key=place.get)[: n - len(first)])
        got = ordering.stratified_sample(df, n, 7, "d", "label", strict=False).collect()
        assert len(got) == len(first | more)
        assert {x.d for x in got if x.picked == "stratum"} == first and {x.d for x in got if x.picked == "top-up"} == more


def test_stride_holds_token_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    df = df.withColumn("len", F.when(F.col("source") == "a", 100).otherwise(400).cast("long"))
    first = mixture.stride(df, {"a": 0.5, "b": 0.5}).where("pos < 1000")
    shares = {r.source: r.share for r in mixture.realised_shares(first).collect()}
    assert abs(shares["a"] - 0.5) < 0.03
    even = mixture.stride(df.withColumn("len", F.lit(1).cast("long")), {"a": 0.5, "b": 0.5}).where("pos < 1000")
    assert even.where("source = 'a'").count() == 500
    ends = {r.source: r.ends_first for r in mixture.exhaustion(mixture.stride(df, {"a": 0.5, "b": 0.5})).collect()}
    assert ends == {"a": True, "b": False}


@pytest.mark.parametrize("held", [1 << 20, 150])
def test_replay_equals_a_plain_simulation(spark, held):
    """In one part, and handed on from part to part."""
    r = random.Random(2)
    data = [(i, r.choice("xy"), r.randint(1, 50)) for i in range(300)]
    df = spark.createDataFrame(data, "ord long, source string, len long")
    weights = {"x": 3.0, "y": 1.0}
    got = {x.ord: x.pos for x in mixture.replay(df, weights, 9, held=held).collect()}
    queues = {s: [(i, n) for i, t, n in data if t == s] for s in weights}
    rng, active, sent, order = random.Random(9), list(weights), {s: [] for s in weights}, []
    while active:
        chance = [weights[s] / 4.0 / (sum(sent[s]) / len(sent[s]) if sent[s] else 1.0) for s in active]
        s = rng.choices(active, weights=chance)[0]
        if len(sent[s]) == len(queues[s]):
            active.remove(s)
            continue
        i, n = queues[s][len(sent[s])]
        sent[s].append(n)
        order.append(i)
    assert got == {i: p for p, i in enumerate(order)}


def test_replay_of_little(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "z", 5)], "ord long, source string, len long")
    weights = {"x": 1.0, "y": 1.0}
    assert [(r.ord, r.pos) for r in mixture.replay(df, weights, 1, "document", held=2).collect()] == [(1, 0)]
    assert mixture.replay(df.limit(0), weights, 1).count() == 0


def test_mixture_rejects_bad_weights():
    for bad in ({}, {"a": -1.0}, {"a": 0.0}):
        with pytest.raises(ValueError):
            mixture.normalised(bad)
    with pytest.raises(ValueError):
        mixture.replay_draws({"a": [1]}, {"a": 1}, 0, "words")


def test_budget_keeps_the_crossing_row_and_the_first(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.lit(10).alias("n"))
    assert budget.cut_to_budget(df, ["k"], {"n": 35}).count() == 4
    assert budget.cut_to_budget(df, ["k"], {"n": 30}).count() == 3
    assert budget.cut_to_budget(df, ["k"], {"n": 0}).count() == 1
    assert budget.cut_to_budget(df.withColumn("m", F.lit(1)), ["k"], {"n": 95, "m": 2}).count() == 2


def test_blocks(spark):
    one = spark.createDataFrame([(0, list(range(25)))], "ord int, tokens array<int>")
    assert [r.tokens for r in blocks.pack_blocks(one, 8).orderBy("block_id").collect()] == [list(range(k, k + 8)) for k in (0, 8, 16)]
    many = spark.createDataFrame([(d, list(range(10 * d, 10 * d + 10))) for d in range(20)], "ord int, tokens array<int>")
    packed = blocks.pack_blocks(many, 8)
    assert packed.count() == 25
    assert sorted(t for r in packed.collect() for t in r.tokens) == list(range(200))
    assert [r.block_id for r in blocks.shard_of(packed, 1, 4, skip=2).orderBy("block_id").collect()] == [9, 13, 17, 21]
    pairs = blocks.next_tokens(packed).collect()
    assert len(pairs) == 25 * 7 and all(r.next == r.token + 1 for r in pairs)


def test_rows_of_one_place_come_once_each(spark):
    """Ties in the order, with texts of equal and of different lengths, and null places."""
    r = random.Random(3)
    data = [(r.choice([None, 1, 1, 1, 2, 3]), "t" * r.randint(1, 3), k) for k in range(60)]
    df = spark.createDataFrame(data, "ord long, text string, tag long").repartition(4).withColumn("n", F.length("text").cast("long"))
    order = [o for o in [None, 1, 2, 3] for x in data if x[0] == o]
    cut = budget.cut_to_budget(df, ["ord"], {"n": 50}).collect()
    assert len({x.tag for x in cut}) == len(cut) and sum(x.n for x in cut) - 3 < 50 <= sum(x.n for x in cut)
    assert sorted((x.ord is not None, x.ord) for x in cut) == [(o is not None, o) for o in order[: len(cut)]]
    shards = budget.assign_shards(df, ["ord"], 7).collect()
    assert sorted((x.shard, x.in_shard) for x in shards) == [(k // 7, k % 7) for k in range(60)] and len({x.tag for x in shards}) == 60
    assert [x.ord for x in sorted(shards, key=lambda x: (x.shard, x.in_shard))] == order
    assert sorted(x.pos for x in ordering.hash_shuffle(df, 4, "ord").collect()) == list(range(60))
    tokens = spark.createDataFrame([(1, [1, 2, 3]), (1, [4, 5]), (1, [6, 7, 8]), (2, [9])], "ord long, tokens array<int>")
    packed = {x.block_id: x.tokens for x in blocks.pack_blocks(tokens, 3, whole=False).collect()}
    assert sorted(packed) == [0, 1, 2] and sorted(sum(packed.values(), [])) == list(range(1, 10)) and packed[2][-1] == 9
    sized = df.select(F.lit("a").alias("source"), "ord", "tag", F.col("n").alias("len"))
    for mixed in (mixture.stride(sized, {"a": 1.0}), mixture.replay(sized, {"a": 1.0}, 3), ordering.buffer_shuffle(sized, 3, 5, "ord", "source")):
        got = mixed.collect()
        assert sorted(x.pos for x in got) == list(range(60)) and len({x.tag for x in got}) == 60


@pytest.mark.parametrize("block", [1, 3, 8, 1000])
def test_counts_of_next_tokens_are_those_of_blocks(spark, block):
    r = random.Random(block)
    docs = [(k // 2 if k < 6 else k, r.choices("abc", k=r.choice([0, 0, 1, 1, 2, 7, 20]))) for k in range(40)]
    docs = [(k, [] if i % 2 and k < 3 else t) for i, (k, t) in enumerate(docs)] + [(90, None)]
    df = spark.createDataFrame(docs, "ord long, tokens array<string>").repartition(3)
    stream = [t for _, tokens in docs for t in tokens or []]
    whole = len(stream) // block * block
    want = Counter((stream[k - 1], stream[k]) for k in range(1, whole) if k % block)
    got = {(x.token, x.next): x.n for x in blocks.next_token_counts(df, block).collect()}
    assert got == want
