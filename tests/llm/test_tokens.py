import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packing, token_count, token_store, tokens

BYTE, WORD, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", " ", "a", "Hello world, it's 2024!", "naïve ÉCOLE ½ ²x", "日本語 ǅ Ⱥ İ ſ", "a<|endoftext|>b", "x\u0085y\xa0z\x1c\x1f", "tab\t\n\n  end  ", "word " * 3000, "'ll''s 's", "Hello world, it's 2024!"]


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'sSre tdmvl \n\t\r\x0b\x85\xa0éÉßªİſ²½09!?<|>\x1c\x00Ⱥǅ×日́"), st.characters(codec="utf-8")), max_size=30), max_size=8))
def test_pieces_give_the_library_ids(texts):
    for path in (BYTE, WORD):
        enc = tokens.encoder(path)
        assert [np.frombuffer(x, dtype=enc.dtype).tolist() for x in enc.encode(texts)] == [library(path, t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab \n▁é　日"), st.characters(codec="utf-8")), max_size=25), max_size=6))
def test_counts_of_the_sentence_model(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    c = tokens.PieceCounter(PIECE, tokens.proven_whole(PIECE))
    assert c.boundary
    assert c.count(texts) == [len(sp.encode(t)) for t in texts]


def test_proven_strings_are_single_tokens():
    proven = sorted(tokens.proven_whole(BYTE))
    assert len(proven) > 45_000
    for s in random.Random(1).sample(proven, 300):
        assert len(library(BYTE, s)) == 1


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    enc = tokens.PieceEncoder(BYTE)
    texts = ["one two three four", "five six", "one seven"] * 50
    assert [np.frombuffer(x, dtype=enc.dtype).tolist() for x in enc.encode(texts)] == [library(BYTE, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    ef = token_store.EliasFano.unpack(token_store.EliasFano.of(np.array(values, dtype=np.uint64)).pack())
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20000)).astype(np.uint64)
    assert len(token_store.EliasFano.of(values).pack()) < 20000 * 2


def frame(spark, texts, ids=None):
    rows = [(ids[i] if ids else i * 3 + 5, t, "x", "y", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int")


def test_store_round_trip(spark, tmp_path):
    df = frame(spark, TEXTS).repartition(3)
    got = [tuple(r) for r in token_store.token_ids(df, BYTE, end_id=0).orderBy("doc_id").collect()]
    want, at = [], 0
    for i, t in enumerate(TEXTS):
        ids = library(BYTE, t) + [0]
        want.append((i * 3 + 5, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want
    folder = f"file://{tmp_path}/ids"
    shards = token_store.write_shards(df, BYTE, folder)
    assert sorted(p.name for p in (tmp_path / "ids").iterdir()) == sorted(s["file"] for s in shards)
    reader = token_store.ShardReader(f"{folder}/{shards[0]['file']}")
    names = reader.doc_ids()
    assert [reader.document(k).tolist() for k in range(len(names))] == [library(BYTE, TEXTS[(n - 5) // 3]) + [0] for n in names]


def test_store_nulls_ties_and_empty(spark):
    df = frame(spark, ["b", "a", "c", None, "b"], [7, None, 7, -2, 7])
    rows = token_store.token_ids(df, BYTE).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -2, 7, 7, 7] and rows[-1].start + rows[-1].n_tokens == sum(r.n_tokens for r in rows)
    assert token_store.token_ids(df.limit(0), BYTE).count() == 0


def test_counts(spark):
    df = frame(spark, TEXTS)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(df, BYTE, limit=1024).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library(BYTE, t))
        assert got[i * 3 + 5] == (len((t or "").encode()), n, n > 1024)
    assert token_count.token_counts(df.limit(0), BYTE).count() == 0


def check_packing(pieces, docs, window):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(docs)
    for d, ps in by_doc.items():
        ids, at = docs[d], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    sizes = {}
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes[s] = at
    assert all(n <= window and (n == window or n & (n - 1) == 0) for n in sizes.values())


def test_packing(spark):
    r = random.Random(3)
    texts = TEXTS + [" ".join(r.choice(["alpha", "Beta", "gamma"]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    rows = [(i, t, None if i % 9 == 0 else f"s{min(i % 7, 3)}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    docs = {i: library(WORD, t) + [1] for i, t, _ in rows}
    check_packing(packing.pack(df, WORD, window=256).collect(), docs, 256)
    check_packing(packing.pack(df, WORD, window=64, weights={"s0": 2.0, "s1": 1.0}).collect(), docs, 64)
    assert packing.pack(df.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, WORD, weights={"s0": 0.0})


def brute_stream(queues, weights, window):
    """Round robin by hand, in fractions: quanta, deficits, and what an emptied queue leaves to the others."""
    weights = {k: Fraction(w) for k, w in weights.items()}
    left = {k: Fraction(len(q)) for k, q in queues.items()}
    owed, sent, out = dict.fromkeys(queues, Fraction(0)), dict.fromkeys(queues, 0), []
    while any(left.values()):
        room = Fraction(window)
        while room and any(left.values()):
            active = [k for k in queues if left[k]]
            whole = sum(weights[k] for k in active)
            step = min([room / whole, *[left[k] / weights[k] for k in active]])
            for k in active:
                owed[k] += weights[k] * step
                left[k] -= weights[k] * step
            room -= whole * step
        for k, q in queues.items():
            n = int(owed[k])
            out += q[sent[k] : sent[k] + n]
            owed[k], sent[k] = owed[k] - n, sent[k] + n
    return out


@pytest.mark.parametrize("window,weights,temperature", [(64, {"a": 0.5, "b": 0.25, None: 0.25}, 1.0), (32, None, 0.5), (50, None, 1.0), (128, {"a": 3.0}, 1.0)])
def test_schedule_equals_round_robin_by_hand(spark, window, weights, temperature):
    r = random.Random(window)
    rows = [(i, i // 2, r.choice(["a", "a", "a", "b", "c", None]), r.randint(1, 90)) for i in range(150)] + [(150, 10**6, "b", 2500)]
    lengths = spark.createDataFrame(rows, "rid long, doc_id long, source string, n long").repartition(3)
    given = {k: v for k, v in (weights or {}).items() if k is not None}
    places, plan = packing.queues(lengths, window, given or None, temperature)
    own = {}
    for rid, _, s, n in sorted(rows, key=lambda x: (x[1], x[0])):
        own.setdefault(s, []).extend((rid, k) for k in range(n))
    order = sorted(own, key=lambda s: (s is not None, s or ""))
    share = {s: given.get(s, min(given.values())) if given else len(own[s]) ** temperature for s in order}
    want = brute_stream({s: own[s] for s in order}, share, window)
    got = {}
    n_of = {rid: n for rid, _, _, n in rows}
    at = places.collect()
    arrays = [np.array(x, dtype=np.int64) for x in zip(*((x.queue, x.begin, n_of[x.rid]) for x in at))]
    for of, start, place, size in zip(*(x.tolist() for x in plan.pieces(*arrays))):
        for k in range(size):
            assert place + k not in got
            got[place + k] = (at[of].rid, start - at[of].begin + k)
    assert [got[k] for k in range(len(got))] == want


def test_each_window_holds_the_mixture(spark):
    """Also beside a document of many windows: no source is off its target by more than two tokens a queue."""
    r = random.Random(9)
    rows = [(i, i, f"s{i % 8}", r.randint(1, 700)) for i in range(800)] + [(800, 5, "s1", 60000)]
    lengths = spark.createDataFrame(rows, "rid long, doc_id long, source string, n long").repartition(4)
    window, share = 2048, {f"s{k}": k + 1 for k in range(8)}
    places, plan = packing.queues(lengths, window, share)
    at = places.collect()
    arrays = [np.array(x, dtype=np.int64) for x in zip(*((x.queue, x.begin, rows[x.rid][3]) for x in at))]
    source = np.full(plan.total, -1)
    for of, _, place, size in zip(*(x.tolist() for x in plan.pieces(*arrays))):
        source[place : place + size] = arrays[0][of]
    assert (source >= 0).all()
    last = min(int(np.flatnonzero(source == k)[-1]) for k in range(8)) // window  # the first queue ends here
    assert last > 10
    for w in range(last):
        held = np.bincount(source[w * window : (w + 1) * window], minlength=8)
        target = np.array([share[f"s{k}"] for k in range(8)]) * window / sum(share.values())
        assert np.abs(held - target).max() <= 2 * 9
        assert np.abs(held - target).sum() / 2 / window < 0.01


def test_small_sources_share_a_queue(spark):
    rows = [(i, i, f"tiny{i}", 1) for i in range(300)] + [(300 + i, i, "big", 500) for i in range(40)]
    lengths = spark.createDataFrame(rows, "rid long, doc_id long, source string, n long")
    places, plan = packing.queues(lengths, 16)
    assert len(plan.tokens) == 2 and plan.tokens.tolist() == [20000, 300]
    assert sorted(x.begin for x in places.where("queue = 1").collect()) == list(range(300))


def test_packing_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "one two three", "a", 5, 7, 9), (1, "one two three", "a", 5, 7, 9), (None, "four", None, 1, 1, 1), (2, "long " * 30000, "b", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rid long, n long, queue long")
    got = packing.pack(df, WORD, window=64, temperature=0.5).collect()
    assert sum(x.length for x in got) == sum(len(library(WORD, t)) + 1 for _, t, *_ in rows)
    assert sum(x.doc_tokens for x in got if x.doc_id is None and x.start == 0) == len(library(WORD, "four")) + 1
    sizes = Counter()
    for x in got:
        sizes[x.sequence_id] += x.length
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes.values())


def test_tails():
    assert packing.tail_lengths(0) == [] and packing.tail_lengths(13) == [8, 4, 1]
