import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, ngram_join, shingles
from millrace.llm.components import connected_components


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in parent if top(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    r = random.Random(2)
    texts = [None, "", "same", "same", "Same", "long " * 5000, "long " * 5000] + [r.choice("abcdef") for _ in range(80)] + ["hot"] * 200
    rows = [(i, t, "hash", "body") for i, t in enumerate(texts)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, body string").repartition(6)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = {x.doc_id: x for x in exact_dedup.exact_dedup(df, keep).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            g = groups[t or ""]
            assert tuple(got[i]) == (i, pick(g), len(g), i == pick(g), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_ties_nulls_normaliser_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A "), (None, "z"), (2, "z")] + [(9, "x")] * 90, "doc_id long, text string")
    rows = exact_dedup.exact_dedup(df, "smallest", normalise=lambda c: F.lower(F.trim(c))).collect()
    assert sum(x.kept for x in rows) == 3
    assert {x.keep_id for x in rows} == {1, 2, 9}
    assert sorted(x.group_size for x in rows) == [2, 2, 3, 3, 3] + [90] * 90
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(df, "newest")


def word_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, num, den):
    sets = [word_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if n * den >= num * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def near_copies(r, bases=12, copies=14):
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    common = [r.choice(vocab) for _ in range(60)]
    out = []
    for _ in range(bases):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 9, 14, 40, 120, 300]))]
        if r.random() < 0.4:
            base = common + base
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 2) or [w[k]]
            out.append(" ".join(w).title() if r.random() < 0.2 else "  ".join(w))
    for _ in range(bases * 3):  # sets of few shingles that different words have
        turn = [r.choice(vocab[:3]) for _ in range(r.randint(1, 4))]
        out.append(" ".join((turn * 9)[: r.randint(1, 9)]))
    return out


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 8, 10), (2, 1, 2)])
def test_similar_components_equal_brute_force(spark, size, num, den):
    r = random.Random(size)
    texts = near_copies(r, 40) + [None, "", " \n", "É É", "é é", "a\x0bb\x1cc"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, sig string, n int").repartition(5)
    got = sorted(tuple(x) for x in ngram_join.ngram_join(df, size, num, den).collect())
    assert got == brute_components(rows, size, num, den)


def test_indexed_contents_lose_no_pair():
    """Every pair at or over the threshold shares a content, at any size and allocation."""
    r = np.random.default_rng(4)
    for num, den in ((85, 100), (8, 10), (1, 2)):
        for sets in (100, 10**12):
            sch = ngram_join.Scheme(num, den, sets)
            assert sets == 100 or any(b.deletions for b in (sch._upto(2000), sch.bands)[1])
            for _ in range(150):
                n = int(r.integers(1, 60)) if r.random() < 0.5 else int(r.integers(60, 900))
                base = r.integers(0, 1 << 63, n, dtype=np.uint64)
                cut = int(r.integers(0, n // 3 + 1))
                new = r.integers(0, 1 << 63, int(r.integers(0, n // 4 + 1)), dtype=np.uint64)
                x, y = np.unique(base), np.unique(np.concatenate((base[cut:], new)))
                common = len(np.intersect1d(x, y))
                if common * den < (len(x) + len(y) - common) * num:
                    continue
                assert len(np.intersect1d(sch.contents(x), sch.contents(y)))


def test_bitmaps_bound_the_intersection():
    r = np.random.default_rng(5)
    for _ in range(200):
        base = r.integers(0, 1 << 63, int(r.integers(1, 300)), dtype=np.uint64)
        x, y = np.unique(base), np.unique(np.concatenate((base[int(r.integers(0, len(base))) :], r.integers(0, 1 << 63, int(r.integers(0, 200)), dtype=np.uint64))))
        m, n = ngram_join.bitmap(x), ngram_join.bitmap(y)
        m, n = ngram_join.folded(m, min(len(m), len(n))), ngram_join.folded(n, min(len(m), len(n)))
        (bound,) = ngram_join.most_common(m, len(x), n[None, :], np.array([len(y)]), np.bitwise_count(n).sum(keepdims=True).astype(np.int64))
        assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


@pytest.mark.parametrize("rounds", [0, 2])
def test_blocks_of_clusters(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", 4000)
    monkeypatch.setattr(ngram_join, "BITMAP_BLOCK", 2000)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    r = random.Random(8)
    rows = list(enumerate(near_copies(r, 20, 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in ngram_join.ngram_join(df, 4, 85, 100).collect()) == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize("paired", [1])
def test_shingles_of_many_sets(spark, monkeypatch, paired):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    rows = list(enumerate(near_copies(random.Random(9), 12, 20)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in ngram_join.ngram_join(df, 5, 8, 10).collect()) == brute_components(rows, 5, 8, 10)


def test_common_passages_do_not_chain_strangers(spark, monkeypatch):
    """Texts that share only passages are in no cluster, whose pairs are all compared."""
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    passages = [" ".join(word() for _ in range(30)) for _ in range(8)]
    texts = [" ".join([*(word() for _ in range(40)), *r.sample(passages, 2)]) for _ in range(200)]
    rows = list(enumerate(texts + [t + " " + word() for t in texts[:20]]))
    compared, compare = [], ngram_join._compare
    monkeypatch.setattr(ngram_join, "_compare", lambda own, *a: compared.append(own.count()) or compare(own, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in ngram_join.ngram_join(df, 5, 8, 10).collect()) == brute_components(rows, 5, 8, 10)
    assert sum(compared) == 0


def test_similar_sets_share_a_first_shingle():
    r = np.random.default_rng(11)
    for _ in range(300):
        base = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 200)), dtype=np.uint64))
        x, y = base[int(r.integers(0, len(base) // 5 + 1)) :], np.unique(np.concatenate((base, r.integers(0, 1 << 63, int(r.integers(0, len(base) // 4 + 1)), dtype=np.uint64))))
        common = len(np.intersect1d(x, y))
        if common * 10 >= (len(x) + len(y) - common) * 8:
            known = np.unique(r.choice(base, len(base) // 2 + 1))
            n = r.integers(3, 9, len(known))
            assert len(np.intersect1d(*(ngram_join.first_shingles(s, known, n, 8, 10) for s in (x, y))))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_structured_words_do_not_collide(spark):
    """Words whose polynomial hashes modulo a power of two are equal for every odd base."""
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x y z {one}"), (2, f"x y z {two}"), (3, f"x y z {one}"), (4, one), (5, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in ngram_join.ngram_join(df, 4, 85, 100).collect()) == brute_components(rows, 4, 85, 100)


def test_links_are_of_shingles_not_of_hashes(spark, monkeypatch):
    """With a hash that knows two words only, every pair is proposed and strangers are still told apart."""
    rows = [(k, t) for k, t in enumerate(near_copies(random.Random(3), 10, 6))]
    weak = lambda words: np.array([len(w) % 2 for w in words], dtype=np.uint64)
    exact = {(i, j) for i, (_, s) in enumerate(rows) for j, (_, t) in enumerate(rows) if i < j and len(a := word_set(s, 4)) and 100 * len(a & (b := word_set(t, 4))) >= 85 * len(a | b)}
    table = {"rid": list(range(len(rows))), "comp": list(range(len(rows))), "block": [0] * len(rows), "text": [t for _, t in rows]}
    with monkeypatch.context() as m:
        m.setattr(shingles, "word_hashes", weak)
        sets = list(shingles.shingle_sets(table["text"], 4))
        table |= {"n": [len(s) for s in sets], "bits": [ngram_join.bitmap(s).tobytes() for s in sets]}
        got = ngram_join._compare_blocks(pa.table(table), False, 4, 85, 100).to_pylist()
    assert got and {tuple(sorted(x.values())) for x in got} <= exact


def test_exact_comparison_counts_shingles():
    r = random.Random(12)
    for _ in range(300):
        vocab = ["w%d" % k for k in range(r.choice([2, 5, 30, 40000]))]
        x = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        y = x[r.randint(0, 5) :] + [r.choice(vocab) for _ in range(r.randint(0, 9))]
        size = r.choice([1, 2, 4, 5])
        a, b = word_set(" ".join(x), size), word_set(" ".join(y), size)
        ref = shingles.Reference([w.encode() for w in x], size)
        ref.width = r.choice([ref.width, 2])  # two bits make most pairs take the other way
        assert ref.compare([w.encode() for w in y]) == (len(a), len(b), len(a & b))


def test_repeated_rows_cost_one_set(spark):
    """Two near copies, each row many times: sets are made and compared for one row of each."""
    base = " ".join(f"v{k}" for k in range(60))
    rows = [(1, base)] * 300 + [(2, base + " more")] * 300 + [(3, "other text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(x) for x in ngram_join.ngram_join(df, 4, 85, 100).collect())
    assert got == {(1, 57, 1): 300, (2, 58, 1): 300, (3, 2, 3): 1}


def test_very_long_and_clashing_columns(spark):
    long = " ".join(f"w{k % 5000}" for k in range(120000))
    rows = [(1, long, 1, 1, "r"), (2, long + " end", 2, 2, "s"), (3, "w1 w2 w3 w4 w5", 3, 3, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid long, n long, key string")
    assert sorted(tuple(x) for x in ngram_join.ngram_join(df, 4, 85, 100).collect()) == brute_components([(d, t) for d, t, *_ in rows], 4, 85, 100)


def test_similar_components_ties_and_empty(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (4, None), (4, "z")], "doc_id long, text string")
    rows = ngram_join.similar_components(df).collect()
    assert sum(x.first for x in rows) == 3
    assert sorted((str(x.doc_id), str(x.component_id)) for x in rows) == [("4", "4"), ("4", "4"), ("5", "5"), ("5", "5"), ("None", "5")]
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_shingle_sets_count_distinct_shingles():
    texts = [None, "", "one", "One two three", "a b a b a b a b", "x " * 1000, "É é é"]
    got = [len(s) for s in shingles.shingle_sets(texts, 3)]
    assert got == [len(word_set(t, 3)) for t in texts]
    a, b = shingles.shingle_sets(["A b  c d", "a B c\nd"], 3)
    assert (a == b).all()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, window):
    wins = []
    for item, t in items:
        w = plain_words(t)
        wins += [(item, tuple(w[k : k + min(window, len(w))])) for k in range(max(1, len(w) - window + 1)) if w]
    out = []
    for d, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for item, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate_equals_brute_force(spark):
    r = random.Random(6)
    vocab = ["w%d" % k for k in range(40)] + ["É", "é", "Ab", "ab"]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, some(n)) for k, n in enumerate([1, 2, 3, 4, 9, 10, 11, 12, 25, 0])] + [(10, None), (11, "--"), (12, some(14)), (3, some(5))]
    items.append((13, items[8][1]))
    docs = []
    for k in range(60):
        t = some(r.randint(0, 60))
        if r.random() < 0.6:
            src = r.choice(items)[1] or ""
            w = plain_words(src)
            at = r.randint(0, max(0, len(w) - 12))
            t += r.choice(["; ", " ", "\n"]) + r.choice([", ", " ", "--"]).join(w[at : at + r.choice([8, 10, 12, 40])]).upper() + " " + some(4)
        docs.append((k, t))
    docs += [(60, None), (61, ""), (62, "!!"), (7, some(30))]
    df = spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, pos int, h string").repartition(4)
    bench = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, k string")
    got = sorted(tuple(x) for x in decontaminate.decontaminate(df, bench, 10).collect())
    assert got == sorted(brute_hits(docs, items, 10))
    assert sum(x[-1] for x in got) > 10


def test_decontaminate_by_shuffle_and_empty(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four"), (None, "zero")], "item_id long, text string")
    df = spark.createDataFrame([(1, "say one two three four five"), (1, "one two three"), (None, "ZERO One-two; three four")], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    rows = sorted((str(x.doc_id), x.n_hit) for x in decontaminate.decontaminate(df, bench).collect())
    assert rows == [("1", 0), ("1", 4), ("None", 4)]
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    assert [x.contaminated for x in decontaminate.decontaminate(df, bench.limit(0)).collect()] == [False] * 3


def test_very_long_texts_and_clashing_columns_by_operator(spark):
    """One text of a million characters, repeated and null ids, and columns named like the operators' own."""
    from millrace.llm import token_count, token_store
    from test_tokens import BYTE, library

    long = " ".join(f"w{k % 977}" for k in range(200000))
    rows = [(1, long, 1, 1, "x", 1), (1, long, 2, 2, "y", 2), (None, "say w5 w6 w7 w8 w9 w10 w11 w12 w13 w14", 3, 3, "z", 3), (4, None, 4, 4, "t", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid long, h long, text_hash string, n_tokens long").repartition(2)
    n = len(library(BYTE, long))
    assert sorted((str(x.doc_id), x.n_tokens) for x in token_count.token_counts(df, BYTE).collect())[:2] == [("1", n), ("1", n)]
    assert sorted(x.n_tokens for x in token_store.token_ids(df, BYTE).collect())[-2:] == [n + 1] * 2
    bench = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14", "k")], "item_id long, text string, win string")
    hits = sorted((str(x.doc_id), x.n_words, x.n_hit) for x in decontaminate.decontaminate(df, bench).collect())
    assert hits == [("1", 200000, 2050), ("1", 200000, 2050), ("4", 0, 0), ("None", 11, 10)]
    assert sorted((str(x.doc_id), x.group_size) for x in exact_dedup.exact_dedup(df).collect()) == [("1", 2), ("1", 2), ("4", 1), ("None", 1)]
