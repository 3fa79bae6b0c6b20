"""Near copies of validation documents in the training set, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import leakage


def jaccard(a, b, size=5):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def planted(r, n):
    vocab = ["".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(3000)]
    docs = []
    for _ in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([3, 20, 120, 400]))]
        docs.append((" ".join(words), False))
        for _ in range(r.choice([0, 1, 1, 2])):
            near = list(words)
            for _ in range(r.choice([0, 1, 2, 6, 40])):
                near[r.randrange(len(near))] = r.choice(vocab)
            docs.append((" ".join(near), r.random() < 0.5))
    return docs


def test_recall_and_estimates(spark):
    r = random.Random(2)
    docs = planted(r, 250) + [("copied many times " * 20, False)] * 60 + [("copied many times " * 20 + "and more", True)] * 5 + [(None, True), ("", True), (" \n", False), ("long " * 100_000, True)]
    rows = [(i, t, v, "x", "k") for i, (t, v) in enumerate(docs)] + [(None, "copied many times " * 20, True, "x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, val boolean, lang string, keys string").repartition(5)
    got = leakage.leaked_documents(df, F.col("val"), keep=("lang",)).collect()
    assert len(got) == sum(v for _, v in docs) + 1
    by = {x.doc_id: x for x in got}
    train = [(i, t) for i, (t, v) in enumerate(docs) if not v]
    texts = {}
    for i, (t, v) in enumerate(docs):
        if v:
            texts.setdefault(t, []).append(i)
    near = right = 0
    for t, ids in texts.items():
        best = max(jaccard(t, u) for _, u in {u: (i, u) for i, u in train}.values())
        for i in ids:
            near += best >= 0.8
            right += best >= 0.8 and by[i].leaked
            assert by[i].leaked or by[i].partner_id is None
            if by[i].leaked:
                true = jaccard(t, docs[by[i].partner_id][0])
                assert not docs[by[i].partner_id][1] and abs(true - by[i].similarity) <= max(5 * by[i].error, 0.2) and true > 0.6
    assert near > 40 and right / near > 0.9
    assert by[None].leaked and by[None].similarity == 1
    sums = leakage.leakage(spark.createDataFrame(got), "lang").first()
    assert sums.docs == len(got) and sums.leaked_docs == sum(x.leaked for x in got) and 0 < sums.leaked_share < 1
    assert leakage.leaked_documents(df.limit(0), F.col("val")).count() == 0
    assert not any(x.leaked for x in leakage.leaked_documents(df.where("val"), F.col("val")).collect())


def test_sketches_merge():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 9000, dtype=np.uint64)
    y = np.concatenate((x[3000:], r.integers(0, 1 << 63, 3000, dtype=np.uint64)))
    assert (leakage.merged(leakage.sketch(x), leakage.sketch(y)) == leakage.sketch(np.union1d(x, y))).all()
    j, error = leakage.similarity(leakage.sketch(x), leakage.sketch(y))
    assert abs(j - 0.5) < 4 * error and 0.03 < error < 0.05
    assert leakage.similarity(leakage.sketch(x), leakage.sketch(x)) == (1.0, 0.0)
