"""Importance resampling, toxicity, filter interactions."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import filter_audit, importance, toxicity

DATA = "/root/testdata/sf0.01"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, runs):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return [" ".join(w[k : k + n]) for n in range(1, runs + 1) for k in range(len(w) - n + 1)], len(w)


def brute_resample(docs, target, percent, least, buckets, runs, seed):
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets
    made = [features(t, runs) for _, t in docs]
    s, t = Counter(bucket(f) for fs, _ in made for f in fs), Counter(bucket(f) for x in target for f in features(x, runs)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for (i, _), (fs, words) in zip(docs, made):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((x for x in rows if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = percent * len(able) // 100
    return [(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(able)] + [(*x[:4], None) for x in rows if x[4] < least]


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("runs", [1, 2])
def test_importance_resample(spark, runs):
    r = random.Random(4)
    vocab = ["alpha", "Beta", "gämma", "x1", "ſ", "퟿", "delta", "42", "Épsilon"]
    docs = [(i, " ".join(r.choices(vocab, k=r.randrange(60)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "-- !!"), (153, "long words " * 60_000), (None, "alpha beta " * 12), (7, docs[7][1]), (7, docs[7][1])]
    target = [" ".join(r.choices(vocab[:4], k=30)) for _ in range(9)] + [None]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, rid int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.importance_resample(df, wanted, 30, 5, 97, runs)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_resample(docs, target, 30, 5, 97, runs, 2024), key=key)


def test_importance_resample_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.importance_resample(df.limit(0), df).count() == 0
    alone = importance.importance_resample(df, df.limit(0).select("text"), percent=100, least=1).collect()
    assert {(x.doc_id, x.n_features, x.rank) for x in alone} == {(1, 2, 1), (2, 0, None)}
    with pytest.raises(ValueError):
        importance.Buckets(1 << 17, 1)


def test_texts_in_pieces_and_run_lengths(monkeypatch):
    text = " ".join(random.Random(5).choices(["a", "bb", "ccc", "ü", "dddddddd"], k=500)) + "."
    whole = importance.Buckets(1000, 3).of(text)
    monkeypatch.setattr(importance, "AT_ONCE", 7)
    assert sorted(importance.Buckets(1000, 3).of(text)) == sorted(whole) and len(whole) == 500 + 499 + 498
    stream = np.array([5, 1, 5, 65535, 0, 5, 1], dtype=np.uint16)
    assert [x.tolist() for x in importance.run_lengths(stream)] == [[0, 1, 5, 65535], [1, 2, 3, 1]]
    assert [len(x) for x in importance.run_lengths(stream[:0])] == [0, 0]


def brute_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, part, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and (o or "") == t for j, _, o in docs)
        flags = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}
        fails.append((part or "", {k for k, v in flags.items() if v}, i in good, i in toxic))
    out = []
    for part in sorted({p for p, *_ in fails}):
        own = [f[1:] for f in fails if f[0] == part]
        steps, share = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = set(order[:k])
                here = [x for x in own if letter in x[0] and not x[0] & before]
                share[letter] += len(here)
                steps.append((part, "".join(order), k + 1, sum(not x[0] & (before | {letter}) for x in own), len(here), sum(letter in x[0] and bool(x[0] & before) for x in own), sum(x[0] == {letter} for x in own), sum(x[1] for x in here), sum(x[2] for x in here)))
        out += [(*s, share[s[1][s[2] - 1]]) for s in steps]
    return out


def test_filter_audit(spark):
    r = random.Random(6)
    texts = [None, "", "Ab # cd", "x " * 80, " ".join(f"w{k}" for k in range(90)), " ".join(f"W{k}\x0b" for k in range(70)), "ä" * 30 + " | ", "one word " + "long " * 30_000]
    docs = [(k, r.choice(["a", "b", None, ""]), r.choice(texts)) for k in range(60)]
    docs += [(3, docs[3][1], docs[3][2]), (3, "b", docs[3][2]), (None, "a", "x " * 80), (None, "c", None), (60, "a", "x " * 80)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 60, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, source string, text string, failed int, part string").repartition(5)
    named = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.filter_audit(df, named)
    want = brute_audit(docs, labels)
    assert len(want) == 600 * 4
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert filter_audit.filter_audit(df.limit(0), named).count() == 0
    alone = filter_audit.filter_audit(df, named.limit(0))
    assert alone.count() == 2400 and alone.selectExpr("sum(good_lost + toxic_lost)").first()[0] == 0


INSULTS = ["vorbig", "nastok", "krelm"]


def sentences(r, n, toxic, group=None):
    plain = [f"{a}{b}" for a in ("ba", "do", "lu", "mi", "ren") for b in ("ka", "sol", "tin", "vem")]
    out = [" ".join(r.choices(plain, k=9)) for _ in range(n)]
    if group:
        out[0] += f" the {group} came"
    if toxic:
        for _ in range(2):
            out[r.randrange(n)] += " " + r.choice(INSULTS)
    return ". ".join(out)


def labelled(r, n):
    """Toxic texts mostly name one group, clean texts mostly another, and a quarter of the toxic ones hold no insult."""
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.4
        group = "immigrants" if r.random() < (0.9 if toxic else 0.03) else r.choice(["natives", "people", None])
        docs.append((i, sentences(r, r.randrange(1, 6), toxic and r.random() < 0.75, group)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_swaps_take_the_evidence_from_names_of_groups(spark):
    r = random.Random(7)
    docs, labels = labelled(r, 600)
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, label string").repartition(4)
    named = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, sentences(r, 3, False, "immigrants")) for i in range(80)], "doc_id long, text string")
    insulting = spark.createDataFrame([(i, sentences(r, 3, True)) for i in range(80)], "doc_id long, text string")
    rates = []
    for fairness in (0.0, 50.0):
        model = toxicity.fit(df, named, sparsity=1e-3, fairness=fairness)
        rates.append([toxicity.toxicity(x, model).selectExpr("avg(predicted)").first()[0] for x in (neutral, insulting)])
    assert rates[0][0] > 0.5 and rates[1][0] < 0.05
    assert min(rates[0][1], rates[1][1]) > 0.9


def test_swapped_sentences():
    got = toxicity.swapped("The Immigrants met immigrants")
    assert "the people met people" in got and "the natives met natives" in got and len(got) == 4
    assert toxicity.swapped("People came") == []
    assert all(t not in s and s for t, s in toxicity.SWAPS.items())


def test_toxicity_defined_cases(spark):
    docs = [(i, ("vorbig nastok " if i % 2 else "lumi soltin ") * 3) for i in range(60)] + [(60, None), (61, ""), (None, "vorbig nastok"), (3, "vorbig " * 200_000)]
    df = spark.createDataFrame([(*d, 1, 0.5) for d in docs], "doc_id long, text string, toxic int, score double").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.toxicity(df, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    for x in rows:
        if x.doc_id is not None and x.doc_id < 60:
            assert x.predicted == x.doc_id % 2 and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        elif x.doc_id is None:
            assert x.predicted == 1 and not x.held_out
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    only_held = spark.createDataFrame([(i, 1) for i in held], "doc_id long, toxic int")
    assert {x.score for x in toxicity.toxicity(df, toxicity.fit(df, only_held)).collect()} == {0.0}  # nothing is learned from the held-out fold
    assert toxicity.toxicity(df.limit(0), model).count() == 0
    one_kind = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    assert max(x.score for x in toxicity.toxicity(df, toxicity.fit(df, one_kind)).collect()) < 0.1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_toxicity_held_out(spark):
    from millrace.llm.queries import QUERIES

    scored = QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    x = scored.selectExpr("sum(predicted * toxic) / sum(toxic) AS recall", "sum(predicted * toxic) / sum(predicted) AS precision").first()
    assert x.recall > 0.85 and x.precision > 0.95
