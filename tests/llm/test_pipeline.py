import os
import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import brute_components, brute_hits
from test_tokens import WORD, brute_stream, library

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import queries

DATA = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame([(9000, "Всё другое письмо совсем", None, None, 5), (9001, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns = docs.columns
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = corpus_pipeline.materialize(docs, "test-stage")
        left.append(docs.count())
    assert left[1] == left[0] - 2 and left[1] > left[2] >= left[3] >= left[4] > 0
    texts = [r.text for r in docs.select("text").collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


SYLLABLES = {"aa": "ba be bi bo bu da de".split(), "zz": "zor zul zim zat zer".split()}


def planted(r):
    """(doc_id, text, lang, source) with copies, near copies, benchmark passages and strangers; and the benchmark."""
    say = lambda k, n: " ".join("".join(r.choice(SYLLABLES[k]) for _ in range(r.randint(1, 4))) for _ in range(n))
    texts = [(say(k, r.randint(20, 90)), k) for k in (r.choice(["aa", "zz"]) for _ in range(160))]
    items = [(1, say("aa", 14)), (2, say("zz", 4)), (3, None)]
    for k in range(40):
        t, lang = texts[k]
        texts.append((t, lang))  # exact
        w = texts[40 + k][0].split()
        w[len(w) // 2] = "ba"
        texts.append((" ".join(w), texts[40 + k][1]))  # near, where the text is long enough
    for k in range(10):
        t, lang = texts[120 + k]
        texts.append((t + " " + items[k % 2][1] + " " + t, lang))
    texts += [(None, "aa"), ("", None), ("12 34 !", "aa"), ("другой алфавит совсем не похож", None), ("Das ist 漢字 alles", None)] * 2
    rows = [(k, t, lang, r.choice(["s1", "s1", "s2", None])) for k, (t, lang) in enumerate(texts)]
    return rows + [rows[0], rows[125], (None, *rows[126][1:])], items


def brute_run(rows, items, dropped):
    """The stages by hand, but for language ID, whose decisions are planted."""
    docs = [x for x in rows if x[0] not in dropped]
    key = lambda x: (x[0] is None, x[0] if x[0] is not None else 0)
    first = {}
    for x in sorted(docs, key=key):
        first.setdefault(x[1] or "", x)
    docs = list(first.values())
    number = {k: x for k, x in enumerate(sorted(docs, key=key))}
    docs = [number[k] for k, _, c in brute_components([(k, x[1]) for k, x in number.items()], 5, 8, 10) if c == k]
    hit = brute_hits([(k, x[1]) for k, x in enumerate(docs)], items, 10)
    docs = [x for x, h in zip(docs, hit) if not h[-1]]
    ids = {k: library(WORD, x[1]) + [1] for k, x in enumerate(docs)}
    own = {}
    for k, x in sorted(enumerate(docs), key=lambda e: (e[1][0] is not None, e[1][0] or 0)):
        own.setdefault(x[3], []).extend((k, i) for i in range(len(ids[k])))
    order = sorted(own, key=lambda s: (s is not None, s or ""))
    stream = brute_stream({s: own[s] for s in order}, {s: len(own[s]) ** corpus_pipeline.TEMPERATURE for s in order}, 2048)
    bounds, left = [], len(stream)
    while left:
        bounds.append(2048 if left >= 2048 else 1 << (left.bit_length() - 1))
        left -= bounds[-1]
    out, at = [], 0
    for seq, size in enumerate(bounds):
        begin = at
        while at < begin + size:
            k, i = stream[at]
            n = 1
            while at + n < begin + size and stream[at + n] == (k, i + n):
                n += 1
            out.append((docs[k][0], i, n, zlib.crc32(np.array(ids[k][i : i + n], dtype="<u4").tobytes()), len(ids[k]), seq, at - begin))
            at += n
    return out


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    r = random.Random(21)
    rows, items = planted(r)
    extra = [(*x, 7, 8, "y") for x in rows]
    spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, _id long, _hash long, rid string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dropped = {x[0] for x in rows if not x[1] or x[1].startswith(("12", "другой", "Das"))}
    want = brute_run(rows, items, dropped)
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(want) > 20 and whole(got) == whole(want)
    ids = {x[0]: np.array(library(WORD, x[1]) + [1], dtype="<u4") for x in rows}
    assert all(crc == zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n, crc, *_ in got)


def whole(pieces):
    """Where each id lies, whatever pieces it is cut into."""
    return sorted(((-1 if d is None else d), s + k, t, q, o + k) for d, s, n, _, t, q, o in pieces for k in range(n))


def test_stages_on_an_empty_table_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, _id long, _hash long, text_hash long, rid long"
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns
    some = spark.createDataFrame([(1, "same words here", "aa", "s", 1, 2, 3, 4)] * 3 + [(2, "same words here", "aa", "s", 5, 6, 7, 8)], schema)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        kept = stage(spark, some, str(tmp_path))
        assert kept.columns == some.columns and [x.doc_id for x in kept.collect()] == [1], name
    assert corpus_pipeline.decontaminate(spark, some, str(tmp_path)).count() == 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
