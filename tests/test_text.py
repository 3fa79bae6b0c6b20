import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.text import WHITE_CHARS, unicode_rstrip, unicode_strip
from millrace.functions.holdout import is_validation, take_split

CASES = [None, "", "   ", "too short", "hello\x00\x07 world, long enough", "a\nb\tc and some more text", "가나다라마바사아자차카타파하거너", " padded with wide spaces　\xa0", "\x1cedge\x1f of separators 123", "​zero width is no space﻿"]


def reference_clean(t, min_chars=16):
    if not t:
        return None
    t = "".join(c for c in t if not (ord(c) < 32 and c not in "\t\n\r") and ord(c) != 127).strip()
    return t if len(t) >= min_chars else None


def test_clean_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, text string")
    got = {r.id: r.text for r in T.clean(df).collect()}
    want = {i: reference_clean(t) for i, t in enumerate(CASES)}
    assert got == {i: t for i, t in want.items() if t is not None}


def test_drop_reasons_agree_with_clean(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, text string")
    kept = {r.id for r in T.clean(df).collect()}
    reasons = {r.id: r.reason for r in df.select("id", T.drop_reason(F.col("text")).alias("reason")).collect()}
    assert {i for i, why in reasons.items() if why == "kept"} == kept
    assert reasons[0] == "missing" and reasons[2] == "blank" and reasons[3] == "short"


def test_words_and_nfc(spark):
    df = spark.createDataFrame([(t,) for t in CASES if t is not None], "text string")
    for r in df.select("text", T.word_count(F.col("text")).alias("n"), T.nfc(F.col("text")).alias("nfc")).collect():
        assert r.n == len(r.text.split())
        assert r.nfc == unicodedata.normalize("NFC", r.text)


def test_invalid_utf8_is_dropped(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"abcdefghijklmnopqrst\nabcdefghijklmnopq\xff\xfe\n")
    df = spark.read.text(str(tmp_path / "x.txt")).withColumnRenamed("value", "text")
    assert [r.text for r in T.clean(df).collect()] == ["abcdefghijklmnopqrst"]


def test_source_label_falls_through(spark):
    df = spark.createDataFrame([("a", "x/y/z.pt", "f.json"), ("", "x/y/z.pt", "f.json"), (None, "", "d/f.json"), ("", None, "f.tar.json")], "n string, c string, f string")
    assert [r[0] for r in df.select(T.source_label(F.col("n"), F.col("c"), F.col("f"))).collect()] == ["a", "y/z", "f", "f.tar"]


def test_holdout_is_by_content_and_about_the_rate(spark):
    import hashlib

    texts = [f"doc {i} padded to a reasonable document length" for i in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:50]], "text string")
    val = [r.text for r in take_split(df, "val", 10).collect()]
    want = [t for t in texts + texts[:50] if int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") % 10 == 0]
    assert sorted(val) == sorted(want)
    assert 0.05 < len(set(val)) / len(texts) < 0.15
    train = take_split(df, "train", 10)
    assert train.count() + len(val) == 2050
    assert not {r.text for r in train.collect()} & set(val)
    with pytest.raises(ValueError):
        take_split(df, "dev", 10)
    assert take_split(df, "all", 10).count() == 2050
    assert df.where(is_validation(F.col("text"), 10)).count() == len(val)


def test_many_blanks_take_linear_time(spark):
    """A megabyte of blanks inside a text that also ends in one."""
    import time

    text = "x" + " " * (1 << 20) + "y \u2003"
    df = spark.createDataFrame([(text,)], "t string").cache()
    df.count()
    start = time.time()
    assert df.select(F.length(unicode_strip(F.col("t"))), F.length(unicode_rstrip(F.concat(F.lit(" "), "t")))).first() == ((1 << 20) + 2, (1 << 20) + 3)
    assert time.time() - start < 5


def test_strip_is_that_of_unicode(spark):
    rows = [c * k + "a" + c + "b" + c * k for c in WHITE_CHARS + "\u200b\u180e\x00" for k in range(3)] + ["", " \t\u3000", None]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", unicode_strip(F.col("t")).alias("s"), unicode_rstrip(F.col("t")).alias("r")).collect()
    assert all(r.s == r.t.strip() and r.r == r.t.rstrip() for r in got if r.t is not None) and set(WHITE_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
