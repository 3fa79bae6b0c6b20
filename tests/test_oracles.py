"""Every query with SQL gives what DuckDB gives over the same tables."""

import glob
import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def flat(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(map(str, ([cell(v) for v in r] for r in frame.astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), duck.execute(core.ORACLES[name]).df()
    assert flat(got) == flat(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["lang", "docs", "bytes", "chars"]


def test_whole_texts_are_cleaned_and_tagged(spark, tmp_path):
    """What lies beyond every prefix counts."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    body = "x" * 300
    text = f"{body}\x02e\u0301 ko \u2003"
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda name: core.QUERIES[name](spark, str(tmp_path)).first().digest
    assert digest("strip_control_characters") == sha(f"{body}e\u0301 ko \u2003\tx")
    assert digest("strip_unicode_space") == sha(f"{body}\x02e\u0301 ko")
    assert digest("nfc_normalise") == sha(f"\u00e9{body}\x02\u00e9 ko \u2003")
    assert core.QUERIES["tag_language"](spark, str(tmp_path)).first().tag == "ko"
