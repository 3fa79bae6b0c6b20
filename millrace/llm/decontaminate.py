"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of ``window`` consecutive words (a shorter item is one
window) and a window into shingles of ``SHINGLE`` words.  For a window to occur in
a document, all its shingles must; so one of them, the necessary prefix token,
suffices as join key.  Shingles are ordered by how often the documents hold them,
and each window is joined by its rarest.  A match at position p of shingle j puts
the window's start at p - j, which must leave room for the window inside the
document.  Each start that is left is verified: every shingle of the window, equal
word by word, at its own place.

The benchmark's shingles are broadcast if they number ``BROADCAST_SHINGLES`` at
most, else joined by shuffle.  Documents pass through Python nowhere.

Defined cases: null text has no words; a document without words has no hits; null
or repeated ``doc_id`` are rows of their own; items without words or without an id
are left out; an empty benchmark marks nothing and an empty table gives no rows;
texts of any length are searched whole; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import materialize

# A word is a run of characters outside ASCII, digits and small letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a shingle: so many that few but those of whole windows are found, and written, before windows are joined.
SHINGLE = 6
BROADCAST_SHINGLES = 1_000_000


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; ``lower`` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingle_hash(hashes: Column, at: Column, k: int) -> Column:
    """Of ``k`` word hashes from a place on; fewer at the end."""
    return F.xxhash64(F.lit(k), *[F.get(hashes, at + i) for i in range(k)])


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hash_at(k: int):
    return lambda _, i: _shingle_hash(F.col("wh"), i, k)


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, win, size, k, j, piece, h: every shingle of every window of an item."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("item", F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    wins = items.select("item_id", "item", "w", F.explode(starts).alias("first"))
    wins = wins.select("item_id", F.struct("item", "first").alias("win"), F.slice("w", F.col("first") + 1, window).alias("w"))
    wins = wins.select("*", F.size("w").alias("size"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"))
    parts = wins.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("j"))
    parts = parts.withColumn("wh", _word_hashes(F.col("w")))
    h = reduce(lambda rest, k: F.when(F.col("k") == k, _shingle_hash(F.col("wh"), F.col("j"), k)).otherwise(rest), range(1, SHINGLE + 1), F.lit(None).cast("long"))
    return parts.select("item_id", "win", "size", "k", "j", F.slice("w", F.col("j") + 1, F.col("k")).alias("piece"), h.alias("h"))


def _matches(docs: DataFrame, pieces: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, text_hash, n_words, pos, sid: where documents hold benchmark shingles.

    One pass over the texts looks for shingles of all lengths: of each length there is a
    hash for every word, one length after the other.  Each row also comes once with
    pos = -1, so the pass gives the counts of words too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("w"))
    lengths = sorted(r[0] for r in pieces.select("k").distinct().collect()) or [SHINGLE]  # at most SHINGLE numbers
    mark = F.lit(0).cast("long")
    # hashed in steps of their own, as an interpreted lambda inside the explode would copy the words once per word;
    # outer, as otherwise a filter on the hashes is inferred, and pushed to where the words are not split yet
    rows = rows.select("*", F.size("w").alias("n_words"), _word_hashes(F.col("w")).alias("wh"))
    hashed = rows.select("rid", "doc_id", "text_hash", "w", "n_words", F.concat(F.array(mark), *[F.transform(F.col("w"), _hash_at(k)) for k in lengths]).alias("hashes"))
    spread = hashed.select("rid", "doc_id", "text_hash", "w", "n_words", F.posexplode_outer("hashes").alias("at", "hh"))
    pos = F.when(F.col("at") > 0, (F.col("at") - 1) % F.col("n_words")).otherwise(-1)
    size = F.get(F.array(*[F.lit(k) for k in lengths]), F.when(F.col("at") > 0, F.floor((F.col("at") - 1) / F.col("n_words")).cast("int")).otherwise(0))
    here = F.slice("w", F.greatest(pos, F.lit(0)) + 1, size)
    known = pieces.select("sid", "k", "h", "piece").unionByName(docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("sid"), F.lit(0).alias("k"), mark.alias("h"), F.lit(None).cast("array<string>").alias("piece")))
    if pieces.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    else:  # what is shuffled holds a shingle, not all words
        spread = spread.withColumn("here", here).drop("w")
        here = F.col("here")
    same = (F.col("hh") == F.col("h")) & F.when(F.col("sid") < 0, F.col("at") == 0).otherwise((F.col("at") > 0) & (size == F.col("k")) & (here == F.col("piece")))
    return spread.join(known, same).select("rid", "doc_id", "text_hash", "n_words", pos.alias("pos"), "sid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; and text_hash, xxhash64 of the text."""
    parts = materialize(benchmark_windows(benchmark, window, item_col, item_text), "leak-windows")
    pieces = materialize(parts.groupBy("k", "h", "piece").agg(F.count(F.lit(1)).alias("uses")).withColumn("sid", F.monotonically_increasing_id()), "leak-shingles")
    found = materialize(_matches(docs, pieces, id_col, text_col), "leak-matches")

    held = found.where("sid >= 0")
    often = held.groupBy("sid").agg(F.count(F.lit(1)).alias("often"))
    named = parts.join(pieces.select("sid", "k", "h", "piece"), ["k", "h", "piece"]).select("item_id", "win", "size", "k", "j", "sid")
    rated = named.join(often, "sid", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    prefix = rated.groupBy("win").agg(F.min(F.struct("often", "j", "sid")).alias("rarest"), F.first("item_id").alias("item_id"), F.first("size").alias("size"), F.first("k").alias("k"))
    prefix = prefix.where("rarest.often > 0").select("win", "item_id", "size", "k", F.col("rarest.j").alias("j0"), F.col("rarest.sid").alias("sid"))

    start = F.col("pos") - F.col("j0")
    starts = held.join(prefix, "sid").where((start >= 0) & (start + F.col("size") <= F.col("n_words"))).select("rid", "win", "item_id", "size", "k", start.alias("start"))
    shingles = named.select(F.col("win").alias("of"), "j", F.col("sid").alias("must"))
    wanted = starts.join(shingles, starts["win"] == shingles["of"]).select("rid", "win", "item_id", "size", "k", "start", (F.col("start") + F.col("j")).alias("at"), "must")
    there = held.select(F.col("rid").alias("r"), F.col("pos").alias("p"), F.col("sid").alias("s"))
    checked = wanted.join(there, (wanted["rid"] == there["r"]) & (wanted["at"] == there["p"]) & (wanted["must"] == there["s"]))
    occurs = checked.groupBy("rid", "win", "start").agg(F.count(F.lit(1)).alias("n"), F.first("item_id").alias("item_id"), F.first("size").alias("size"), F.first("k").alias("k"))
    occurs = materialize(occurs.where(F.col("n") == F.col("size") - F.col("k") + 1).select("rid", "item_id", "start", "size"), "leak-occurrences")

    hit = occurs.select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at")).distinct().groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit"))
    items = occurs.groupBy("rid").agg(F.collect_set("item_id").alias("items"))
    rows = found.where("sid < 0").select("rid", "doc_id", "text_hash", "n_words")
    joined = rows.join(hit, "rid", "left").join(items, "rid", "left")
    ids = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "text_hash",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **columns) -> DataFrame:
    """One row per document with its hits."""
    return contamination(docs, benchmark, window, **columns).drop("text_hash")
