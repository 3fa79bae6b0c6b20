"""Documents from shards of JSON lines, Parquet and plain text."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import CleanRules, clean, unicode_strip
from millrace.operators.ordering import buffer_shuffle, shuffled_files
from millrace.plans.scratch import materialize

#: An escaped UTF-16 half without its other half, where each escaped backslash is written as a number.
LONE_HALF = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"
#: Files, or splits of text files, that are broadcast with a number each at most; above it, rows are shuffled.
BROADCAST_SPLITS = 1_000_000


@dataclass(frozen=True)
class Source:
    name: str
    weight: float = 1.0
    path: str | None = None
    text_key: str = "text"
    split: str = "train"
    revision: str | None = None
    subset: str | None = None


def shard_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match, in order; none is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = store.globStatus(path)
    files: list[str] = []
    for status in found or []:
        if status.isDirectory():
            files += [s.getPath().toString() for s in store.listStatus(status.getPath()) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        else:
            files.append(status.getPath().toString())
    if not files:
        raise FileNotFoundError(f"no shard matches {pattern}")
    return sorted(files)


def _place():
    """Sorts as the rows stand: by file, split and row.  No shuffle numbers them."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("ord")


def _json_text(line: Column, text_key: str) -> Column:
    """The text of a line that is one JSON object and nothing else, null for any other.

    The line is read as the first of two elements, the second being a mark that no line can
    hold: what follows the object, or closes the list, moves the mark.  A lone half of a
    UTF-16 pair is replaced by another mark, as it spoils the line only in its text.
    """
    mark = uuid.uuid4().hex
    plain = F.regexp_replace(F.regexp_replace(line, r"\\\\", r"\\u005c"), LONE_HALF, mark)
    safe = F.when(line.rlike(r"\\u[dD][89a-fA-F]"), plain).otherwise(line)
    schema = T.ArrayType(T.StructType([T.StructField(text_key, T.StringType()), T.StructField(mark, T.IntegerType())]))
    pair = F.from_json(F.concat(F.lit("["), safe, F.lit(f',{{"{mark}":1}}]')), schema, {"allowSingleQuotes": "false"})
    text = F.get(pair, F.lit(0))[text_key]
    return F.when((F.size(pair) == 2) & (F.get(pair, F.lit(1))[mark] == 1) & ~text.contains(mark), text)


def _jsonl(spark: SparkSession, files: list[str] | str, text_key: str) -> DataFrame:
    lines = spark.read.text(files).select(_place(), "value").where(unicode_strip(F.col("value")) != "")
    return lines.select("ord", _json_text(F.col("value"), text_key).alias("text")).where("text is not null and text <> ''")


def _parquet(spark: SparkSession, files: list[str] | str, text_key: str) -> DataFrame:
    rows = spark.read.parquet(*([files] if isinstance(files, str) else files))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("start"), F.col("_metadata.row_index").alias("row")).alias("ord")
    return rows.select(place, F.col(text_key).alias("text")).where("text is not null and text <> ''")


def read_jsonl(spark: SparkSession, files: list[str] | str, text_key: str = "text") -> DataFrame:
    """text of every line that is one object with a non-empty text; other lines are skipped."""
    return _jsonl(spark, files, text_key).select("text")


def read_parquet_text(spark: SparkSession, files: list[str] | str, text_key: str = "text") -> DataFrame:
    """One column is read; null and empty texts are skipped."""
    return _parquet(spark, files, text_key).select("text")


def read_plain_lines(spark: SparkSession, files: list[str] | str) -> DataFrame:
    """One document per line that is not blank."""
    return spark.read.text(files).where(unicode_strip(F.col("value")) != "").select(F.col("value").alias("text"))


#: Session settings: the folder that holds copies of remote sets, and the address of listings of them.
MIRROR, LISTING = "millrace.mirror", "millrace.listing"


def mirrored(spark: SparkSession, source: Source) -> Source:
    """A source without a path, found in the mirror of remote sets by name, revision, subset and split."""
    root = spark.conf.get(MIRROR, None)
    if not root:
        raise ValueError(f"source {source.name} has no path, and neither {MIRROR} names a folder with copies of remote sets nor {LISTING} a listing of them")
    return replace(source, path=f"{root.rstrip('/')}/{source.name}/{source.revision or 'main'}/{source.subset or 'default'}/{source.split}/*")


def _remote(spark: SparkSession, source: Source, listing: str, file_seed: int | None) -> tuple[list[str], DataFrame]:
    """Names of a set's files, and its rows in their order, or in a seeded order of them."""
    from millrace.sources import remote

    remote.register(spark)
    options = {k: v for k, v in (("listing", listing), ("name", source.name), ("subset", source.subset), ("split", source.split), ("revision", source.revision), ("text_key", source.text_key)) if v}
    names = [f.name for f in remote.listed_files(options)]
    rows = spark.read.format("remote_set").options(**options).load()
    file = F.col("file")
    if file_seed is not None:
        order = spark.createDataFrame([(f, f"{k:09d}") for k, f in enumerate(shuffled_files(names, file_seed))], "named string, place string")
        rows, file = rows.join(F.broadcast(order) if len(names) <= BROADCAST_SPLITS else order, F.col("file") == F.col("named")), F.col("place")
    return names, rows.select(F.struct(file.alias("file"), F.lit(0).cast("long").alias("start"), "row").alias("ord"), "text")


def _in_file_order(rows: DataFrame, files: list[str]) -> DataFrame:
    """``ord`` with each file's place in the list instead of its name; the list came from the driver and is as long there."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    places = rows.sparkSession.createDataFrame([(f, f"{k:09d}") for k, f in enumerate(files)], "__file string, __place string").withColumn("__file", plain(F.col("__file")))
    joined = rows.join(F.broadcast(places) if len(files) <= BROADCAST_SPLITS else places, plain(F.col("ord.file")) == F.col("__file"))
    return joined.select("source", F.struct(F.col("__place").alias("file"), F.col("ord.start").alias("start"), F.col("ord.row").alias("row")).alias("ord"), "text")


def _row_in_file(spark: SparkSession, rows: DataFrame, files: list[str]) -> DataFrame:
    """Adds ``name``, the file's path below the folder that all files are in, and ``line``, the row's number in it.

    Neither depends on how files are split or where they lie.  Parquet knows its row
    numbers; lines of text are counted once, by split, before they are read.
    """
    uri = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString()
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    common = re.sub("^file:/+", "file:/", uri(os.path.commonpath([f.rsplit("/", 1)[0] for f in files])))
    name = F.substr(plain(F.col("ord.file")), F.lit(len(common) + 2)).alias("name")
    if files[0].endswith(".parquet"):
        return rows.select("*", name, F.col("ord.row").alias("line"))
    split = spark.read.text(files).select(_place()).groupBy(F.col("ord.file").alias("f"), F.col("ord.start").alias("s")).agg(F.min("ord.row").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    split = materialize(split.select("f", "s", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")), "file-splits")
    here = F.broadcast(split) if split.count() <= BROADCAST_SPLITS else split
    joined = rows.join(here, (F.col("ord.file") == F.col("f")) & (F.col("ord.start") == F.col("s")), "left")
    line = F.when(F.col("shift").isNotNull(), F.col("ord.row") + F.col("shift")).otherwise(F.raise_error(F.lit("the files were split in another way when their lines were counted")).cast("long"))
    return joined.select(*[rows[c] for c in rows.columns], name, line.alias("line"))


def read_source(spark: SparkSession, source: Source, rules: CleanRules | None = None, shuffle_seed: int | None = None, shuffle_buffer: int = 0, shuffle: str = "hash") -> DataFrame:
    """source, ord, text: the kind of the first file in order decides the reader; shuffled, then cleaned.

    ``hash`` gives every row a seeded pseudo-random place by its file's name and its number
    in it, the same wherever the files lie and however they are split, without any shuffle of data;
    ``buffer`` replays a seeded order of the files and a shuffle buffer over it.
    """
    if shuffle not in ("hash", "buffer"):
        raise ValueError(f"shuffle is hash or buffer, not {shuffle!r}")
    shuffled = shuffle_seed is not None and shuffle_buffer > 1
    listing = spark.conf.get(LISTING, None) if not source.path else None
    if listing:
        files, rows = _remote(spark, source, listing, shuffle_seed - 1 if shuffled and shuffle == "buffer" else None)
    else:
        source = source if source.path else mirrored(spark, source)
        files = shard_files(spark, source.path)
        rows = (_parquet if files[0].endswith(".parquet") else _jsonl)(spark, files, source.text_key)
    rows = rows.select(F.lit(source.name).alias("source"), "ord", "text")
    if shuffled and shuffle == "hash":
        rows = rows.select("*", F.col("ord.file").alias("name"), F.col("ord.row").alias("line")) if listing else _row_in_file(spark, rows, files)
        mixed = F.sha2(F.concat_ws("|", F.lit(str(shuffle_seed)), "name", F.col("line").cast("string")), 256)
        rows = rows.select("source", F.struct(mixed.alias("file"), F.lit(0).cast("long").alias("start"), F.col("line").alias("row")).alias("ord"), "text")
    elif shuffled:
        ordered = rows if listing else _in_file_order(rows, shuffled_files(files, shuffle_seed - 1))
        rows = buffer_shuffle(ordered, shuffle_seed, shuffle_buffer, "ord", "source").select("source", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), F.col("pos").alias("row")).alias("ord"), "text")
    return clean(rows, rules) if rules else rows


def read_sources(spark: SparkSession, sources: list[Source], rules: CleanRules | None = None, seed: int | None = None, buffer_size: int = 0, shuffle: str = "hash") -> DataFrame:
    """All sources in one frame; source i shuffles its files with seed + i and its rows with seed + i + 1."""
    out = None
    for i, s in enumerate(sources):
        one = read_source(spark, s, rules, None if seed is None else seed + i + 1, buffer_size, shuffle)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no sources")
    return out


def read_training_text(spark: SparkSession, pattern: str, text_key: str = "text") -> DataFrame:
    """Texts a tokenizer is trained on: JSON lines by record, any other file by line."""
    return read_training_files(spark, shard_files(spark, pattern), text_key)


def read_training_files(spark: SparkSession, files: list[str], text_key: str = "text") -> DataFrame:
    json_files, plain = [f for f in files if f.endswith(".jsonl")], [f for f in files if not f.endswith(".jsonl")]
    parts = ([read_jsonl(spark, json_files, text_key)] if json_files else []) + ([read_plain_lines(spark, plain)] if plain else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


FROZEN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.StringType())),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """A frozen benchmark set; a missing context is empty."""
    return spark.read.schema(FROZEN).json(path).withColumn("context", F.coalesce("context", F.lit("")))


def read_evaluations(spark: SparkSession, pattern: str) -> DataFrame:
    """Evaluation files but leaderboards, with ``file``; none is an error."""
    from millrace.operators.leaderboard import EVALUATION

    files = [f for f in shard_files(spark, pattern) if not f.rsplit("/", 1)[-1].startswith("leaderboard")]
    if not files:
        raise FileNotFoundError(f"no evaluation matches {pattern}")
    return spark.read.schema(EVALUATION).option("multiLine", True).json(files).withColumn("file", F.input_file_name())
