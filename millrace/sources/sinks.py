"""Shards, manifests and checksums."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.budget import assign_shards
from millrace.plans.scratch import bounded_arrow_batches, materialize
from millrace.sources.files import attempt, move_once, qualified, sha256_of, store_of


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file (a manifest, a report) in whatever store the path names; readers find the old one or the new one, whole."""
    p, store = _store(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = store.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(store.makeQualified(beside), store.makeQualified(p), how)


def read_text(spark: SparkSession, path: str) -> str:
    p, store = _store(spark, path)
    stream = store.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    p, store = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(p)] if store.exists(p) else []


def path_exists(spark: SparkSession, path: str) -> bool:
    p, store = _store(spark, path)
    return store.exists(p)


def checksum(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of one file of any size, read a piece at a time; None if there is none."""
    p, store = _store(spark, path)
    if not store.exists(p):
        return None
    digest = spark._jvm.org.apache.commons.codec.digest.DigestUtils
    stream = store.open(p)
    try:
        return digest.sha256Hex(stream)
    finally:
        stream.close()


def shard_name(folder: str, k: int) -> str:
    return f"{folder}/shard_{k:05d}.jsonl"


def commit_shards(docs: DataFrame, folder: str, order_by: list[str], per_shard: int = 100_000, text_col: str = "text") -> DataFrame:
    """Writes JSON lines in ``shard_00000.jsonl`` and so on, ``per_shard`` documents each, in order; shard, docs, bytes, sha256 of each.

    Tasks write a shard each at a time, under a name of their attempt, and report what they
    have written, digest and all; the list of committed tasks is a table.  Tasks rename what
    is in it, each file once; nothing of a failed attempt ever has a shard's name.  A corpus
    that fills its last shard exactly, and an empty one, end in an empty shard.
    """
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    home = qualified(spark, folder).rstrip("/")
    parts = f"{home}/_attempts-{uuid.uuid4().hex}"
    lines = assign_shards(docs, order_by, per_shard).select("shard", "in_shard", F.to_json(F.struct(F.col(text_col).alias("text"))).alias("value"))
    lines = lines.repartition("shard").sortWithinPartitions("shard", "in_shard").select("shard", "value")

    def write(batches):
        store, at = store_of(parts)
        store.create_dir(at, recursive=True)
        own, out, made = None, None, None

        def finished():
            out.close()
            return pa.RecordBatch.from_pylist([{"shard": own, "name": made[0], "docs": made[1], "bytes": made[2], "sha256": made[3].hexdigest()}])

        for b in batches:
            for shard, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard != own:
                    if own is not None:
                        yield finished()
                    own, made = shard, [f"{shard}-{attempt()}", 0, 0, hashlib.sha256()]
                    out = store.open_output_stream(f"{at}/{made[0]}")
                line = (value + "\n").encode()
                out.write(line)
                made[1], made[2] = made[1] + 1, made[2] + len(line)
                made[3].update(line)
        if own is not None:
            yield finished()

    written = materialize(lines.mapInArrow(write, "shard long, name string, docs long, bytes long, sha256 string"), "shards")

    def move(batches):
        for b in batches:
            for shard, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                move_once(f"{parts}/{name}", shard_name(home, shard))
            yield b.select([0])

    p, store = _store(spark, home)
    store.mkdirs(p)
    count = written.count()
    moved = written.select("shard", "name").repartition(max(1, min(count, 1024)), "shard").mapInArrow(move, "shard long").count()
    if moved != count:
        raise RuntimeError(f"{moved} of {count} shards were renamed")
    store.delete(spark._jvm.org.apache.hadoop.fs.Path(parts), True)
    last = written.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    done = written.drop("name")
    if last % per_shard == 0:
        store.create(spark._jvm.org.apache.hadoop.fs.Path(shard_name(home, last // per_shard)), True).close()
        done = done.unionByName(spark.createDataFrame([(last // per_shard, 0, 0, hashlib.sha256().hexdigest())], "shard long, docs long, bytes long, sha256 string"))
    return done


def write_shards(docs: DataFrame, folder: str, order_by: list[str], per_shard: int = 100_000, text_col: str = "text") -> list[str]:
    """The names of the shards that ``commit_shards`` writes."""
    return [shard_name(folder, k) for k in range(commit_shards(docs, folder, order_by, per_shard, text_col).count())]


def checksums(spark: SparkSession, files: list[str]) -> DataFrame:
    """path, bytes, sha256 of files of any size: tasks read them a piece at a time."""
    rows = spark.createDataFrame([(qualified(spark, f),) for f in files], "path string").repartition(max(1, min(len(files), 1024)))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                size, digest = sha256_of(path)
                yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "sha256": digest}])

    return rows.mapInArrow(run, "path string, bytes long, sha256 string")


def manifest(spark: SparkSession, files: list[str], info: dict, totals: dict, sums: dict[str, str] | None = None) -> dict:
    """What a corpus is made of, and the checksum of each shard, by its name; read again unless given."""
    if sums is None:
        sums = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in checksums(spark, files).collect()}  # one row a shard
    names = [f.rsplit("/", 1)[-1] for f in files]
    return {**info, "document_count": totals["docs"], "byte_count": totals["bytes"], **({"token_count": totals["tokens"]} if "tokens" in totals else {}), "shards": [{"path": n, "sha256": sums[n]} for n in names]}


def write_manifest(spark: SparkSession, folder: str, content: dict) -> str:
    path = f"{folder}/manifest.json"
    write_text(spark, path, json.dumps(content, ensure_ascii=False, indent=2) + "\n")
    return path


def write_frozen(records: DataFrame, path: str) -> None:
    """One JSON line per record in one file; fields that are null are left out."""
    records.select("id", "context", "contexts", "choices", "label").coalesce(1).write.mode("overwrite").json(path)


def keep_newest(names: DataFrame, keep: int, name: str = "name") -> DataFrame:
    """Names that a rotation would delete: all but the last ``keep`` in order; none for ``keep`` below 1."""
    if keep < 1:
        return names.limit(0)
    kept = names.select(F.col(name).alias("__kept")).orderBy(F.desc("__kept")).limit(keep)  # a top-k: no task sorts all names
    return names.join(F.broadcast(kept) if keep <= 100_000 else kept, F.col(name) == F.col("__kept"), "left_anti")
