"""What a run reads and leaves behind: packed blocks, provenance, evaluation files, logged metrics."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import RunConfig, Section
from millrace.functions.text import CleanRules
from millrace.operators import mixture
from millrace.operators.blocks import pack_blocks, shard_of
from millrace.operators.metrics import loss_by_language
from millrace.operators.tokenizer import SPECIALS, encode, require_vocab, vocabulary_ids
from millrace.plans.scratch import materialize
from millrace.sources.readers import Source, read_frozen, read_sources
from millrace.sources.sinks import checksum, path_exists, write_text


def language_of(source: Section | Source) -> str:
    """``ko`` if the name or the subset says so, else ``en``."""
    said = f"{source.name} {source.subset or ''}".lower()
    return "ko" if "ko" in said else "en"


def packed_blocks(spark: SparkSession, sources: list[Section], run: RunConfig, tokenizer: str) -> DataFrame:
    """block_id, tokens: the sources cleaned, mixed, encoded between their begin and end ids, and cut at the context length."""
    require_vocab(tokenizer, run.model.vocab_size)
    rules = CleanRules(min_chars=run.data.min_doc_chars)
    docs = read_sources(spark, [Source(**{k: s[k] for k in ("name", "weight", "path", "text_key", "split", "revision", "subset")}) for s in sources], rules)
    begin, end = vocabulary_ids(tokenizer, SPECIALS[:2])
    ids = F.concat(F.array(F.lit(begin)), encode(F.col("text"), tokenizer), F.array(F.lit(end)))
    rows = materialize(docs.select("source", "ord", F.length("text").cast("long").alias("n_chars"), ids.alias("tokens")), "run-tokens", "zstd")
    unit = "documents" if run.data.mixture_weighting == "document" else F.col("n_chars")
    weights: dict[str, float] = {}
    for s in sources:
        weights[s.name] = weights.get(s.name, 0.0) + s.weight
    mixed = mixture.stride(mixture.with_length(rows, unit), weights)
    return pack_blocks(mixed, run.model.context_length, "pos")


def train_blocks(spark: SparkSession, run: RunConfig, tokenizer: str, rank: int = 0, world: int = 1, skip: int = 0) -> DataFrame:
    """The training blocks of one rank, without those it has seen."""
    return shard_of(packed_blocks(spark, run.data.sources, run, tokenizer), rank, world, skip)


def val_blocks(spark: SparkSession, run: RunConfig, tokenizer: str, rank: int = 0, world: int = 1) -> dict[str, DataFrame]:
    """The validation blocks of one rank by language; none without validation sources."""
    by: dict[str, list[Section]] = {}
    for s in run.data.val_sources:
        by.setdefault(language_of(s), []).append(s)
    return {lang: shard_of(packed_blocks(spark, sources, run, tokenizer), rank, world) for lang, sources in by.items()}


def benchmark_tasks(spark: SparkSession, run: RunConfig, during_training_only: bool = True) -> tuple[dict[str, tuple[str, DataFrame]], list[str]]:
    """Frozen sets by task with their language, and the names of tasks that are passed over as their file is missing."""
    ev = run.evaluation
    asked = [t for t in ev.downstream_tasks if ev.downstream_enabled and t.enabled and (t.during_training or not during_training_only)]
    there = {t.name: path_exists(spark, t.path) for t in asked}
    return {t.name: (t.language, read_frozen(spark, t.path)) for t in asked if there[t.name]}, [t.name for t in asked if not there[t.name]]


def scored(examples: DataFrame, scores: DataFrame, task: str, language: str) -> DataFrame:
    """Scores (ex_id, choice_idx, score) joined to the examples (id, label) they belong to; a choice without a score is an error later on, so it is kept with null."""
    choices = examples.select(F.col("id").alias("ex_id"), "label", F.explode(F.sequence(F.lit(0), F.size("choices") - 1)).alias("choice_idx"))
    joined = choices.join(scores.select("ex_id", "choice_idx", "score"), ["ex_id", "choice_idx"], "left")
    return joined.select(F.lit(task).alias("task"), F.lit(language).alias("language"), "ex_id", "choice_idx", "label", "score")


def manifest_files(run: RunConfig) -> list[str]:
    """The manifest beside each source's shards, each once, in order of the sources."""
    return list(dict.fromkeys(f"{s.path.rsplit('/', 1)[0]}/manifest.json" for s in [*run.data.sources, *run.data.val_sources] if s.path))


def provenance(spark: SparkSession, run: RunConfig, commit: str = "") -> dict:
    """The commit, checksums of the tokenizer and of the manifests that exist, and versions."""
    sums = {f: checksum(spark, f) for f in manifest_files(run)}
    return {
        "git_commit": commit,
        "tokenizer_id": {"path": run.tokenizer.path, "sha256": checksum(spark, f"{run.tokenizer.path}/tokenizer.json")},
        "data_manifests": {f: s for f, s in sums.items() if s is not None},
        "env": {"spark": spark.version, "python": platform.python_version()},
    }


def evaluation_result(run: RunConfig, checkpoint: str, parameters: int, max_batches: int, losses: DataFrame | None = None, tasks: DataFrame | None = None, aggregates: DataFrame | None = None, config_path: str = "") -> dict:
    """What an evaluation file holds: losses by language from token rows, task metrics and suite means; sections without rows are left out."""
    result: dict = {
        "run_name": run.project.run_name,
        "checkpoint": checkpoint,
        "parameters": {"total": parameters},
        "provenance": {"config": config_path, "val_sources": [s.path for s in run.data.val_sources], "max_batches": max_batches, "downstream_paths": [t.path for t in run.evaluation.downstream_tasks if t.enabled]},
    }
    if losses is not None:
        result["language_modeling"] = {r.lang: {"loss": r.loss, "perplexity": r.perplexity} for r in loss_by_language(losses).collect()}  # one row a language
    if tasks is not None:
        rows = [r.asDict() for r in tasks.collect()]  # one row a task
        means = [r.asDict() for r in aggregates.collect()] if aggregates is not None else []
        names = {"all": "overall"}
        result["downstream"] = {
            "tasks": {r["task"]: {k: v for k, v in r.items() if k != "task"} for r in rows},
            "aggregates": {f"{names.get(r['language'], r['language'])}_{k}": r[k] for r in means for k in ("avg", "chance", "above_chance")},
        }
    return result


def write_evaluation(spark: SparkSession, path: str, result: Mapping) -> None:
    write_text(spark, path, json.dumps(result, ensure_ascii=False, indent=2))


class MetricLog:
    """Metrics by step, one JSON line a call in files that the leaderboard and ``best_so_far`` can read as a table."""

    def __init__(self, spark: SparkSession, folder: str, run: str, echo: bool = True):
        self.spark, self.folder, self.run, self.echo, self.calls = spark, folder.rstrip("/"), run, echo, 0
        self.started = time.time_ns()

    def log(self, metrics: Mapping[str, float], step: int) -> None:
        rows = [json.dumps({"run": self.run, "step": step, "key": k, "value": float(v)}) for k, v in metrics.items()]
        write_text(self.spark, f"{self.folder}/{self.started}-{self.calls:09d}.jsonl", "".join(r + "\n" for r in rows))
        self.calls += 1
        if self.echo:
            print(f"[step {step}] " + " ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in metrics.items()))

    def rows(self) -> DataFrame:
        """run, step, key, value of everything logged to the folder."""
        return self.spark.read.schema("run string, step long, key string, value double").json(self.folder)
