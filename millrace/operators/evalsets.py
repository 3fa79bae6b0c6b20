"""Frozen benchmark sets: formatted, sampled, described."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import seeded_sample, stratified_sample
from millrace.plans.scratch import materialize


@dataclass(frozen=True)
class TaskSpec:
    name: str
    record: Column
    language: str = "en"
    n: int | None = 500
    stratified: bool = False
    seed: int = 0
    enabled: bool = True
    during_training: bool = True


def usable(raw: DataFrame, record: Column, id_col: str) -> DataFrame:
    """id, context, contexts, choices, label of rows with an answer."""
    return raw.select(F.col(id_col).cast("string").alias("id"), record.alias("r")).where("r is not null").select("id", "r.*")


def build_task(raw: DataFrame, spec: TaskSpec, id_col: str) -> tuple[DataFrame, dict]:
    """The sample and its description."""
    good = materialize(usable(raw, spec.record, id_col), "task")
    picked = stratified_sample(good, spec.n, spec.seed, "id", "label").drop("picked") if spec.stratified and spec.n else seeded_sample(good, spec.n, spec.seed, "id")
    picked = materialize(picked, "task-sample")
    d = picked.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.size("choices"))).alias("choice_counts"), F.array_sort(F.collect_set("label")).alias("labels")).first()
    size = raw.count()
    return picked, {"task": spec.name, "language": spec.language, "size": size, "dropped": size - good.count(), "sample_size": d.n, "choice_counts": d.choice_counts, "labels": d.labels, "seed": spec.seed, "stratified": spec.stratified}


def choice_rows(records: DataFrame) -> DataFrame:
    """id, choice_idx, context, choice, label; a record's own contexts go with their choices."""
    both = F.arrays_zip(F.coalesce("contexts", F.transform("choices", lambda _: F.col("context"))).alias("context"), F.col("choices").alias("choice"))
    return records.select("id", "label", F.posexplode(both).alias("choice_idx", "z")).select("id", "choice_idx", F.col("z.context").alias("context"), F.col("z.choice").alias("choice"), "label")


def unknown_names(asked: DataFrame, known: DataFrame, name: str = "task") -> DataFrame:
    return asked.select(name).distinct().join(known.select(name), name, "left_anti")


def enabled_tasks(specs: list[TaskSpec], during_training_only: bool = False) -> list[TaskSpec]:
    return [s for s in specs if s.enabled and (s.during_training or not during_training_only)]
