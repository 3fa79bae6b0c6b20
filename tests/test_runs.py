import json

import pytest
from pyspark.sql import functions as F

from millrace.config import RunConfig
from millrace.operators import metrics, runs, tokenizer
from millrace.operators.leaderboard import ranked, result_rows
from millrace.sources.readers import read_evaluations
from millrace.sources.sinks import checksum, checksums, write_text


@pytest.fixture()
def run(spark, tmp_path):
    for lang, n in (("en", 60), ("ko", 20)):
        folder = tmp_path / lang
        folder.mkdir()
        (folder / "shard_00000.jsonl").write_text("".join(json.dumps({"text": f"{lang} document {i} of some length"}) + "\n" for i in range(n)))
        (folder / "manifest.json").write_text("{}")
    (tmp_path / "set.jsonl").write_text(json.dumps({"id": "1", "context": "c", "choices": ["a", "b"], "label": 1}) + "\n")
    source = lambda lang, w: {"name": f"set-{lang}", "path": f"{tmp_path}/{lang}/*.jsonl", "weight": w}
    tasks = [{"name": "there", "path": f"{tmp_path}/set.jsonl"}, {"name": "gone", "path": f"{tmp_path}/none.jsonl"}, {"name": "late", "path": f"{tmp_path}/set.jsonl", "during_training": False}, {"name": "off", "path": f"{tmp_path}/set.jsonl", "enabled": False}]
    values = {"project": {"run_name": "r1"}, "model": {"vocab_size": 320, "context_length": 16}, "tokenizer": {"path": f"{tmp_path}/tok"}, "data": {"sources": [source("en", 0.5), source("ko", 0.5)], "val_sources": [source("en", 1), source("ko", 1), source("en", 1)]}, "evaluation": {"downstream_tasks": tasks}}
    return RunConfig.from_dict(values)


@pytest.fixture()
def spec(spark, run):
    return tokenizer.train_bpe(spark.read.json(run.data.sources[0].path), 320, 1)


def test_blocks_of_a_run(spark, run, spec):
    blocks = runs.packed_blocks(spark, run.data.sources, run, spec).orderBy("block_id").collect()
    stream = [t for b in blocks for t in b.tokens]
    assert all(len(b.tokens) == 16 for b in blocks) and stream[0] == 0 and stream.count(0) >= 70
    some = runs.train_blocks(spark, run, spec, rank=1, world=3, skip=2).collect()
    assert sorted(b.block_id for b in some) == [b.block_id for b in blocks if b.block_id % 3 == 1][2:]
    val = runs.val_blocks(spark, run, spec)
    assert set(val) == {"en", "ko"} and val["ko"].count() > 0
    assert runs.val_blocks(spark, RunConfig.from_dict({}), spec) == {}
    run.model.vocab_size = 321
    with pytest.raises(ValueError):
        runs.train_blocks(spark, run, spec)


def test_tasks_whose_file_is_missing_are_named(spark, run):
    found, missing = runs.benchmark_tasks(spark, run)
    assert list(found) == ["there"] and missing == ["gone"] and found["there"][1].count() == 1
    assert list(runs.benchmark_tasks(spark, run, during_training_only=False)[0]) == ["there", "late"]
    run.evaluation.downstream_enabled = False
    assert runs.benchmark_tasks(spark, run) == ({}, [])


def test_provenance(spark, run, tmp_path):
    write_text(spark, f"{tmp_path}/tok/tokenizer.json", "{}")
    got = runs.provenance(spark, run, commit="abc")
    assert runs.manifest_files(run) == [f"{tmp_path}/en/manifest.json", f"{tmp_path}/ko/manifest.json"]
    assert list(got["data_manifests"]) == runs.manifest_files(run) and got["git_commit"] == "abc"
    assert got["tokenizer_id"]["sha256"] == checksum(spark, f"{tmp_path}/tok/tokenizer.json") == got["data_manifests"][f"{tmp_path}/en/manifest.json"]
    (tmp_path / "ko/manifest.json").unlink()
    assert len(runs.provenance(spark, run)["data_manifests"]) == 1


def test_checksums_of_files(spark, tmp_path, monkeypatch):
    import hashlib

    from millrace.sources import files

    for k in range(3):
        (tmp_path / f"f{k}").write_bytes(b"x" * (k * 100))
    monkeypatch.setattr(files, "PIECE", 7)
    assert files.sha256_of(f"file:{tmp_path}/f2") == (200, hashlib.sha256(b"x" * 200).hexdigest())
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in checksums(spark, [f"{tmp_path}/f{k}" for k in range(3)]).collect()}
    assert got == {f"f{k}": (k * 100, hashlib.sha256(b"x" * (k * 100)).hexdigest()) for k in range(3)}


def test_evaluation_file(spark, run, tmp_path):
    examples = spark.createDataFrame([("1", ["a", "b"], 1), ("2", ["a", "b", "c"], 0)], "id string, choices array<string>, label int")
    scores = spark.createDataFrame([("1", 0, -2.0), ("1", 1, -1.0), ("2", 0, -3.0), ("2", 1, -1.0), ("2", 2, -9.0)], "ex_id string, choice_idx int, score double")
    tasks = metrics.task_metrics(runs.scored(examples, scores, "t", "en"))
    losses = spark.createDataFrame([("en", 1.0, 5), ("ko", 3.0, 5), ("ko", 9.0, -100)], "lang string, nll double, label int")
    result = runs.evaluation_result(run, "out/step.pt", 7, 50, losses, tasks, metrics.suite_aggregates(tasks))
    assert result["language_modeling"]["all"]["loss"] == 2.0 and result["downstream"]["tasks"]["t"]["acc_norm"] == 0.5
    assert result["downstream"]["aggregates"]["en_avg"] == result["downstream"]["aggregates"]["overall_avg"] == 0.5
    runs.write_evaluation(spark, f"{tmp_path}/res/r1.json", result)
    row = ranked(result_rows(read_evaluations(spark, f"{tmp_path}/res/*.json"))).first()
    assert (row.rank, row.model, row.parameters, row.loss, row.en_avg, row.max_batches) == (1, "r1", 7, 2.0, 0.5, 50)
    assert "downstream" not in runs.evaluation_result(run, "c", 1, 1)


def test_metric_log(spark, tmp_path, capsys):
    log = runs.MetricLog(spark, f"{tmp_path}/log", "r1")
    for step, loss in enumerate([3.0, 2.0, 2.5]):
        log.log({"loss": loss, "tokens": step}, step)
    assert "[step 1] loss=2.0000 tokens=1" in capsys.readouterr().out
    rows = log.rows().where("key = 'loss'").select("run", F.lit("all").alias("lang"), "step", F.col("value").alias("loss"))
    assert [r.regressed for r in metrics.best_so_far(rows).orderBy("step").collect()] == [False, False, True]
