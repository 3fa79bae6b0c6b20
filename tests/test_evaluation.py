import json
import math

from pyspark.sql import functions as F

from millrace.functions import numeric, prompts
from millrace.operators import evalsets, leaderboard, metrics
from millrace.sources.readers import read_evaluations, read_frozen
from millrace.sources.sinks import write_frozen


def first(spark, schema, row, record):
    return spark.createDataFrame([row], schema).select(record.alias("r")).first().r


def test_formats(spark):
    c = F.col
    r = first(spark, "goal string, a string, b string, label int", ("Boil an egg", "In water.", "In sand.", 1), prompts.two_solutions(c("goal"), c("a"), c("b"), c("label")))
    assert r.context == "Question: Boil an egg\nAnswer:" and r.choices == [" In water.", " In sand."] and r.label == 1
    assert first(spark, "goal string, a string, b string, label int", ("x", "y", "z", -1), prompts.two_solutions(c("goal"), c("a"), c("b"), c("label"))) is None
    blank = "sentence string, a string, b string, answer string"
    rec = prompts.fill_blank(c("sentence"), c("a"), c("b"), c("answer"))
    r = first(spark, blank, ("The cup did not fit because _ was big.", "cup", "box", "1"), rec)
    assert r.contexts == ["The cup did not fit because cup", "The cup did not fit because box"] and r.choices == [" was big."] * 2 and r.label == 0
    for bad in (("no blank", "a", "b", "1"), ("ends with _", "a", "b", "1"), ("a _ b", "a", "b", "")):
        assert first(spark, blank, bad, rec) is None
    keyed = "q string, t array<string>, l array<string>, k string"
    r = first(spark, keyed, ("Why?", ["p ", "q", "r"], ["1", "2", "3"], "2"), prompts.keyed_question(c("q"), c("t"), c("l"), c("k")))
    assert r.label == 1 and r.choices[0] == " p"
    assert first(spark, keyed, ("Why?", ["p"], ["A"], "B"), prompts.keyed_question(c("q"), c("t"), c("l"), c("k"))) is None
    cause = prompts.cause_or_effect(c("p"), c("q"), c("a"), c("b"), c("l"), {"cause": "because", "effect": "so"})
    r = first(spark, "p string, q string, a string, b string, l int", ("He fell.", "effect", "It hurt.", "It rained.", 0), cause)
    assert r.context == "He fell. so" and r.choices == [" It hurt.", " It rained."]
    assert first(spark, "p string, q string, a string, b string, l int", ("He fell.", "?", "x", "y", 0), cause).context == "He fell."
    assert first(spark, "x string", ("a [title] b [step] c  d",), prompts.tidy_activity(c("x"))) == "a. b c d"
    assert first(spark, "x string", ("ABC dEF",), prompts.capitalised(c("x"))) == "Abc def"


def test_task_metrics_and_ties(spark):
    data = [("t", "en", 0, 0, -1.0, 0), ("t", "en", 0, 1, -1.0, 0), ("t", "en", 1, 0, -2.0, 1), ("t", "en", 1, 1, -3.0, 1), ("t", "en", 1, 2, -5.0, 1), ("t", "en", 2, 0, -1.0, 0)]
    df = spark.createDataFrame(data, "task string, language string, ex_id int, choice_idx int, score double, label int")
    r = metrics.task_metrics(df).first()
    assert (r.n, r.acc_norm) == (2, 0.5)  # the tie goes to the first; the example of one choice does not count
    assert abs(r.chance - (1 / 2 + 1 / 3) / 2) < 1e-12
    assert abs(r.margin_max - (0 - 1) / 2) < 1e-12
    assert abs(r.se - math.sqrt(0.25 / 2)) < 1e-12
    agg = {x.language: x for x in metrics.suite_aggregates(metrics.task_metrics(df)).collect()}
    assert set(agg) == {"en", "all"} and agg["all"].n_tasks == 1
    assert metrics.choice_accuracy(df).first().n == 3


def test_losses(spark):
    df = spark.createDataFrame([("en", 1.0, 5), ("en", 3.0, 5), ("en", 9.0, -100), ("ko", 4.0, 1)], "lang string, nll double, label int")
    got = {r.lang: (r.tokens, r.loss) for r in metrics.loss_by_language(df).collect()}
    assert got == {"en": (2, 2.0), "ko": (1, 4.0), "all": (3, 8 / 3)}
    r = metrics.loss_rows(df.limit(0)).first()
    assert r.loss is None or r.loss == 0
    assert spark.range(1).select(numeric.perplexity(F.lit(60.0))).first()[0] == math.inf


def test_best_so_far(spark):
    log = spark.createDataFrame([("r", "en", k, v) for k, v in enumerate([3.0, 2.0, 2.5, 1.0])], "run string, lang string, step int, loss double")
    out = metrics.best_so_far(log).orderBy("step").collect()
    assert [r.best_before for r in out] == [None, 3.0, 2.0, 2.0]
    assert [r.regressed for r in out] == [False, False, True, False]


def test_continuation_scores(spark):
    rows = [("a", p, 3, 6, -float(p)) for p in range(6)] + [("b", 0, 4, 4, -1.0)]
    df = spark.createDataFrame(rows, "k string, pos int, context_len int, total_len int, lp double")
    got = {r.k: r.score for r in metrics.continuation_scores(df, ["k"]).collect()}
    assert got == {"a": -3.0, "b": -math.inf}


def test_filters_keep_ties_and_the_crossing_token(spark):
    df = spark.createDataFrame([(0, t, x) for t, x in enumerate([5.0, 4.0, 4.0, 1.0])], "g int, tok int, x double")
    assert [r.tok for r in numeric.keep_top_k(df, 2, "g", "x").orderBy("tok").collect()] == [0, 1, 2]
    assert [r.tok for r in numeric.keep_top_p(df, 0.6, "g", "x", "tok").orderBy("tok").collect()] == [0, 1]
    assert numeric.keep_top_p(df, 0.0, "g", "x", "tok").count() == 1


def evaluation(name, tasks, overall=None, sources=("c",), loss=1.0):
    e = {"run_name": name, "checkpoint": "out/x/step.pt", "parameters": {"total": 5_000_000}, "provenance": {"val_sources": list(sources), "max_batches": 10}, "language_modeling": {"all": {"loss": loss, "perplexity": 2.0}}}
    if tasks is not None:
        e["downstream"] = {"tasks": {k: {"language": "en", "acc_norm": v} for k, v in tasks.items()}, "aggregates": {"overall_avg": overall} if overall is not None else {}}
    return e


def test_leaderboard(spark, tmp_path):
    for k, e in enumerate([evaluation("low", {"a": 0.5}, 0.2), evaluation("high", {"a": 0.25, "b": 0.125}, 0.9, ("other",)), evaluation("none", None), evaluation("", {"b": 1.0}, 0.2)]):
        (tmp_path / f"e{k}.json").write_text(json.dumps(e))
    (tmp_path / "leaderboard.json").write_text("{}")
    rows = leaderboard.ranked(leaderboard.result_rows(read_evaluations(spark, f"{tmp_path}/*.json")))
    assert [r.model for r in rows.orderBy("rank").collect()] == ["high", "low", "x/step", "none"]
    tasks = leaderboard.task_names(rows)
    assert tasks == ["a", "b"]
    text = leaderboard.markdown(rows, tasks)
    assert "| high | 5.0M | 90.0 | – | – | – | – | 25.0 | 12.5 | 1.000 | 2.0 |" in text
    assert "2 groups with other validation data" in text and "> - `other` @ max_batches=10: high\n" in text
    flat = leaderboard.flat_table(rows, tasks).orderBy("rank").collect()
    assert flat[0].val_sources == "other" and flat[3].a is None
    leaderboard.write_csv(rows, tasks, f"{tmp_path}/csv")
    lines = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert lines[0].split(",")[:3] == ["model", "params", "overall_avg"] and lines[1].startswith("high,5000000,0.9,,") and len(lines) == 5


def test_frozen_sets(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"goal {i}", "one", "two", i % 3 - 1) for i in range(60)], "i int, goal string, a string, b string, label int")
    spec = evalsets.TaskSpec("t", prompts.two_solutions(F.col("goal"), F.col("a"), F.col("b"), F.col("label")), n=10, stratified=True)
    records, info = evalsets.build_task(raw, spec, "i")
    assert (info["size"], info["dropped"], info["sample_size"], info["choice_counts"], info["labels"]) == (60, 20, 10, [2], [0, 1])
    path = f"{tmp_path}/frozen"
    write_frozen(records, path)
    back = read_frozen(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, records.select(*back.columns).collect()))
    assert '"contexts"' not in next((tmp_path / "frozen").glob("part-*")).read_text()
    assert evalsets.choice_rows(records).count() == 20
    assert len(evalsets.enabled_tasks([spec, evalsets.TaskSpec("u", spec.record, during_training=False)], True)) == 1


def test_last_words_and_batches(spark):
    df = spark.createDataFrame([("the cat\nsat down", "x", "x"), ("single", "x", "x"), ("a b ", "q", "z")], "text string, predicted string, target_first string")
    rows = metrics.last_word_targets(df)
    assert [(r.context, r.target) for r in rows.collect()] == [("the cat\nsat", "down"), (None, None), ("a b", "")]
    r = metrics.last_word_accuracy(rows).first()
    assert r.n == 3 and abs(r.accuracy - 1 / 3) < 1e-12
    b = spark.range(10).withColumnRenamed("id", "batch")
    assert metrics.first_batches(b, 4).count() == 4 and metrics.first_batches(b, 0).count() == 10
    assert metrics.batches_per_rank(1000, 2, 100, 2) == 2 and metrics.batches_per_rank(1, 2, 100, 2) == 1
    parts = metrics.by_length(spark.range(100).withColumnRenamed("id", "n"), "n", 4).withColumn("p", F.spark_partition_id()).collect()
    assert [r.n for r in sorted(parts, key=lambda r: (r.p, r.n))] == list(range(100))
