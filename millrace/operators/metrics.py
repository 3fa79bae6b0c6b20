"""Scores of multiple-choice answers and losses, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import perplexity


def best_choice(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per example: label, predicted choice (first of equals), number of choices, gold score, best and mean of the others."""
    gold = F.col("choice_idx") == F.col("label")
    return scores.groupBy(*keys).agg(
        F.first("label").alias("label"),
        F.max_by("choice_idx", F.struct("score", (-F.col("choice_idx")).alias("first"))).alias("predicted"),
        F.count(F.lit(1)).alias("n_choices"),
        F.max(F.when(gold, F.col("score"))).alias("gold_score"),
        F.max(F.when(~gold, F.col("score"))).alias("best_other"),
        F.avg(F.when(~gold, F.col("score"))).alias("mean_other"),
    )


def task_metrics(scores: DataFrame, by: tuple[str, ...] = ("task", "language")) -> DataFrame:
    """One row per task; examples without a wrong choice do not count."""
    each = best_choice(scores, [*by, "ex_id"]).where("best_other is not null and gold_score is not null")
    right = (F.col("predicted") == F.col("label")).cast("double")
    rows = each.groupBy(*by).agg(
        F.avg(right).alias("acc_norm"),
        F.avg(1.0 / F.col("n_choices")).alias("chance"),
        F.avg(F.col("gold_score") - F.col("best_other")).alias("margin_max"),
        F.avg(F.col("gold_score") - F.col("mean_other")).alias("margin_mean"),
        F.count(F.lit(1)).alias("n"),
    )
    p = F.col("acc_norm")
    return rows.withColumn("above_chance", p - F.col("chance")).withColumn("se", F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / F.col("n")))


def suite_aggregates(tasks: DataFrame) -> DataFrame:
    """Unweighted means over tasks, per language and for all (language ``all``)."""
    fair = F.when(F.col("chance") < 1, F.col("above_chance") / (1 - F.col("chance")))
    rows = tasks.withColumn("__norm", fair).groupingSets([["language"], []], "language").agg(
        F.avg("acc_norm").alias("avg"), F.avg("chance").alias("chance"), F.avg("above_chance").alias("above_chance"), F.avg("__norm").alias("normalized"), F.count(F.lit(1)).alias("n_tasks"), F.grouping("language").alias("__all")
    )
    return rows.withColumn("language", F.when(F.col("__all") == 1, "all").otherwise(F.col("language"))).drop("__all")


def choice_accuracy(scores: DataFrame, by: tuple[str, ...] = ("task",)) -> DataFrame:
    """Share of right answers over all examples."""
    each = best_choice(scores, [*by, "ex_id"])
    return each.groupBy(*by).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def continuation_scores(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean log probability of the continuation's tokens; minus infinity if it has none.

    ``positions`` has pos, context_len, total_len and lp, the log probability of the
    token that follows pos.
    """
    inside = (F.col("pos") >= F.col("context_len") - 1) & (F.col("pos") < F.col("total_len") - 1)
    return positions.groupBy(*keys).agg(F.coalesce(F.avg(F.when(inside, F.col("lp"))), F.lit(float("-inf"))).alias("score"))


def loss_rows(tokens: DataFrame, by: Column | str | None = None, ignore: int = -100) -> DataFrame:
    """Token-weighted loss and perplexity; positions labelled ``ignore`` do not count."""
    counted = F.col("label") != ignore
    sums = [F.sum(F.when(counted, F.col("nll")).otherwise(0.0)).alias("__nll"), F.sum(counted.cast("long")).alias("tokens")]
    rows = tokens.groupBy(by).agg(*sums) if by is not None else tokens.agg(*sums)
    loss = F.col("__nll") / F.greatest(F.col("tokens"), F.lit(1))
    return rows.withColumn("loss", loss).withColumn("perplexity", perplexity(F.col("loss"))).drop("__nll")


def loss_by_language(tokens: DataFrame, ignore: int = -100) -> DataFrame:
    """Per language and token-weighted over all (language ``all``)."""
    counted = F.col("label") != ignore
    rows = tokens.rollup("lang").agg(F.sum(F.when(counted, F.col("nll")).otherwise(0.0)).alias("__nll"), F.sum(counted.cast("long")).alias("tokens"), F.grouping("lang").alias("__all"))
    loss = F.col("__nll") / F.greatest(F.col("tokens"), F.lit(1))
    named = rows.withColumn("lang", F.when(F.col("__all") == 1, "all").otherwise(F.col("lang")))
    return named.withColumn("loss", loss).withColumn("perplexity", perplexity(F.col("loss"))).drop("__nll", "__all")


def loss_language_mean(batches: DataFrame) -> DataFrame:
    """Mean over batches by language, then the plain mean over languages."""
    per = batches.groupBy("lang").agg(F.avg("loss").alias("loss"))
    return per.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("languages")).withColumn("perplexity", perplexity(F.col("loss")))


def best_so_far(log: DataFrame, value: str = "loss", by: tuple[str, ...] = ("run", "lang"), step: str = "step") -> DataFrame:
    """Adds the best earlier value and whether this one is worse or better."""
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    out = log.withColumn("best_before", F.min(value).over(before))
    return out.withColumn("regressed", F.coalesce(F.col(value) > F.col("best_before"), F.lit(False))).withColumn("improved", F.coalesce(F.col(value) < F.col("best_before"), F.lit(True)))


def throughput(log: DataFrame, by: str = "run") -> DataFrame:
    """Tokens per second between one log line and the next."""
    w = Window.partitionBy(by).orderBy("step")
    gap = F.col("seconds") - F.lag("seconds").over(w)
    return log.withColumn("tokens_per_second", F.when(gap > 0, (F.col("tokens") - F.lag("tokens").over(w)) / gap))


def corpus_ratios(docs: DataFrame, text: str, tokens: str, words: Column) -> DataFrame:
    """Characters and words per token over a corpus, with denominators of 1 at least."""
    rows = docs.agg(F.sum(F.length(text).cast("long")).alias("chars"), F.sum(words).alias("words"), F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("docs"))
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return rows.select("docs", "chars", "words", "tokens", (F.col("chars") / one("tokens")).alias("chars_per_token"), (F.col("tokens") / one("words")).alias("tokens_per_word"))


def last_word_targets(passages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``context`` and ``target``, the text before and after the last space; null where there is none."""
    cut = r"(?s)^(.*) ([^ ]*)$"
    has = F.col(text_col).rlike(cut)
    return passages.withColumn("context", F.when(has, F.regexp_extract(text_col, cut, 1))).withColumn("target", F.when(has, F.regexp_extract(text_col, cut, 2)))


def last_word_accuracy(rows: DataFrame) -> DataFrame:
    """Share of passages whose predicted token is the target's first; those without a target count as wrong."""
    right = F.coalesce((F.col("predicted") == F.col("target_first")) & F.col("target").isNotNull(), F.lit(False))
    return rows.agg(F.avg(right.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def first_batches(batches: DataFrame, most: int, number: str = "batch") -> DataFrame:
    """The first ``most`` batches; all for 0."""
    return batches.where(F.col(number) < most) if most else batches


def batches_per_rank(tokens: int, batch: int, context: int, world: int) -> int:
    return max(1, tokens // (batch * context * world))


def by_length(rows: DataFrame, length: str, partitions: int | None = None) -> DataFrame:
    """Rows of like length in one partition and in order, so that batches need little padding."""
    return rows.repartitionByRange(*([partitions] if partitions else []), length).sortWithinPartitions(length)
