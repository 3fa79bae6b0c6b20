"""Multiple-choice records from the raw rows of public benchmarks.

Each function gives a struct (context, contexts, choices, label) or null for a row
that has no usable answer.  Choices begin with a space, as they continue a prompt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import unicode_rstrip, unicode_strip


def record(context: Column, choices: Column, label: Column, contexts: Column | None = None) -> Column:
    some = contexts if contexts is not None else F.lit(None).cast("array<string>")
    return F.when(label.isNotNull(), F.struct(context.alias("context"), some.alias("contexts"), choices.alias("choices"), label.cast("int").alias("label")))


def _spaced(x: Column) -> Column:
    return F.concat(F.lit(" "), x)


def _within(label: Column, n: int) -> Column:
    return F.when((label >= 0) & (label < n), label)


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))


def tidy_activity(x: Column) -> Column:
    """Title marks become sentence ends, other bracketed notes go, double spaces once."""
    x = F.replace(unicode_strip(x), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[[^\n]*?\]", ""), F.lit("  "), F.lit(" "))


def sentence_completion(activity: Column, first: Column, second: Column, endings: Column, label: Column) -> Column:
    context = F.concat(activity, F.lit(": "), first, F.lit(" "), capitalised(second))
    return record(tidy_activity(context), F.transform(endings, lambda e: _spaced(tidy_activity(e))), label.try_cast("int"))


def keyed_question(question: Column, texts: Column, labels: Column, key: Column) -> Column:
    """Answer given by its letter or number; rows whose key is missing are dropped."""
    at = F.array_position(labels, key)
    context = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return record(context, F.transform(texts, lambda t: _spaced(unicode_strip(t))), F.when(at > 0, at - 1))


def keyed_stem(stem: Column, texts: Column, labels: Column, key: Column) -> Column:
    """The same without a frame around the question; the key may have spaces around it."""
    at = F.array_position(labels, unicode_strip(key))
    return record(unicode_strip(stem), F.transform(texts, lambda t: _spaced(unicode_strip(t))), F.when(at > 0, at - 1))


def two_solutions(goal: Column, first: Column, second: Column, label: Column) -> Column:
    context = F.concat(F.lit("Question: "), goal, F.lit("\nAnswer:"))
    return record(context, F.array(_spaced(unicode_strip(first)), _spaced(unicode_strip(second))), _within(label, 2))


def yes_no(passage: Column, question: Column, label: Column, no: str = " no", yes: str = " yes") -> Column:
    context = F.concat(passage, F.lit("\nQuestion: "), question, F.lit("?\nAnswer:"))
    return record(context, F.array(F.lit(no), F.lit(yes)), _within(label, 2))


def fill_blank(sentence: Column, first: Column, second: Column, answer: Column) -> Column:
    """One context per option, up to the blank; the rest of the sentence is the choice for both."""
    at = F.instr(sentence, "_")
    head, rest = F.substring(sentence, F.lit(1), at - 1), unicode_strip(F.substring(sentence, at + 1, F.length(sentence)))
    label = F.when((at > 0) & (rest != "") & answer.isin("1", "2"), answer.try_cast("int") - 1)
    choice = _spaced(rest)
    return record(F.lit(""), F.array(choice, choice), label, F.array(F.concat(head, first), F.concat(head, second)))


def four_endings(context: Column, endings: list[Column], label: Column) -> Column:
    return record(unicode_strip(context), F.array(*[_spaced(unicode_strip(e)) for e in endings]), label)


# The Korean wordings of the framed judgements.
CONNECTORS = {"원인": "왜냐하면", "결과": "그래서"}
JUDGEMENTS = {
    "boolq": ("%s 질문: %s 답변:", " 아니오", " 예"),
    "sentineg": ("문장: %s 긍부정:", " 부정", " 긍정"),
    "wic": ("문장1: %s 문장2: %s 두 문장에서 %s가 같은 뜻으로 쓰였나?", " 아니오", " 예"),
}


def cause_or_effect(premise: Column, question: Column, first: Column, second: Column, label: Column, connectors: dict[str, str] = CONNECTORS) -> Column:
    words = F.create_map(*[F.lit(x) for kv in connectors.items() for x in kv])
    joint = F.coalesce(F.try_element_at(words, unicode_strip(question)), F.lit(""))
    return record(unicode_rstrip(F.concat(premise, F.lit(" "), joint)), F.array(_spaced(unicode_strip(first)), _spaced(unicode_strip(second))), label)


def judgement(kind: str, columns: list[Column], label: Column) -> Column:
    """A two-way judgement of one or more texts: ``boolq``, ``sentineg`` or ``wic``."""
    template, negative, positive = JUDGEMENTS[kind]
    return record(F.format_string(template, *columns), F.array(F.lit(negative), F.lit(positive)), label)
