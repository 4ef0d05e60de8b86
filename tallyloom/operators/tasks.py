"""Benchmark tasks as data: templates for context, continuations, label and domain text of each task.

A template names fields in braces. A task may also hand in a column function where a template cannot say it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .rows import blank_samples, eval_samples

ColumnMaker = Callable[[], Column]


def fill_template(template: str, clean: Callable[[Column], Column] | None = None) -> Column:
    """Column from a text with ``{field}`` slots; ``clean`` is applied to every field."""
    pieces = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if part:
                pieces.append(F.lit(part))
        else:
            value = F.col(part).cast("string")
            pieces.append(clean(value) if clean else value)
    return F.concat(*pieces)


@dataclass(frozen=True)
class Task:
    """Hooks of one task: text, continuations, label, domain text and the metric that scores it."""

    context: str | ColumnMaker
    choices: list[str] | ColumnMaker
    label: str | ColumnMaker
    domain: str | ColumnMaker = "Answer:"
    metric: str = "acc"
    clean: Callable[[Column], Column] | None = field(default=None)

    def _text(self, part: str | ColumnMaker) -> Column:
        return fill_template(part, self.clean) if isinstance(part, str) else part()

    def rows(self, df: DataFrame, doc_id: str) -> DataFrame:
        choices = self.choices() if callable(self.choices) else F.array(*[self._text(c) for c in self.choices])
        label = self.label() if callable(self.label) else F.col(self.label)
        return df.select(
            doc_id, self._text(self.context).alias("context"), choices.alias("continuations"),
            label.cast("int").alias("label"), self._text(self.domain).alias("domain"),
        )


def listed(column: str) -> ColumnMaker:
    """Continuations from an array column, with the leading blank."""
    return lambda: F.transform(column, lambda c: F.concat(F.lit(" "), c))


def gold_of(column: str, answer: str) -> ColumnMaker:
    """Only the right choice of an array column."""
    return lambda: F.array(F.concat(F.lit(" "), F.element_at(column, F.col(answer).cast("int") + 1)))


def number_minus_one(column: str) -> ColumnMaker:
    return lambda: F.col(column).cast("int") - 1


def letter(column: str) -> ColumnMaker:
    return lambda: tx.answer_index(column)


def yes_first(column: str) -> ColumnMaker:
    """0 when true: the first continuation says yes."""
    return lambda: F.when(F.col(column).cast("boolean"), 0).otherwise(1)


def last_word(column: str) -> Column:
    return F.element_at(F.split(tx.strip(column), " "), -1)


def first_lower(column: str) -> Column:
    return F.concat(F.lit(" "), F.lower(F.substring(column, 1, 1)), F.substring(column, 2, 1 << 30))


def _caption_context() -> Column:
    text = F.concat("activity_label", F.lit(": "), "ctx_a", F.lit(" "), tx.capitalize("ctx_b"))
    return tx.clean_caption(text)


def _caption_domain() -> Column:
    text = tx.clean_caption(tx.capitalize("ctx_b"))
    return F.when(text == "", F.element_at(F.split(tx.clean_caption("ctx_a"), " "), -1)).otherwise(text)


def _connector() -> Column:
    return F.when(F.col("question") == "cause", F.lit("because")).otherwise(F.lit("therefore"))


def _premise_with_connector() -> Column:
    premise = tx.strip("premise")
    return F.concat(F.substr(premise, F.lit(1), F.length(premise) - 1), F.lit(" "), _connector())


# Prompt texts and metrics of public benchmark tasks.
TASKS: dict[str, Task] = {
    "piqa": Task("Question: {goal}\nAnswer:", [" {sol1}", " {sol2}"], "label", metric="len_norm"),
    "hellaswag": Task(
        _caption_context, lambda: F.transform("endings", lambda e: F.concat(F.lit(" "), tx.clean_caption(e))),
        "label", _caption_domain, "len_norm",
    ),
    "openbook_qa": Task("{question_stem}", listed("choices"), letter("answer"), lambda: last_word("question_stem"), "len_norm"),
    "boolq": Task("{passage}\nQuestion: {question}?\nAnswer:", [" yes", " no"], yes_first("answer")),
    "sciq": Task(
        lambda: F.concat(tx.strip("support"), F.lit("\nQuestion: "), "question", F.lit("\nAnswer:")),
        [" {distractor1}", " {distractor2}", " {distractor3}", " {correct_answer}"], lambda: F.lit(3),
    ),
    "arc_easy": Task("Question: {question}\nAnswer:", listed("choices"), letter("answer")),
    "arc_challenge": Task("Question: {question}\nAnswer:", listed("choices"), letter("answer"), metric="len_norm"),
    "arc_easy_gold": Task(
        "Question: {question}\nAnswer:",
        lambda: F.array(F.concat(F.lit(" "), F.element_at("choices", tx.answer_index("answer") + 1))),
        lambda: F.lit(0), metric="ce_loss",
    ),
    "basic_arithmetic": Task("Question: {question}\nAnswer:", listed("choices"), letter("answer")),
    "commonsense_qa": Task("Question: {question}\nAnswer:", listed("choices"), letter("answer"), metric="len_norm"),
    "social_iqa": Task(
        "Question: {context} {question}\nAnswer:", [" {answerA}", " {answerB}", " {answerC}"],
        number_minus_one("label"), metric="len_norm",
    ),
    "copa": Task(
        _premise_with_connector, lambda: F.array(first_lower("choice1"), first_lower("choice2")), "label", _connector
    ),
    "rte": Task("{sentence1}\nQuestion: {sentence2} True or False?\nAnswer:", [" True", " False"], "label", metric="len_norm"),
    "commitment_bank": Task(
        "{premise}\nQuestion: {hypothesis}. True, False or Neither?\nAnswer:", [" True", " False", " Neither"], "label"
    ),
    "mrpc": Task(
        "Sentence 1: {sentence1}\nSentence 2: {sentence2}\nQuestion: Do both sentences mean the same thing?\nAnswer:",
        [" yes", " no"], yes_first("label"), metric="f1", clean=tx.detokenize_sentence,
    ),
    "sst2": Task(
        "{sentence}\nQuestion: Is this sentence positive or negative?\nAnswer:", [" negative", " positive"], "label",
        clean=tx.detokenize_sentence,
    ),
    "mmlu": Task("Question: {question}\nAnswer:", listed("choices"), "answer", metric="len_norm"),
    "mmlu_gold": Task("Question: {question}\nAnswer:", gold_of("choices", "answer"), lambda: F.lit(0), metric="bpb"),
    "trivia_qa_gold": Task("\nQuestion: {question}\nAnswer:", [" {answer}"], lambda: F.lit(0), metric="ce_loss"),
    "natural_questions_gold": Task("\nQuestion: {question}\nAnswer:", [" {answer}"], lambda: F.lit(0), metric="ce_loss"),
}


#: Tasks with a context for each choice and one continuation: sentence with a blank, options, answer from 1, metric.
BLANK_TASKS: dict[str, tuple[str, tuple[str, ...], str, str]] = {"winogrande": ("sentence", ("option1", "option2"), "answer", "acc")}


def task_metric(name: str) -> str:
    """The metric a named task is scored by."""
    if name in BLANK_TASKS:
        return BLANK_TASKS[name][3]
    if name not in TASKS:
        raise ValueError(f"unknown task {name}")
    return TASKS[name].metric


def task_rows(df: DataFrame, name: str, doc_id: str = "doc_id") -> DataFrame:
    """Context, continuations, label and domain text of a named task with one context."""
    if name in BLANK_TASKS:
        raise ValueError(f"{name} has a context for each choice; use task_samples")
    if name not in TASKS:
        raise ValueError(f"unknown task {name}")
    return TASKS[name].rows(df, doc_id)


def task_samples(df: DataFrame, name: str, ctx_limit: int, doc_id: str = "doc_id") -> DataFrame:
    """Evaluation samples of a named task, one row per continuation (or per context, for a task with a blank)."""
    if name in BLANK_TASKS:
        sentence, options, answer, _ = BLANK_TASKS[name]
        return blank_samples(df, ctx_limit, doc_id, sentence, options, answer)
    return eval_samples(task_rows(df, name, doc_id), ctx_limit, doc_id)


#: Prompt variants of the subject tasks: an instruction, and up to five solved examples behind it.
VARIANTS: tuple[str | None, ...] = (None, "inst", "inst+1", "inst+2", "inst+3", "inst+4", "inst+5")


def subject_prompt(question: Column, choices: Column, letters: bool) -> Column:
    """Question and ``Answer:``; with ``letters`` the lettered choices stand between them, else the question is announced."""
    if not letters:
        return F.concat(F.lit("Question: "), tx.strip(question), F.lit("\nAnswer:"))
    lines = F.transform(choices, lambda c, i: F.concat(F.char(65 + i), F.lit(". "), c, F.lit("\n")))
    return F.concat(tx.strip(question), F.lit("\n"), F.array_join(lines, ""), F.lit("Answer:"))


def _variant_parts(variant: str | None) -> tuple[bool, int]:
    """Whether a variant has the instruction, and its number of examples."""
    found = re.fullmatch(r"(inst)?(?:\+(\d+))?", variant or "")
    if found is None:
        raise ValueError(f"unknown prompt variant {variant}")
    return bool(found[1]), int(found[2] or 0)


def subject_rows(
    df: DataFrame, dev: DataFrame, variants: Sequence[str | None] = VARIANTS, letters: bool = False,
    order: str = "seq", doc_id: str = "doc_id",
) -> DataFrame:
    """Context, continuations, label and domain of subject questions, once for each prompt variant.

    Both tables hold ``subject, question, choices, answer`` (answer from 0). The examples of a question are the first
    ones of its subject in ``dev`` by ``order``; a subject with too few gives those it has, and a question without a subject
    has none. Documents of the second and
    later variants are numbered behind those before them. With ``letters`` a choice is answered by its letter. Only the
    first few examples of a subject leave their task (a ranked limit), so neither side grows with ``dev``.
    """
    parts = [_variant_parts(v) for v in variants]
    most = max(shots for _, shots in parts)
    gold = F.col("answer").cast("int")
    said = F.char(65 + gold) if letters else F.element_at("choices", gold + 1)
    solved = F.concat(subject_prompt(F.col("question"), F.col("choices"), letters), F.lit(" "), said, F.lit("\n\n"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(order))
    first = dev.filter(F.col("subject").isNotNull()).withColumn("_rank", rank).filter(F.col("_rank") <= most)
    shots = first.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("_rank", solved.alias("text"))))["text"].alias("_shots"))
    topic = F.concat(
        F.lit("The following are multiple choice questions (with answers) about "),
        F.coalesce(F.replace("subject", F.lit("_"), F.lit(" ")), F.lit("anything")), F.lit(":\n\n"),
    )
    own = subject_prompt(F.col("question"), F.col("choices"), letters)
    known = F.coalesce(F.col("_shots"), F.array().cast("array<string>"))

    def context(instructed: bool, n: int) -> Column:
        pieces = ([topic] if instructed else []) + ([F.array_join(F.slice(known, 1, n), "")] if n else []) + [own]
        return F.concat(*pieces)

    every = F.array(*[
        F.struct(F.lit(k).alias("no"), F.lit(v).cast("string").alias("variant"), context(*p).alias("context"))
        for k, (v, p) in enumerate(zip(variants, parts))
    ])
    answers = F.transform("choices", lambda c, i: F.concat(F.lit(" "), F.char(65 + i) if letters else c))
    placed = df.join(shots, "subject", "left") if most else df.withColumn("_shots", F.lit(None).cast("array<string>"))
    long = placed.select(doc_id, answers.alias("continuations"), gold.alias("label"), F.explode(every).alias("_v"))
    span = df.agg((F.max(doc_id) + 1).alias("_span"))
    return long.crossJoin(F.broadcast(span)).select(
        (F.col(doc_id) + F.col("_v.no") * F.col("_span")).alias(doc_id), "_v.variant", "_v.context", "continuations", "label",
        F.lit("Answer:").alias("domain"),
    )
