"""Reading and comparing final answers: number answers, boxed answers, math strings, QA spans."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, let
from .text import apply_rules, words

INVALID = "[invalid]"


def marked_answer(c: Column | str) -> Column:
    """Number after ``####`` without thousands commas, else ``[invalid]``."""
    found = F.regexp_extract_all(col(c), F.lit(r"#### (-?[0-9.,]+)"), 1)
    return F.coalesce(F.replace(F.get(found, F.lit(0)), F.lit(","), F.lit("")), F.lit(INVALID))


def _balanced_end(chars: Column) -> Column:
    """1-based place of the brace that closes the first opened one; 0 when none does."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("hit"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        closes = (ch == "}") & (depth == 0) & (acc["hit"] == 0)
        return F.struct(
            (acc["i"] + 1).alias("i"), depth.alias("depth"),
            F.when(closes, acc["i"] + 1).otherwise(acc["hit"]).alias("hit"),
        )

    return F.aggregate(chars, start, step, lambda acc: acc["hit"])


def last_boxed(c: Column | str) -> Column:
    """The last boxed expression with its braces, null when there is none or it never closes."""
    c = col(c)
    spaced = F.concat(
        F.lit("\\boxed "), F.substring_index(F.substring_index(c, "\\boxed ", -1), "$", 1)
    )

    def braced(command: str) -> Column:
        tail = F.concat(F.lit(command), F.substring_index(c, command, -1))
        closed = let(
            tail,
            lambda t: let(_balanced_end(F.split(t, "")), lambda e: F.when(e > 0, F.substr(t, F.lit(1), e))),
        )
        return closed

    return (
        F.when(F.contains(c, F.lit("\\boxed ")), spaced)
        .when(F.contains(c, F.lit("\\boxed")), braced("\\boxed"))
        .when(F.contains(c, F.lit("\\fbox")), braced("\\fbox"))
    )


def unbox(c: Column | str) -> Column:
    """Content of a boxed expression."""
    c = col(c)
    spaced, braced = "\\boxed ", "\\boxed{"
    return F.when(F.startswith(c, F.lit(spaced)), F.substring(c, len(spaced) + 1, 1 << 30)).when(
        F.startswith(c, F.lit(braced)) & F.endswith(c, F.lit("}")),
        F.substr(c, F.lit(len(braced) + 1), F.length(c) - len(braced) - 1),
    )


def between_dollars(c: Column | str) -> Column:
    """Text between the first and the last dollar sign; the whole text with fewer than two."""
    c = col(c)
    first = F.instr(c, "$")
    last = F.length(c) - F.instr(F.reverse(c), "$") + 1
    return F.when((first > 0) & (last > first), F.substr(c, first + 1, last - first - 1)).otherwise(c)


# Spellings that mean the same, replaced from top to bottom.
MATH_SPELLINGS = [
    ("=", "\n", ""),
    ("=", "\\!", ""),
    ("=", "\\\\", "\\"),
    ("=", "tfrac", "frac"),
    ("=", "dfrac", "frac"),
    ("=", "\\left", ""),
    ("=", "\\right", ""),
    ("=", "^{\\circ}", ""),
    ("=", "^\\circ", ""),
    ("=", "\\$", ""),
]


def math_normal(c: Column | str) -> Column:
    """Math answer in one spelling, so that equal answers are equal strings."""
    s = apply_rules(c, MATH_SPELLINGS)
    # units on the right, percent signs
    s = F.substring_index(s, "\\text{ ", 1)
    s = F.replace(s, F.lit("\\%"), F.lit(""))
    # numbers keep their leading zero
    s = F.replace(F.replace(s, F.lit(" ."), F.lit(" 0.")), F.lit("{."), F.lit("{0."))
    s = F.regexp_replace(s, r"^\.", "0.")
    # a short name in front of a single equal sign
    s = F.regexp_replace(s, r"(?s)^[^=]{0,2}=([^=]*)$", "$1")
    # one-character roots get braces, blanks go
    s = F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}")
    s = F.replace(s, F.lit(" "), F.lit(""))
    # \frac12, \frac1{72}; a \frac with fewer than two characters behind it leaves all as it is
    braces = F.regexp_replace(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    braces = F.regexp_replace(braces, r"\\frac([^{])\{", r"\\frac{$1}{")
    s = F.when(s.rlike(r"\\frac([^{]?$|[^{]?\\frac)"), s).otherwise(braces)
    s = F.when(s == "0.5", F.lit("\\frac{1}{2}")).otherwise(s)
    # plain whole-number quotients
    return F.regexp_replace(s, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def math_equal(a: Column | str, b: Column | str) -> Column:
    """Equal after normalisation; two missing answers are equal, one missing answer is not."""
    return math_normal(a).eqNullSafe(math_normal(b))


# ---- question answering ------------------------------------------------------------------------------


# whole words in any script; the meaning of \b for other than ASCII letters differs between Java versions
ARTICLES = r"(?<![\p{L}\p{N}])(a|an|the)(?![\p{L}\p{N}])"


def qa_normal(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    bare = F.translate(F.lower(col(c)), string.punctuation, "")
    return F.array_join(words(F.regexp_replace(bare, ARTICLES, " ")), " ")


def number_or_null(c: Column) -> Column:
    """The value of a plain number token."""
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), c.try_cast("double"))


def span_normal(c: Column | str) -> Column:
    """QA normal form per part (parts split at blank or hyphen); numbers get one spelling."""

    def part(token: Column) -> Column:
        low = F.lower(token)
        bare = F.when(number_or_null(low).isNotNull(), low).otherwise(F.translate(low, string.punctuation, ""))
        value = number_or_null(bare)
        spelled = F.when(value.isNotNull(), value.cast("string")).otherwise(bare)
        return F.array_join(words(F.regexp_replace(spelled, ARTICLES, " ")), " ")

    parts = F.transform(F.split(col(c), "[ -]"), part)
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def bag_f1(pred: Column, gold: Column) -> Column:
    """F1 of two token sets; an empty side counts as fully precise or fully recalled."""

    def score(p: Column, g: Column) -> Column:
        both = F.size(F.array_intersect(p, g))
        precision = F.when(F.size(p) == 0, F.lit(1.0)).otherwise(both / F.size(p))
        recall = F.when(F.size(g) == 0, F.lit(1.0)).otherwise(both / F.size(g))
        return F.when(precision + recall == 0, F.lit(0.0)).otherwise(
            2 * precision * recall / (precision + recall)
        )

    return let(F.array_distinct(pred), lambda p: let(F.array_distinct(gold), lambda g: score(p, g)))


def numbers_agree(pred: Column, gold: Column) -> Column:
    """No number in the gold tokens, or at least one gold number among the predicted tokens."""
    gold_numbers = F.filter(gold, lambda t: number_or_null(t).isNotNull())
    return (F.size(gold_numbers) == 0) | F.arrays_overlap(gold_numbers, pred)


def span_f1(pred: Column | str, gold: Column | str) -> Column:
    """Token-set F1 of one answer span; 0 when the numbers disagree; two digits."""

    def score(p: Column, g: Column) -> Column:
        return F.round(F.when(numbers_agree(p, g), bag_f1(p, g)).otherwise(F.lit(0.0)), 2)

    return let(words(span_normal(pred)), lambda p: let(words(span_normal(gold)), lambda g: score(p, g)))


def span_exact(pred: Column | str, gold: Column | str) -> Column:
    return (span_normal(pred) == span_normal(gold)).cast("double")


def token_f1(pred: Column | str, gold: Column | str) -> Column:
    """Multiset token F1 on the QA normal form; if either side is empty, 1 only when both are."""

    def overlap(p: Column, g: Column) -> Column:
        def side(tokens: Column, n: int) -> Column:
            return F.transform(tokens, lambda w: F.struct(w.alias("word"), F.lit(n).alias("side")))

        def step(acc: Column, x: Column) -> Column:
            left = F.when(acc["word"] == x["word"], acc["left"]).otherwise(F.lit(0))
            predicted = x["side"] == 0
            return F.struct(
                x["word"].alias("word"), F.when(predicted, left + 1).otherwise(F.greatest(left - 1, F.lit(0))).alias("left"),
                (acc["same"] + F.when(~predicted & (left > 0), F.lit(1)).otherwise(F.lit(0))).alias("same"),
            )

        # one pass over the sorted tokens of both sides: a word's predicted tokens come first, its gold tokens use them up
        start = F.struct(F.lit("").alias("word"), F.lit(0).alias("left"), F.lit(0).alias("same"))
        return F.aggregate(F.sort_array(F.concat(side(p, 0), side(g, 1))), start, step, lambda acc: acc["same"])

    def score(p: Column, g: Column) -> Column:
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(
            2.0 * overlap(p, g) / (F.size(p) + F.size(g))
        )

    return let(words(qa_normal(pred)), lambda p: let(words(qa_normal(gold)), lambda g: score(p, g)))


def token_exact(pred: Column | str, gold: Column | str) -> Column:
    return (qa_normal(pred) == qa_normal(gold)).cast("double")


def categorise_answer(unanswerable: Column, yes_no: Column, free_form: Column, spans: Column) -> Column:
    """One answer record to (answer, kind): the first filled field in fixed order decides."""

    def pair(answer: Column, kind: str) -> Column:
        return F.struct(answer.cast("string").alias("answer"), F.lit(kind).alias("answer_type"))

    return (
        F.when(unanswerable, pair(F.lit("unanswerable"), "unanswerable"))
        .when(yes_no, pair(F.lit("yes"), "bool"))
        .when(F.coalesce(free_form, F.lit("")) != "", pair(free_form, "free form answer"))
        .when(F.size(F.coalesce(spans, F.array().cast("array<string>"))) > 0,
              pair(F.array_join(spans, ", "), "extractive_spans"))
        .when(~yes_no, pair(F.lit("no"), "bool"))
    )

