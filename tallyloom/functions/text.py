"""Text normalisation, n-grams, clean-up rules and small parsers."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, indices, let, running_starts

# ---- words and n-grams -------------------------------------------------------------------------------


def words(c: Column | str) -> Column:
    """Words separated by white space."""
    return F.regexp_extract_all(col(c), F.lit(r"\S+"), 0)


def overlap_normal(c: Column | str) -> Column:
    """ASCII lower case without ASCII punctuation."""
    return F.translate(col(c), string.ascii_uppercase + string.punctuation, string.ascii_lowercase)


def ngrams_of(tokens: Column, n: int) -> Column:
    """n-grams joined by a blank; none when there are fewer than n tokens."""
    return let(
        tokens,
        lambda w: F.transform(indices(F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")),
    )


def word_ngrams(c: Column | str, n: int) -> Column:
    return ngrams_of(words(c), n)


def word_spans(c: Column | str) -> Column:
    """``array<struct<word, start, end>>`` with 0-based character start and inclusive end."""
    # a word with the white space behind it: their lengths add up to positions behind the blanks in front
    steps = F.transform(F.regexp_extract_all(col(c), F.lit(r"\S+\s*"), 0), F.length)
    lead = F.length(col(c)) - F.length(F.regexp_replace(col(c), r"^\s+", ""))

    def spans(first: Column) -> Column:
        return F.zip_with(
            words(c), running_starts(steps),
            lambda w, s: F.struct(w.alias("word"), (s + first).alias("start"), (s + first + F.length(w) - 1).alias("end")),
        )

    return let(lead, spans)


def ngram_spans(c: Column | str, n: int, normal: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<pos, gram, start, end>>``: n-grams with their place in the original text.

    ``normal`` is applied to every word once, not to every n-gram.
    """

    def grams(spans: Column, w: Column) -> Column:
        return F.transform(
            indices(F.size(w) - (n - 1)),
            lambda i: F.struct(
                i.alias("pos"), F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("gram"),
                F.element_at(spans, i + 1)["start"].alias("start"), F.element_at(spans, i + n)["end"].alias("end"),
            ),
        )

    word = (lambda z: normal(z["word"])) if normal else (lambda z: z["word"])
    return let(word_spans(c), lambda spans: let(F.transform(spans, word), lambda w: grams(spans, w)))


def word_count(c: Column | str) -> Column:
    """Number of parts of a split on white space (leading blanks count as one empty part)."""
    return F.size(F.split(col(c), r"\s+"))


def byte_count(c: Column | str) -> Column:
    return F.octet_length(col(c))


# ---- clean-up rules ----------------------------------------------------------------------------------
# Each list is applied from top to bottom. ("=", a, b) replaces text, ("~", a, b) a pattern.

SENTENCE_RULES = [
    ("=", " n't", "n't"),
    ("=", " )", ")"),
    ("=", "( ", "("),
    ("=", '" ', '"'),
    ("=", ' "', '"'),
    ("~", r" (['.,])", "$1"),
]

WIKI_RULES = [
    ("=", "s '", "s'"),
    ("~", r"/' [0-9]/", "/'[0-9]/"),
    ("=", " @-@ ", "-"),
    ("=", " @,@ ", ","),
    ("=", " @.@ ", "."),
    ("=", " : ", ": "),
    ("=", " ; ", "; "),
    ("=", " . ", ". "),
    ("=", " ! ", "! "),
    ("=", " ? ", "? "),
    ("=", " , ", ", "),
    ("~", r"\(\s*([^\)]*?)\s*\)", "($1)"),
    ("~", r"\[\s*([^\]]*?)\s*\]", "[$1]"),
    ("~", r"\{\s*([^}]*?)\s*\}", "{$1}"),
    ("~", r"\"\s*([^\"]*?)\s*\"", '"$1"'),
    ("~", r"'\s*([^']*?)\s*'", "'$1'"),
    ("=", "= = = =", "===="),
    ("=", "= = =", "==="),
    ("=", "= =", "=="),
    ("=", " ° ", "°"),
    ("=", " \n", "\n"),
    ("=", "\n ", "\n"),
    ("=", " N ", " 1 "),
    ("=", " 's", "'s"),
]

CLOZE_RULES = [
    ("=", " '", "'"),
    ("=", " \n", "\n"),
    ("=", "\n ", "\n"),
    ("=", " n't", "n't"),
    ("=", "`` ", '"'),
    ("=", "''", '"'),
    ("=", " :", ":"),
    ("=", " ;", ";"),
    ("=", " !", "!"),
    ("=", " ?", "?"),
    ("=", " ,", ","),
    ("=", " .", "."),
]

CAPTION_RULES = [
    ("=", " [title]", ". "),
    ("~", r"\[.*?\]", ""),
    ("=", "  ", " "),
]


def apply_rules(c: Column | str, rules: list[tuple[str, str, str]]) -> Column:
    out = col(c)
    for kind, old, new in rules:
        out = F.replace(out, F.lit(old), F.lit(new)) if kind == "=" else F.regexp_replace(out, old, new)
    return out


def detokenize_sentence(c: Column | str) -> Column:
    return apply_rules(c, SENTENCE_RULES)


def detokenize_wiki(c: Column | str) -> Column:
    return apply_rules(c, WIKI_RULES)


def detokenize_cloze(c: Column | str) -> Column:
    return apply_rules(c, CLOZE_RULES)


def clean_caption(c: Column | str) -> Column:
    return apply_rules(strip(c), CAPTION_RULES)


def strip(c: Column | str) -> Column:
    """White space off both ends (``trim`` alone takes blanks only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def capitalize(c: Column | str) -> Column:
    """First character upper case, the rest lower case."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


# ---- parsers -----------------------------------------------------------------------------------------


def judge_labels(c: Column | str) -> Column:
    """Labels listed inside judge tags, split by comma and trimmed."""
    inside = F.regexp_extract_all(col(c), F.lit(r"(?s)<judge>(.*?)</judge>"), 1)
    return F.transform(F.split(strip(F.array_join(inside, "")), ","), strip)


def judge_explanation(c: Column | str) -> Column:
    """The reply without its judge tags."""
    return strip(F.regexp_replace(col(c), r"(?s)<judge>.*?</judge>", ""))


def response_type(c: Column | str, tag_result: Column | None = None) -> Column:
    """Kind of response: tagged code, function code or text.

    Tagged code with an executed result (``tag_result``) is decided; otherwise function code goes first.
    """
    c = col(c)
    tagged, defined = F.contains(c, F.lit("<llm-code>")), F.contains(c, F.lit("def"))
    kind = F.lit(None).cast("string")
    if tag_result is not None:
        kind = F.when(tagged & tag_result.isNotNull(), F.lit("llm-code"))
    fallback = F.when(defined, F.lit("function-code")).when(tagged, F.lit("llm-code")).otherwise(F.lit("text"))
    return F.coalesce(kind, fallback)


def response_answer(c: Column | str, tag_result: Column, def_result: Column, text_answer: Column) -> Column:
    """Executed result where the kind of response has one, else the answer read from the text."""
    c = col(c)
    return F.coalesce(
        F.when(F.contains(c, F.lit("<llm-code>")), tag_result),
        F.when(F.contains(c, F.lit("def")), def_result),
        text_answer,
    )


def tagged_code(c: Column | str) -> Column:
    """Code between the code tags, null when there is none."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?s)<llm-code>(.*?)</llm-code>"), 1)
    return strip(F.get(found, F.lit(0)))


def last_function_code(c: Column | str) -> Column:
    """Everything after the last line that starts with ``def``, with the keyword put back."""
    return F.concat(F.lit("def"), F.substring_index(col(c), "\ndef", -1))


def drop_token(c: Column | str, token: str) -> Column:
    return F.replace(col(c), F.lit(token), F.lit(""))


def strip_special(c: Column | str, pad: str, eos: str) -> Column:
    """Leading and trailing runs of pad and end tokens removed."""
    either = f"({re.escape(eos)}|{re.escape(pad)})+"
    return F.regexp_replace(F.regexp_replace(col(c), f"^{either}", ""), f"{either}$", "")


def human_number(c: Column | str, places: int = 2) -> Column:
    """1.50K, 2.00M, 3.10B, 1.00T; plain below a thousand."""
    c = col(c)
    size = F.abs(c)
    text = size.cast("string")
    for power, suffix in ((1, "K"), (2, "M"), (3, "B"), (4, "T")):
        scaled = F.format_string(f"%.{places}f{suffix}", (size / F.lit(1000.0**power)).cast("double"))
        text = F.when(size >= F.lit(1000**power), scaled).otherwise(text)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), text)


def answer_index(c: Column | str) -> Column:
    """0-based index of an answer letter, or of a 1-based answer digit; null for anything else."""
    text = F.lower(strip(col(c)))
    return F.when(text.rlike("^[a-z]$"), F.ascii(text) - 97).when(text.rlike("^[1-9]$"), text.cast("int") - 1)


def subject_name(c: Column | str) -> Column:
    """Underscores become blanks, with one blank in front of the first word as the prompt text expects."""
    return F.concat(F.lit(" "), F.replace(col(c), F.lit("_"), F.lit(" ")))


def parent_dir(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))


def split_type_path(c: Column | str) -> Column:
    """``a.b.C`` to (module ``a.b``, name ``C``); module is null without a dot."""
    c = col(c)
    module = F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.[^.]*$", ""))
    return F.struct(module.alias("module"), F.substring_index(c, ".", -1).alias("name"))
