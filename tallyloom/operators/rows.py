"""Row builders: prompts, chats, preference rows, choices and evaluation samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.common import col, let
from ..plans.ordering import hash_int

# Output formats.
PAIR_SEPARATOR = "\n\n"
REWARD_TEMPLATE = "{input} <rm_score>: {reward} "


# ---- grouping rows into one row of arrays --------------------------------------------------------------


def step_arrays(df: DataFrame, keys: Sequence[str], order: Sequence[str], **columns: Column) -> DataFrame:
    """One row per key with the steps of a rollout as arrays in ``order``. A group is one rollout."""
    step = F.struct(*order, *[c.alias(f"_{name}") for name, c in columns.items()])
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    return grouped.select(*keys, *[F.col(f"_steps._{name}").alias(name) for name in columns])


def pack_groups(
    df: DataFrame, keys: Sequence[str], order: str, tokens: str, multiple: int = 1, pad_id: int = 0
) -> DataFrame:
    """Concatenate the token arrays of a batch into one row.

    ``samples`` numbers the owner of every slot from 1, 0 for padding; ``lengths`` lists the sample sizes.
    A group is one training batch, so its size is the caller's batch size.
    """
    member = F.struct(F.col(order).alias("o"), F.col(tokens).alias("x"))
    grouped = df.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(member)), lambda m: m["x"]).alias("_parts")
    )
    sized = grouped.select(
        *keys, F.flatten("_parts").alias("_ids"), F.transform("_parts", F.size).alias("lengths"),
        F.flatten(F.transform("_parts", lambda p, i: F.array_repeat(i + 1, F.size(p)))).alias("_samples"),
    )
    n = F.size("_ids")
    fill = F.array_repeat(F.lit(pad_id), F.pmod(-n, F.lit(multiple)))
    zeros = F.array_repeat(F.lit(0), F.pmod(-n, F.lit(multiple)))
    return sized.select(
        *keys, n.alias("n_tokens"), "lengths",
        F.concat("_ids", fill).alias("ids"), F.concat("_samples", zeros).alias("samples"),
    )


# ---- prompts and chats ---------------------------------------------------------------------------------


def concat_pair(df: DataFrame, left: str, right: str, sep: str = PAIR_SEPARATOR, out: str = "text") -> DataFrame:
    """``left + sep + right``; a missing side makes the result missing."""
    return df.withColumn(out, F.concat(F.col(left), F.lit(sep), F.col(right)))


def apply_template(
    df: DataFrame, template: str, input_key: str, label_key: str | None = None
) -> DataFrame:
    """``prompt`` from a template with one ``{}`` and ``label`` (empty without a label column)."""
    label = F.coalesce(F.col(label_key).cast("string"), F.lit("")) if label_key else F.lit("")
    return df.withColumn("prompt", F.replace(F.lit(template), F.lit("{}"), F.col(input_key))).withColumn("label", label)


def role_header(role: Column | str) -> Column:
    return F.concat(F.lit("<|"), col(role), F.lit("|>\n"))


def message_body(role: Column | str, text: Column | str, eos: str) -> Column:
    """Stripped content with the end token behind assistant turns and a final line break."""
    return F.concat(tx.strip(text), F.when(col(role) == "assistant", F.lit(eos)).otherwise(F.lit("")), F.lit("\n"))


def render_chat(df: DataFrame, key: str = "conv_id", eos: str = "</s>") -> DataFrame:
    """One text per conversation. A group is one conversation."""
    piece = F.concat(role_header("role"), message_body("role", "text", eos))
    turns = F.sort_array(F.collect_list(F.struct("turn", piece.alias("piece"))))
    return df.groupBy(key).agg(F.array_join(F.transform(turns, lambda t: t["piece"]), "").alias("text"))


def sft_rows(df: DataFrame, max_len: int, key: str = "conv_id", eos: str = "</s>") -> DataFrame:
    """Prompt, response and training text per conversation; the last message is the response.

    Dropped when prompt or response is empty or the prompt has ``max_len - 2`` words or more.
    """
    turn = F.struct(
        "turn", F.concat(role_header("role"), message_body("role", "text", eos)).alias("piece"),
        role_header("role").alias("header"), message_body("role", "text", eos).alias("body"),
    )
    chats = df.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last = F.element_at("turns", -1)
    history = F.array_join(
        F.transform(F.slice("turns", F.lit(1), F.size("turns") - 1), lambda t: t["piece"]), ""
    )
    rows = chats.select(
        key, F.when(F.size("turns") > 1, F.concat(history, last["header"])).otherwise("").alias("prompt"),
        last["body"].alias("response"),
    )
    text = F.regexp_replace(F.concat("prompt", "response"), "\n+$", "")
    return (
        rows.withColumn("prompt_len", F.size(tx.words("prompt")))
        .filter((F.col("prompt") != "") & (F.col("response") != "") & (F.col("prompt_len") < max_len - 2))
        .withColumn("text", F.when(F.endswith(text, F.lit(eos)), text).otherwise(F.concat(text, F.lit(" " + eos))))
    )


def response_ranges(df: DataFrame, key: str = "conv_id", eos: str = "</s>") -> DataFrame:
    """Half-open token range of every assistant turn: from the prompt so far, without the last token."""
    body = F.size(tx.words(message_body("role", "text", eos)))
    before = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    counted = df.select(key, "turn", "role", body.alias("_body"))
    header = 1  # one word per role header
    ranged = counted.withColumn(
        "start", (F.coalesce(F.sum(F.col("_body") + header).over(before), F.lit(0)) + header).cast("int")
    )
    return ranged.filter(F.col("role") == "assistant").select(
        key, "turn", "start", (F.col("start") + F.col("_body") - 1).alias("end")
    )


def label_mask(
    df: DataFrame, seq_len: int, key: str = "conv_id", eos: str = "</s>", pad_token: str = "<pad>"
) -> DataFrame:
    """Fixed-length token and mask arrays; only assistant content and its end token are labels."""
    assistant = F.col("role") == "assistant"
    end = F.when(assistant, F.array(F.lit(eos))).otherwise(F.array().cast("array<string>"))
    turn = df.select(
        key, "turn", F.array(F.concat(F.lit("<|"), "role", F.lit("|>")), F.lit("\n")).alias("head"),
        F.concat(tx.words("text"), end).alias("body"), assistant.alias("labelled"),
    )
    tokens = F.concat("head", "body", F.array(F.lit("\n")))
    mask = F.concat(
        F.array_repeat(F.lit(False), F.size("head")), F.array_repeat(F.col("labelled"), F.size("body")),
        F.array(F.lit(False)),
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", tokens.alias("t"), mask.alias("m"))))
    chats = turn.groupBy(key).agg(turns.alias("turns")).select(
        key,
        F.concat(F.array(F.lit(eos)), F.flatten(F.transform("turns", lambda x: x["t"]))).alias("t"),
        F.concat(F.array(F.lit(False)), F.flatten(F.transform("turns", lambda x: x["m"]))).alias("m"),
    )
    padding = F.greatest(F.lit(seq_len) - F.size("t"), F.lit(0))
    return (
        chats.select(
            key,
            F.slice(F.concat("t", F.array_repeat(F.lit(pad_token), padding)), 1, seq_len).alias("tokens"),
            F.slice(F.concat("m", F.array_repeat(F.lit(False), padding)), 1, seq_len).alias("label_mask"),
        )
        .withColumn("n_labels", F.size(F.filter("label_mask", lambda x: x)))
        .filter(F.col("n_labels") > 0)
    )


# ---- preference data -----------------------------------------------------------------------------------


def preference_rows(
    df: DataFrame, max_len: int, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected",
    margin: str | None = None,
) -> DataFrame:
    """Prompt prefix off both answers, margin 0 by default, over-long prompts dropped."""

    def tail(answer: str) -> Column:
        a, p = F.col(answer), F.col(prompt)
        return F.when(F.startswith(a, p), F.substr(a, F.length(p) + 1)).otherwise(a)

    gap = F.coalesce(F.col(margin).cast("double"), F.lit(0.0)) if margin else F.lit(0.0)
    rest = [c for c in df.columns if c not in (prompt, chosen, rejected, margin)]
    return df.filter(F.size(tx.words(prompt)) < max_len - 2).select(
        *rest, F.col(prompt).alias("prompt"), tail(chosen).alias("chosen"), tail(rejected).alias("rejected"),
        gap.alias("margin"),
    )


def unpaired_rows(df: DataFrame, max_len: int, prompt: str, response: str, label: str) -> DataFrame:
    """Prompt, response and label; over-long prompts dropped."""
    rest = [c for c in df.columns if c not in (prompt, response, label)]
    return df.filter(F.size(tx.words(prompt)) < max_len - 2).select(
        *rest, F.col(prompt).alias("prompt"), F.col(response).alias("response"), F.col(label).cast("int").alias("label")
    )


def reward_prompt(
    df: DataFrame, input_key: str = "input", reward_key: str = "reward", template: str = REWARD_TEMPLATE
) -> DataFrame:
    """Input text with its reward (two digits) written into the prompt."""
    if "{input}" not in template or "{reward}" not in template:
        raise ValueError("the template needs {input} and {reward}")
    reward = F.format_string("%.2f", F.col(reward_key))
    text = F.replace(F.replace(F.lit(template), F.lit("{reward}"), reward), F.lit("{input}"), F.col(input_key))
    return df.withColumn(input_key, text)


JUDGE_TEMPLATE = (
    "Question: {question}\n\nIncorrect answer: {wrong}\n\nCorrect answer: {right}\n\n"
    "Name the kinds of mistake between <judge></judge> tags, separated by commas, and explain them after the tags.\n"
)


def judge_prompt(
    df: DataFrame, question: str, wrong: str, right: str, template: str = JUDGE_TEMPLATE
) -> DataFrame:
    """Prompt that asks what changed between a wrong and a right answer."""
    text = F.lit(template)
    for slot, column in (("{question}", question), ("{wrong}", wrong), ("{right}", right)):
        text = F.replace(text, F.lit(slot), F.col(column))
    return df.withColumn("prompt", text)


# ---- projections ---------------------------------------------------------------------------------------


def project_fields(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] | None = None) -> DataFrame:
    """Keep the named fields, or all but the named fields; not both. Unknown names are ignored."""
    if keep and drop:
        raise ValueError("name fields to keep or fields to drop, not both")
    if keep:
        return df.select(*[c for c in keep if c in df.columns])
    return df.drop(*(drop or []))


def filter_requests(df: DataFrame, metric: str, unconditional: Column | None = None) -> DataFrame:
    """No unconditional requests; for loss metrics only the target continuation, as the single choice 0.

    ``unconditional`` says which rows are unconditional requests (null: not); without it there are none, whatever the
    document numbers. A label that is a name and no number does not choose among continuations: its row stays.
    """
    kept = df if unconditional is None else df.filter(~F.coalesce(unconditional, F.lit(False)))
    if metric in ("ce_loss", "bpb"):
        number = F.expr("try_cast(label AS bigint)")
        named = number.isNull() & F.col("label").isNotNull()
        kept = kept.filter(named | (F.col("idx") == number)).withColumns({"idx": F.lit(0), "label": F.lit(0)})
    return kept


def remap_prefix(df: DataFrame, column: str, mounts: Mapping[str, str], out: str | None = None) -> DataFrame:
    """The first mount prefix that matches is replaced."""
    c, result = F.col(column), F.col(column)
    for old, new in reversed(list(mounts.items())):
        result = F.when(F.startswith(c, F.lit(old)), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(result)
    return df.withColumn(out or column, result)


def relabel_fields(df: DataFrame, mapping: Mapping[str, str | None]) -> DataFrame:
    """Standard name to source column; a missing optional source becomes null."""
    return df.select(
        *[
            (F.col(src) if src in df.columns else F.lit(None).cast("string")).alias(name)
            for name, src in mapping.items()
        ]
    )


def select_subset(df: DataFrame, name: str, subset: str = "subset", spans: str = "char_spans") -> DataFrame:
    """Rows of one subset (any case), id renamed, answer starts rebuilt from the first span of each answer."""
    starts = F.transform(F.col(spans), lambda s: F.element_at(s, 1)["start"])
    return (
        df.filter(F.lower(subset) == name.lower())
        .withColumnsRenamed({"qid": "id"})
        .withColumn("answer_start", starts)
        .drop(subset, spans)
    )


def to_classification(
    df: DataFrame, premise: str, label: str, labels: Mapping[int, str], hypothesis: str | None = None
) -> DataFrame:
    """Text fields with the label name looked up by label id."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    text = [F.col(premise).alias("premise")] + ([F.col(hypothesis).alias("hypothesis")] if hypothesis else [])
    rest = [c for c in df.columns if c not in (premise, label, hypothesis)]
    return df.select(*rest, *text, F.try_element_at(F.create_map(*pairs), F.col(label)).alias("label"))


def to_io_rows(
    df: DataFrame, kind: str, id_key: str, input_key: str, target_key: str | None = None,
    languages: tuple[str, str] | None = None,
) -> DataFrame:
    """Uniform ``id, input, target`` rows. ``kind`` is translation, classification or unlabeled.

    Translation reads both sides from a struct column by language; unlabeled rows have no target.
    """
    ident = F.col(id_key).cast("string").alias("id")
    if kind == "translation":
        source, target = languages
        return df.select(ident, F.col(f"{input_key}.{source}").alias("input"), F.col(f"{input_key}.{target}").alias("target"))
    if kind == "classification":
        return df.select(ident, F.col(input_key).alias("input"), F.col(target_key).cast("string").alias("target"))
    if kind == "unlabeled":
        return df.select(ident, F.col(input_key).alias("input"))
    raise ValueError(f"unknown kind {kind}")


def truncate_prompt(df: DataFrame, column: str, key: str, max_words: int, seed: int | str) -> DataFrame:
    """The first r words, r drawn per row from 0 to ``max_words - 1``."""
    r = (hash_int(seed, key) % max_words).cast("int")
    return df.withColumn(column, F.array_join(F.slice(F.split(F.col(column), " "), F.lit(1), r), " "))


# ---- choices -------------------------------------------------------------------------------------------


def to_multiple_choice(
    df: DataFrame, question: str, choices: Sequence[str], answer: str | None = None, correct_field: str | None = None,
    context: str | None = None, answer_map: Mapping[str, int] | None = None,
) -> DataFrame:
    """``question, answer_choices, correct_index`` from a field mapping.

    Choices are stripped and missing ones dropped. The answer column holds a letter or an index (or is looked
    up in ``answer_map``); empty and -1 give null. When the right answer always sits in ``correct_field`` the
    choices are shuffled by a hash of the question.
    """
    if (answer is None) == (correct_field is None):
        raise ValueError("name either the answer column or the field that holds the right answer")
    q = tx.strip(question)
    if context:
        q = F.concat(tx.strip(context), F.lit(" "), q)
    options = F.array_compact(F.array(*[tx.strip(c) for c in choices]))
    rest = [c for c in df.columns if c not in {question, context, answer, correct_field, *choices}]
    if answer is not None:
        raw = F.col(answer)
        if answer_map:
            index = F.try_element_at(F.create_map(*[F.lit(x) for kv in answer_map.items() for x in kv]), raw)
        elif df.schema[answer].dataType.typeName() == "string":
            low = F.lower(raw)
            index = F.when(low.rlike("^[a-z]$"), F.ascii(low) - 97)
        else:
            index = raw.cast("int")
        return df.select(
            *rest, q.alias("question"), options.alias("answer_choices"),
            F.when(index >= 0, index).alias("correct_index"),
        )
    where = list(choices).index(correct_field)
    return shuffle_choices(
        df.select(*rest, q.alias("question"), options.alias("answer_choices"), F.lit(where).alias("correct_index"))
    )


def shuffle_choices(df: DataFrame) -> DataFrame:
    """Choices in an order that depends on the question alone; the correct index follows."""
    ranked = F.array_sort(
        F.transform(
            "answer_choices",
            lambda c, i: F.struct(F.md5(F.concat_ws(":", "question", i)).alias("h"), i.alias("i"), c.alias("c")),
        )
    )
    order = df.withColumn("_order", ranked)
    place = F.array_position(F.transform("_order", lambda s: s["i"]), F.col("correct_index")) - 1
    return order.withColumn("correct_index", place.cast("int")).withColumn(
        "answer_choices", F.transform("_order", lambda s: s["c"])
    ).drop("_order")


def gold_only(df: DataFrame, choices: str = "answer_choices", answer: str = "correct_index") -> DataFrame:
    """Only the right choice, at index 0 (for loss metrics)."""
    return df.withColumn(choices, F.array(F.element_at(choices, F.col(answer) + 1))).withColumn(answer, F.lit(0))


# ---- evaluation samples --------------------------------------------------------------------------------


def _cut(query: Column, limit: int) -> Column:
    return let(query, lambda q: F.slice(q, F.greatest(F.size(q) - limit + 1, F.lit(1)), F.lit(limit)))


def _without_last(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def eval_samples(
    df: DataFrame, ctx_limit: int, doc_id: str = "doc_id", context: str = "context",
    choices: str = "continuations", label: str = "label", domain: str = "domain",
) -> DataFrame:
    """One row per (document, continuation) with the lengths that normalise its score.

    A continuation starts with a blank that character and byte lengths leave out. The query is context plus
    continuation without its last token, cut from the left to ``ctx_limit`` tokens (words).
    """
    return _samples(
        df.select(
            doc_id, F.col(context).alias("_context"), F.col(domain).alias("_domain"), F.col(label).alias("label_id"),
            F.posexplode(choices).alias("cont_id", "continuation_text"),
        ),
        ctx_limit, doc_id,
    )


def request_samples(df: DataFrame, ctx_limit: int, domain: str = " ") -> DataFrame:
    """The same columns from rows of a request file (``doc_id, context, continuation, idx, label``).

    A label that is no number matches no continuation (-1). ``domain`` is the text that stands in for the context.
    """
    named = F.coalesce(F.expr("try_cast(label AS int)"), F.lit(-1))
    return _samples(
        df.select(
            "doc_id", F.col("context").alias("_context"), F.lit(domain).alias("_domain"), named.alias("label_id"),
            F.col("idx").alias("cont_id"), F.col("continuation").alias("continuation_text"),
        ),
        ctx_limit, "doc_id",
    )


def _samples(long: DataFrame, ctx_limit: int, doc_id: str) -> DataFrame:
    """Token columns and lengths of rows ``_context, _domain, label_id, cont_id, continuation_text``."""
    split = long.select(
        doc_id, "cont_id", "label_id", "continuation_text", tx.words("_context").alias("ctx"), tx.words("_domain").alias("dc"),
        tx.words("continuation_text").alias("continuation"),
    )
    built = split.withColumn("query", _cut(F.concat("ctx", _without_last(F.col("continuation"))), ctx_limit))
    return built.select(
        doc_id, "cont_id", "ctx", "continuation",
        (F.size("query") - F.size("continuation") + 1).alias("ctx_len"), F.size("dc").alias("dc_len"),
        F.size("continuation").alias("cont_len"), (F.length("continuation_text") - 1).alias("cont_str_len"),
        F.octet_length(F.substring("continuation_text", 2, 1 << 30)).alias("cont_byte_len"), "query",
        F.concat("dc", _without_last(F.col("continuation"))).alias("dc_query"), "label_id",
    )


def blank_samples(
    df: DataFrame, ctx_limit: int, doc_id: str, sentence: str, options: Sequence[str], answer: str, blank: str = "_"
) -> DataFrame:
    """Several contexts, one continuation: the text up to the blank with each option, scored on the rest."""
    before = F.substring_index(F.col(sentence), blank, 1)
    rest = F.substr(F.col(sentence), F.length(before) + len(blank) + 1)
    contexts = F.array(*[F.struct(F.concat(before, F.col(o)).alias("ctx"), F.col(o).alias("dc")) for o in options])
    long = df.filter(F.contains(F.col(sentence), F.lit(blank))).select(
        doc_id, (F.col(answer).cast("int") - 1).alias("label_id"),
        F.concat(F.lit(" "), tx.strip(rest)).alias("continuation_text"), F.posexplode(contexts).alias("cont_id", "c"),
    )
    built = long.select(
        doc_id, "cont_id", "label_id", "continuation_text", tx.words("c.ctx").alias("ctx"),
        tx.words("c.dc").alias("dc"), tx.words("continuation_text").alias("continuation"),
    )
    return built.select(
        doc_id, "cont_id", "ctx", "continuation", F.size("ctx").alias("ctx_len"), F.size("dc").alias("dc_len"),
        F.size("continuation").alias("cont_len"), (F.length("continuation_text") - 1).alias("cont_str_len"),
        F.octet_length(F.substring("continuation_text", 2, 1 << 30)).alias("cont_byte_len"),
        _cut(F.concat("ctx", _without_last(F.col("continuation"))), ctx_limit).alias("query"),
        F.concat("dc", _without_last(F.col("continuation"))).alias("dc_query"), "label_id",
    )


def rank_rows(
    df: DataFrame, input_key: str = "input", options: str = "options", gold: str = "output",
    prefix: str | None = None, sep: str = " ",
) -> DataFrame:
    """One (prompt, option) pair per option behind a few-shot prefix; the label is the place of the gold option."""
    lead = F.coalesce(F.col(prefix), F.lit("")) if prefix else F.lit("")
    rest = [c for c in df.columns if c not in (input_key, options, gold, prefix)]
    return df.select(
        *rest, F.concat(lead, F.col(input_key)).alias("prompt"),
        (F.array_position(options, F.col(gold)) - 1).cast("int").alias("label"),
        F.posexplode(F.transform(options, lambda o: F.concat(F.lit(sep), o))).alias("option_id", "option"),
    )


def example_text(question: Column, choices: Column, answer: Column | None = None) -> Column:
    """Question, lettered choices and ``Answer:``; with the answer letter for a solved example."""
    letters = F.transform(
        choices, lambda c, i: F.concat(F.lit("\n"), F.char(65 + i), F.lit(". "), c)
    )
    text = F.concat(question, F.array_join(letters, ""), F.lit("\nAnswer:"))
    return text if answer is None else F.concat(text, F.lit(" "), F.char(65 + answer), F.lit("\n\n"))

