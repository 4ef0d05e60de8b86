"""Joins: run comparison, few-shot examples, category maps, lookups, differences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.common import indices
from ..plans.ordering import hash_key, identity
from ..plans.skew import range_join, skew_join
from .rows import example_text

# ---- run comparison ------------------------------------------------------------------------------------


def compare_runs(base: DataFrame, ckpt: DataFrame, key: str = "question") -> DataFrame:
    """Both runs side by side on the question (columns ``base_*`` and ``ckpt_*``)."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])

    return side(base, "base").join(side(ckpt, "ckpt"), key)


def unmatched_count(base: DataFrame, ckpt: DataFrame, key: str = "question") -> DataFrame:
    """How many baseline questions the other run lacks (one row)."""
    return base.join(ckpt.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))


def newly_right(pairs: DataFrame) -> DataFrame:
    """Questions the baseline got wrong and the checkpoint got right."""
    return pairs.filter((F.col("base_acc") == 0) & (F.col("ckpt_acc") == 1))


def compare_runs_multi(base: DataFrame, ckpt: DataFrame, key: str = "question") -> DataFrame:
    """Runs with many completions (``idx, output, acc``) per question.

    The baseline shows its first completion; the checkpoint its first right one, else its last. A question
    counts as right when any completion is.
    """
    first = base.groupBy(key).agg(F.min_by("output", "idx").alias("base_output"), F.max("acc").alias("base_acc"))
    right = F.col("acc") == 1
    preferred = F.struct(
        (~right).cast("int").alias("wrong"), F.when(right, F.col("idx")).otherwise(-F.col("idx")).alias("at")
    )
    best = ckpt.groupBy(key).agg(F.min_by("output", preferred).alias("ckpt_output"), F.max("acc").alias("ckpt_acc"))
    return first.join(best, key)


# ---- clean subset, results back to their documents -------------------------------------------------------


def metric_decontaminated(
    rows: DataFrame, overlap: DataFrame, keys: Sequence[str], metric: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The same metric over the rows whose document is not in the overlap table."""
    return metric(skew_join(rows, overlap.select(*keys).distinct(), keys, "left_anti"))


def collect_results(
    responses: DataFrame, origin: DataFrame, request: Sequence[str], doc: Sequence[str], order: str, value: str
) -> DataFrame:
    """Responses joined back to their request and listed per document in request order."""
    joined = origin.join(responses.select(*request, value), list(request))
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col(value).alias("v"))))
    return joined.groupBy(*doc).agg(F.transform(listed, lambda s: s["v"]).alias("results"))


# ---- few-shot examples -----------------------------------------------------------------------------------


def fewshot_join(
    dev: DataFrame, test: DataFrame, subject: str, content: Sequence[str], k: int, seed: int | str, shot: Column
) -> DataFrame:
    """``shots``: k example texts of the row's subject, drawn in hash order, never the row itself.

    Only k+1 examples per subject leave the example side, one row per subject reaches the join.
    """

    def with_hash(df: DataFrame) -> DataFrame:
        # drawn by the hash, the same only if every field is
        return df.withColumn("_content", F.concat(hash_key(seed, subject, *content), identity(subject, *content)))

    # equal examples are one example
    distinct = with_hash(dev).groupBy(subject, "_content").agg(F.min(shot).alias("_shot"))
    ranked = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy(subject).orderBy("_content")))
    top = ranked.filter(F.col("_rank") <= k + 1)
    listed = top.groupBy(subject).agg(
        F.sort_array(F.collect_list(F.struct("_rank", "_content", "_shot"))).alias("_shots")
    )
    joined = skew_join(with_hash(test), listed, [subject], "left")
    others = F.filter("_shots", lambda s: s["_content"] != F.col("_content"))
    shots = F.transform(F.slice(others, 1, k), lambda s: s["_shot"])
    return joined.withColumn("shots", F.coalesce(shots, F.array().cast("array<string>"))).drop("_shots", "_content")


def fewshot_prompt(
    dev: DataFrame, test: DataFrame, subject: str, question: str, choices: str, answer: str, k: int, seed: int | str,
    content: Sequence[str] | None = None,
) -> DataFrame:
    """Description, k solved examples of the subject, then the open question."""
    solved = example_text(F.col(question), F.col(choices), F.col(answer))
    rows = fewshot_join(dev, test, subject, content or [question, choices, answer], k, seed, solved)
    # Fixed value: the opening line of the prompt
    about = F.concat(
        F.lit("The following are multiple choice questions (with answers) about "), tx.subject_name(subject), F.lit(".\n\n")
    )
    return rows.withColumn("description", about).withColumn(
        "open_question", example_text(F.col(question), F.col(choices))
    ).withColumn("prompt", F.concat("description", F.array_join("shots", ""), "open_question"))


def fit_fewshot(prompts: DataFrame, limit: int) -> DataFrame:
    """Lower the number of examples until the prompt has at most ``limit`` words (or no example is left)."""
    fixed = F.size(tx.words("description")) + F.size(tx.words("open_question"))
    sized = prompts.withColumn("_fixed", fixed).withColumn("_sizes", F.transform("shots", lambda s: F.size(tx.words(s))))
    needs = F.transform(
        indices(F.size("_sizes")),
        lambda i: F.col("_fixed") + F.aggregate(F.slice("_sizes", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x),
    )
    fitted = sized.withColumn("n_shots", F.size(F.filter(needs, lambda n: n <= limit)))
    shots = F.array_join(F.slice("shots", F.lit(1), F.col("n_shots")), "")
    return fitted.withColumn("prompt", F.concat("description", shots, "open_question")).drop("_fixed", "_sizes")


# ---- lookups ----------------------------------------------------------------------------------------------


def category_join(rows: DataFrame, mapping: DataFrame, subject: str) -> DataFrame:
    """Many-to-many roll-up: every row once per (sub-category, category) of its subject."""
    return skew_join(rows, mapping, [subject], "inner")


def parse_index_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``step <tab> idx <tab> idx ...`` lines to rows (step, slot, instance_id)."""
    parts = F.split(F.col(column), "\t")
    rest = [c for c in lines.columns if c != column]
    return lines.select(
        *rest, F.get(parts, F.lit(0)).cast("bigint").alias("step"), F.slice(parts, F.lit(2), F.size(parts)).alias("ids")
    ).select(*rest, "step", F.posexplode("ids").alias("slot", "id")).select(
        *rest, "step", "slot", F.col("id").cast("bigint").alias("instance_id")
    )


def examples_at(log: DataFrame, instances: DataFrame, steps: Sequence[int] | None = None) -> DataFrame:
    """Training examples seen at the given steps (all steps by default)."""
    seen = log if steps is None else log.filter(F.col("step").isin(list(steps)))
    return skew_join(seen, instances, ["instance_id"], "inner")


def locate(ids: DataFrame, offsets: DataFrame, width: int, index: str = "instance_id") -> DataFrame:
    """Global instance number to file and place in the file, from ``file, start, end`` offsets."""
    return range_join(ids, offsets, index, "start", "end", width).withColumn(
        "local_index", F.col(index) - F.col("start")
    ).drop("start", "end")


def diff_configs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only on one side or with different values: ``side`` is left, right or both."""
    joined = left.withColumnRenamed("value", "left_value").withColumn("_l", F.lit(True)).join(
        right.withColumnRenamed("value", "right_value").withColumn("_r", F.lit(True)), list(keys), "full_outer"
    )
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return joined.withColumn("side", side).filter(
        (F.col("side") != "both") | ~F.col("left_value").eqNullSafe(F.col("right_value"))
    ).drop("_l", "_r")


def diff_path_lists(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """Files per parent directory on both sides, where the counts differ."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(tx.parent_dir(path).alias("dir")).agg(F.count(F.lit(1)).alias(name))

    both = counts(left, "n_left").join(counts(right, "n_right"), "dir", "full_outer")
    filled = both.select("dir", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right")])
    return filled.filter(F.col("n_left") != F.col("n_right"))


def zip_by_index(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Two lists row by row on an explicit index column."""
    return a.join(b, index)


def attach_labels(responses: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """Label of the prompt on every response."""
    return skew_join(responses, prompts, [key], "inner")
