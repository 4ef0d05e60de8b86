"""Reward shaping, selection per prompt, islands, rolling rates and grouped contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import div
from ..plans.ordering import BLOCK, with_halo, with_position
from ..plans.skew import attach_totals, with_group_stats


def shape_rewards(df: DataFrame, method: str, prompt: str, reward: str, out: str = "shaped") -> DataFrame:
    """Reward against the other samples of its prompt.

    ``rloo``: minus the mean of the others. ``baseline``: minus the group mean. ``group_norm``: that over the
    sample deviation plus 1e-9. A prompt with a single sample gets 0 from rloo and group_norm.
    """
    r, n = F.col(reward), F.col("_n")
    if method not in ("rloo", "baseline", "group_norm"):
        raise ValueError(f"unknown method {method}")
    stats = with_group_stats(
        df, [prompt], _n=F.count(F.lit(1)), _sum=F.sum(reward), _mean=F.avg(reward), _std=F.stddev_samp(reward)
    )
    shaped = {
        "rloo": F.when(n > 1, r - (F.col("_sum") - r) / (n - 1)).otherwise(0.0),
        "baseline": r - F.col("_mean"),
        "group_norm": F.when(n > 1, (r - F.col("_mean")) / (F.col("_std") + 1e-9)).otherwise(0.0),
    }[method]
    return stats.withColumn(out, shaped).drop("_n", "_sum", "_mean", "_std")


def normalize_advantages(df: DataFrame, value: str, mask: str | None = None, out: str = "normalized") -> DataFrame:
    """Minus the masked mean, over the masked population deviation (variance at least 1e-8), over all rows.

    The mean divides the full sum by the masked count, as values outside the 0/1 mask are expected to be 0.
    One pass collects everything: the spread around the mean used here is the spread around the mean of the
    masked values plus the squared distance of the two means.
    """
    on = F.when(F.col(mask).cast("int") == 1, F.col(value)) if mask else F.col(value)
    totals = attach_totals(df, _sum=F.sum(value), _n=F.count(on), _avg=F.avg(on), _var=F.var_pop(on))
    mean = F.col("_sum") / F.col("_n")
    var = F.col("_var") + (F.col("_avg") - mean) * (F.col("_avg") - mean)
    return totals.withColumn(out, (F.col(value) - mean) / F.sqrt(F.greatest(var, F.lit(1e-8)))).drop(
        "_sum", "_n", "_avg", "_var"
    )


def normalize_reward(df: DataFrame, reward: str, out: str | None = None) -> DataFrame:
    """Reward minus mean over sample deviation, over the whole table; null if all rewards are equal or there is one."""
    totals = attach_totals(df, _mean=F.avg(reward), _std=F.stddev_samp(reward))
    return totals.withColumn(out or reward, F.try_divide(F.col(reward) - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def best_of_n(df: DataFrame, prompt: str, output: str, reward: str, order: str) -> DataFrame:
    """Best completion per prompt, the earliest on ties."""
    best = F.max_by(F.struct(output, reward), F.struct(F.col(reward), -F.col(order)))
    return df.groupBy(prompt).agg(best.alias("_b")).select(prompt, f"_b.{output}", f"_b.{reward}")


def best_worst(df: DataFrame, prompt: str, output: str, reward: str, order: str) -> DataFrame:
    """Best and worst completion per prompt, the earliest on ties."""
    high = F.max_by(F.struct(output, reward), F.struct(F.col(reward), -F.col(order)))
    low = F.min_by(F.struct(output, reward), F.struct(F.col(reward), F.col(order)))
    both = df.groupBy(prompt).agg(high.alias("_h"), low.alias("_l"))
    return both.select(
        prompt, F.col(f"_h.{output}").alias("chosen"), F.col(f"_h.{reward}").alias("chosen_reward"),
        F.col(f"_l.{output}").alias("rejected"), F.col(f"_l.{reward}").alias("rejected_reward"),
    )


def mismatched_pairs(
    df: DataFrame, batch: int, order: str, prompt: str, response: str, label: str = "label"
) -> DataFrame:
    """All rows plus, per prompt, the response of the next row of its batch (wrapping around), labelled -1."""
    placed = with_position(df, order, out="_pos").withColumn("_batch", div("_pos", batch))
    by_batch = Window.partitionBy("_batch").orderBy("_pos")  # at most ``batch`` rows each
    first = F.first(response).over(by_batch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shifted = placed.withColumn(response, F.coalesce(F.lead(response).over(by_batch), first)).withColumn(label, F.lit(-1))
    return placed.unionByName(shifted).drop("_pos", "_batch")


def islands(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive integers: start, end and length. Equal values must be removed before."""
    placed = with_position(df.select(*by, value), value, by, out="_pos")
    runs = placed.groupBy(*by, (F.col(value) - F.col("_pos")).alias("_run"))
    return runs.agg(
        F.min(value).alias("start"), F.max(value).alias("end"), F.count(F.lit(1)).alias("length")
    ).drop("_run")


def rolling_throughput(
    df: DataFrame, k: int, order: str, tokens: str, seconds: str, out: str = "tokens_per_second", block: int = BLOCK
) -> DataFrame:
    """Tokens per second over the last k batches of the log (fewer at its start); null if they took no time."""
    placed = with_halo(with_position(df, order, out="_pos"), "_pos", k - 1, block=block)
    last = Window.partitionBy("_blk").orderBy("_pos").rowsBetween(-(k - 1), 0)
    rate = F.try_divide(F.sum(tokens).over(last), F.sum(seconds).over(last))
    return placed.withColumn(out, rate).filter(~F.col("_halo")).drop("_pos", "_blk", "_halo")


def grouped_context(
    df: DataFrame, keys: Sequence[str], order: str, question: str, answer: str, head: Column, out: str = "context"
) -> DataFrame:
    """Earlier questions of a passage with their answers as context, the last question as target.

    A group is one passage or dialogue.
    """
    item = F.struct(F.col(order).alias("o"), F.col(question).alias("q"), F.col(answer).alias("a"))
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"), F.min(head).alias("_head"))
    earlier = F.slice("_items", F.lit(1), F.size("_items") - 1)
    text = F.array_join(
        F.transform(earlier, lambda i: F.concat(F.lit("Question: "), i["q"], F.lit("\nAnswer: "), i["a"], F.lit("\n"))), ""
    )
    last = F.element_at("_items", -1)
    return grouped.select(
        *keys, F.concat("_head", text, last["q"]).alias(out), last["a"].alias("target"), F.size("_items").alias("n_items")
    )
