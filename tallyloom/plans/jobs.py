"""Composed jobs: what a user calls to build a corpus, a mixture, an epoch, a reward table or a score table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as ans
from ..functions import arrays as ar
from ..functions import text as tx
from ..operators import decontam as dc
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import rows as rw
from ..operators import sampling as sa
from ..operators import tasks as tasks_
from ..operators import tokens as tk
from ..operators import windows as wi
from ..operators.sets import union_with_offset
from ..sources import readers as rd
from ..sources import writers as wr
from .ordering import with_hash_position
from .scratch import materialize


def corpus_build(
    df: DataFrame, key: str, left: str, right: str, copies: int, vocab_size: int, seed: int | str, path: str, max_tokens: int
) -> DataFrame:
    """Pair, tokenise, repeat, shuffle, write shards.

    Texts are tokenised once and repeated as tokens; vocabulary and tokens are saved, as later steps read them
    more than once.
    """
    paired = rw.concat_pair(df, left, right).filter(F.col("text").isNotNull()).select(key, "text")
    vocab = materialize(tk.build_vocab(paired, "text", vocab_size), "vocab")
    encoded = materialize(tk.encode(paired, vocab, key, "text"), "tokens")
    tokens = sa.repeat(encoded, copies)
    shuffled = with_hash_position(tokens, seed, [key, "copy"])
    return wr.write_token_shards(shuffled, path, max_tokens, "pos")


def contamination_report(
    evaluation: DataFrame, train: DataFrame, metric: Callable[[DataFrame], DataFrame], n: int = dc.NGRAM
) -> DataFrame:
    """Metric on all rows and on the clean rows (column ``subset``); rows carry ``task, doc_id, text``."""
    overlap = dc.train_overlap(evaluation, train, n=n)
    full = metric(evaluation).select(F.lit("all").alias("subset"), "*")
    clean = jn.metric_decontaminated(evaluation, overlap, ["task", "doc_id"], metric)
    return full.unionByName(clean.select(F.lit("clean").alias("subset"), "*"))


def mixture(
    df: DataFrame, weights: Mapping[str, float], seed: int | str, source: str, shard: Sequence[str], tokens: str
) -> tuple[DataFrame, DataFrame]:
    """Shards of a weighted mixture and its token report per source."""
    mixed = sa.mix(df, weights, seed, source, shard)
    taken = mixed.groupBy(source).agg(F.sum(tokens).alias("_taken"))
    totals = df.groupBy(source).agg(F.sum(tokens).alias("total_tokens"))
    report = totals.join(taken, source, "left").select(
        source, "total_tokens", F.coalesce("_taken", F.lit(0)).alias("taken_tokens")
    )
    all_taken = mixed.agg(F.sum(tokens).alias("_all"))
    return mixed, report.crossJoin(F.broadcast(all_taken)).withColumn(
        "share", F.format_string("%.4f", F.col("taken_tokens") / F.col("_all"))
    ).drop("_all")


def training_set(
    tokens: DataFrame, size: int, file: str, order: str, masks: str | None = None, max_count: int = 32
) -> DataFrame:
    """Chunks with label mask, attention mask, document lengths and repetition flag."""
    arrays = ["tokens"] + ([masks] if masks else [])
    return tk.training_instances(tk.chunk_tokens(tokens, size, file, order, arrays), max_count)


def epoch_plan(
    df: DataFrame, key: Sequence[str], seed: int, epoch: int, world: int, batch: int, drop_last: bool = False,
    start: int = 0, limit: int | None = None,
) -> DataFrame:
    """Order, padding, restart, rank and batch of one epoch: ids and numbers only."""
    order = sa.pad_or_drop(sa.epoch_order(df, seed, epoch, key), world, drop_last)
    return sa.assign_ranks(sa.resume(order, start, limit), world, batch)


def expert_data(df: DataFrame, path: str, prompt: str, response: str, gold: str) -> DataFrame:
    """Responses whose marked answer equals the gold answer, without repeated pairs; built once."""

    def build() -> DataFrame:
        answer = ans.marked_answer(response)
        right = df.filter((answer != ans.INVALID) & ans.math_equal(answer, F.col(gold)))
        return mt.dedup_pairs(right, prompt, response)

    return wr.read_or_build(df.sparkSession, path, build)


def rejection_sampling(df: DataFrame) -> DataFrame:
    return wi.best_of_n(df, "input", "output", "reward", "seq")


def conditional(df: DataFrame) -> DataFrame:
    return rw.reward_prompt(wi.normalize_reward(df, "reward")).select("input", "output", "reward")


def preference_pairs(df: DataFrame) -> DataFrame:
    return wi.best_worst(df, "input", "output", "reward", "seq")


PROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rs": rejection_sampling,
    "csft": conditional,
    "iter_dpo": preference_pairs,
}


def process(df: DataFrame, name: str) -> DataFrame:
    """Post-processor by name over rows ``seq, input, output, reward``; an unknown name is an error."""
    if name not in PROCESSORS:
        raise ValueError(f"unknown processor {name}; known: {', '.join(PROCESSORS)}")
    return PROCESSORS[name](df)


def advantage_table(
    rollouts: DataFrame, method: str, beta: float, gamma: float, lam: float = 1.0, prompt: str = "prompt",
    keys: Sequence[str] = ("sample",), clip: tuple[float, float] | None = None, normalize: bool = True,
) -> DataFrame:
    """Reward shaping per prompt, token rewards with KL, returns and advantages, global normalisation.

    ``rollouts`` has ``reward`` and the arrays ``logp, base, mask`` (and ``value`` for ``gae``). Methods
    ``gae`` and ``reinforce`` leave the reward as it is; the group methods use a discount of 1.
    """
    shaped = rollouts.withColumn("shaped", F.col("reward"))
    if method not in ("gae", "reinforce"):
        shaped, gamma = wi.shape_rewards(rollouts, method, prompt, "reward"), 1.0
    kl = ar.approx_kl(F.col("logp"), F.col("base"), "k1", F.col("mask"))
    token = shaped.withColumn("_r", ar.token_rewards(F.col("shaped"), kl, F.col("mask"), beta, clip))
    if method == "gae":
        table = token.withColumn("advantage", ar.gae(F.col("value"), F.col("_r"), gamma, lam, F.col("mask")))
        table = table.withColumn("ret", ar.plus(F.col("advantage"), ar.masked(F.col("value"), F.col("mask"))))
    else:
        table = token.withColumn("ret", ar.discounted_returns(F.col("_r"), gamma, F.col("mask"))).withColumn(
            "advantage", F.col("ret")
        )
    long = table.select(prompt, *keys, F.posexplode(F.arrays_zip("ret", "advantage", "mask")).alias("step", "z")).select(
        prompt, *keys, "step", "z.*"
    )
    # normalisation reads the table twice; saving it is cheaper than joining and folding everything again
    return wi.normalize_advantages(materialize(long, "advantages"), "advantage", "mask") if normalize else long


def benchmark_scores(
    docs: DataFrame, task: str, likelihoods: DataFrame, ctx_limit: int, doc_id: str = "doc_id"
) -> DataFrame:
    """Build the requests of a task, attach log-likelihoods by (document, continuation), score with error."""
    samples = tasks_.task_samples(docs, task, ctx_limit, doc_id).select(
        F.col(doc_id).alias("doc_id"), "cont_id", F.col("label_id").alias("label"), "cont_str_len", "cont_byte_len"
    )
    return score_samples(samples, likelihoods, tasks_.task_metric(task), task)


def score_samples(samples: DataFrame, likelihoods: DataFrame, metric: str, task: str) -> DataFrame:
    """Score of samples (``doc_id, cont_id, label``, lengths) by the metric's name, with its error where it is an accuracy.

    ``likelihoods`` holds ``doc_id, cont_id, ll`` (and ``dc_ll`` for ``pmi_dc``). Of repeated rows one counts.
    """
    # both sides have rows for each document and are made by exploding, which Spark's size estimate leaves out: never broadcast
    scored = samples.join(likelihoods.hint("merge"), ["doc_id", "cont_id"]).withColumn("seq", F.lit(0))
    if metric in ("ce_loss", "bpb", "f1"):
        return mt.named_metric(metric)(scored)
    right = mt.mc_predictions(scored, metric).withColumn("_right", mt.truth(F.col("pred") == F.col("label")))
    return mt.mean_stderr(right, "_right").select(
        F.lit(task).alias("task"), F.lit(metric).alias("metric"), F.col("mean").alias("score"), "stderr"
    )


def request_metric(spark: SparkSession, folders: Sequence[str]) -> str:
    """The metric that the configs of the request folders name; none, or two that differ, is an error."""
    named = {rd.primary_metric(spark, f).first()["metric"] for f in folders} - {None}  # one word a folder
    if len(named) != 1:
        raise ValueError(f"the folders name {' and '.join(sorted(named)) or 'no metric'}; say which one to use")
    return named.pop()


def request_samples(
    spark: SparkSession, folders: Sequence[str], metric: str, ctx_limit: int,
    unconditional: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """Samples of several request folders as one set: documents of a later folder are numbered behind those before it.

    ``unconditional(requests)`` marks requests without a context, which take no part, also not in the numbering. Loss
    metrics keep the target continuation only. A request of another type than a likelihood is an error in its task.
    """
    sets = []
    for folder in folders:
        rows = rd.read_eval_requests(spark, folder)
        rows = rw.filter_requests(rows, "acc", unconditional(rows) if unconditional else None)
        known = F.col("request_type") == "loglikelihood"
        fault = F.raise_error(F.concat(F.lit("unsupported request type: "), F.coalesce("request_type", F.lit("none")))).cast("bigint")
        sets.append(rows.withColumn("doc_id", F.when(known, F.col("doc_id")).otherwise(fault)))
    kept = rw.filter_requests(union_with_offset(sets, "doc_id"), metric)
    return rw.request_samples(kept, ctx_limit)


def request_scores(
    spark: SparkSession, folders: Sequence[str], likelihoods: DataFrame, ctx_limit: int, metric: str | None = None,
    unconditional: Callable[[DataFrame], Column] | None = None, name: str = "requests",
) -> DataFrame:
    """Request folders to a score: read, number, pick, attach log-likelihoods by (document, continuation), score.

    Without a metric that of the folders' configs is used.
    """
    metric = metric or request_metric(spark, folders)
    samples = request_samples(spark, folders, metric, ctx_limit, unconditional).select(
        "doc_id", "cont_id", F.col("label_id").alias("label"), "cont_str_len", "cont_byte_len"
    )
    return score_samples(samples, likelihoods, metric, name)


def math_evaluation(df: DataFrame, n: int, text_answer: str | None = None) -> DataFrame:
    """Per response type share and accuracy, with pass@1, pass@n and majority accuracy on every row."""
    greedy = df.agg(F.avg("acc").alias("pass_at_1"))
    majority = mt.majority_at_n(df, text_answer=text_answer).agg(F.avg("maj_acc").alias("final_maj_accuracy"))
    return mt.pass_at_n(df, n).crossJoin(F.broadcast(greedy)).crossJoin(F.broadcast(majority))


def error_analysis(base: DataFrame, ckpt: DataFrame) -> DataFrame:
    """Judge prompts for the questions the new run gets right and the old one got wrong."""
    changed = jn.newly_right(jn.compare_runs(base, ckpt))
    return rw.judge_prompt(changed, "question", "base_output", "ckpt_output")


def judged_errors(prompts: DataFrame, replies: DataFrame, key: str, reply: str) -> DataFrame:
    """Error categories of the judge's replies to those prompts."""
    labelled = prompts.join(replies, key).select(key, tx.judge_labels(reply).alias("labels"))
    return mt.judge_counts(labelled, "labels", key)


def inspect_batches(
    log: DataFrame, instances: DataFrame, vocab: DataFrame, vocab_size: int, steps: Sequence[int] | None = None
) -> DataFrame:
    """Decoded training examples seen at the given steps of an index log.

    An instance is decoded once, however often it was seen; with given steps only those of the steps are.
    """
    if steps is not None:
        log = log.filter(F.col("step").isin(list(steps)))
        instances = instances.join(log, "instance_id", "left_semi")
    texts = tk.decode(instances.select("instance_id", "tokens"), vocab, "instance_id", "tokens")
    return jn.examples_at(log, texts).select(F.col("step").cast("bigint").alias("step"), F.col("slot").cast("int").alias("slot"), "text")


def chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Steps are plain functions, chained with ``transform``."""
    for step in steps:
        df = df.transform(step)
    return df


def with_columns(**columns: Column) -> Callable[[DataFrame], DataFrame]:
    """A step that adds columns."""
    return lambda df: df.withColumns(columns)
