"""Evaluation metrics as plain aggregates: partial sums on the map side, small tables after one exchange."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as ans
from ..functions import text as tx
from ..functions.common import div
from ..plans.ordering import hash_key, hash_wide, range_running_sums
from ..plans.skew import attach_totals, range_join, with_group_stats

BROADCAST_TUPLES = 200_000  # distinct value tuples that resampling sends to every executor

# Fixed value: bits per nat as the reference results use it.
LOG2_E = 1.44269504089


def truth(c: Column) -> Column:
    """Condition to 1.0 or 0.0."""
    return c.cast("int").cast("double")


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)


# ---- completions ---------------------------------------------------------------------------------------


def pass_at_1(df: DataFrame, kind: str = "response_type", acc: str = "acc") -> DataFrame:
    """Per response type its share and mean accuracy, with the overall accuracy on every row."""
    per_kind = df.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"), F.sum(acc).alias("_sum"))
    totals = attach_totals(per_kind, _all=F.sum("_n"), _acc=F.sum("_sum"))
    return totals.select(
        kind, (F.col("_n") / F.col("_all")).alias("share"), (F.col("_sum") / F.col("_n")).alias("acc"),
        (F.col("_acc") / F.col("_all")).alias("final_accuracy"),
    )


def pass_at_n(df: DataFrame, n: int, doc: str = "doc_id", kind: str = "response_type", acc: str = "acc") -> DataFrame:
    """As above, where a document is right when any of its completions is exactly right."""
    per_doc = df.groupBy(doc).agg(F.max(truth(F.col(acc) == 1)).alias("_right"))
    overall = per_doc.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_right").alias("final_accuracy"))
    per_kind = df.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"), F.avg(acc).alias("acc"))
    return per_kind.crossJoin(F.broadcast(overall)).select(
        kind, (F.col("_n") / (F.col("_docs") * n)).alias("share"), "acc", "final_accuracy"
    )


def majority_at_n(
    df: DataFrame, doc: str = "doc_id", order: str = "idx", answer: str = "answer", gold: str = "gold",
    text_answer: str | None = None,
) -> DataFrame:
    """Accuracy of the most frequent answer per document (the first seen wins ties).

    If that answer is wrong the most frequent text answer is tried; nothing parsed counts as wrong.
    """

    def winner(column: str) -> DataFrame:
        votes = df.filter(F.col(column).isNotNull()).groupBy(doc, column).agg(
            F.count(F.lit(1)).alias("_votes"), F.min(order).alias("_first"), F.min(gold).alias("_gold")
        )
        best = F.max_by(column, F.struct("_votes", (-F.col("_first")).alias("early")))
        return votes.groupBy(doc).agg(best.alias("_best"), F.min("_gold").alias("_gold")).select(
            doc, F.coalesce(truth(F.col("_best") == F.col("_gold")), F.lit(0.0)).alias(f"_{column}_right")
        )

    result = df.select(doc).distinct().join(winner(answer), doc, "left")
    right = F.coalesce(F.col(f"_{answer}_right"), F.lit(0.0))
    if text_answer:
        result = result.join(winner(text_answer), doc, "left")
        right = F.greatest(right, F.coalesce(F.col(f"_{text_answer}_right"), F.lit(0.0)))
    return result.select(doc, right.alias("maj_acc"))


# ---- multiple choice -----------------------------------------------------------------------------------

def _choice_value(metric: str) -> Column:
    ll = F.col("ll")
    forms = {
        "acc": lambda: ll,
        "f1": lambda: ll,
        "len_norm": lambda: F.try_divide(ll, F.col("cont_str_len")),
        "pmi_dc": lambda: F.try_divide(ll, F.col("dc_ll")),
        "ce_loss": lambda: F.try_divide(-ll, F.col("cont_str_len")),
        "bpb": lambda: F.try_divide(-ll, F.col("cont_byte_len")) * LOG2_E,
    }
    if metric not in forms:
        raise ValueError(f"unknown metric {metric}")
    return forms[metric]()


def mc_predictions(df: DataFrame, metric: str = "acc", order: str = "seq") -> DataFrame:
    """``doc_id, pred, label``: the continuation with the best value, first wins ties.

    Of repeated (doc_id, cont_id) rows the first by ``order`` counts; documents with a gap are left out.
    """
    valued = df.withColumn("_value", _choice_value(metric).cast("double"))
    once = valued.groupBy("doc_id", "cont_id").agg(
        F.min_by("_value", order).alias("_value"), F.min(F.struct(F.col(order), F.col("label"))).alias("_l")
    )
    per_doc = once.groupBy("doc_id").agg(
        F.max_by("cont_id", F.struct("_value", -F.col("cont_id"))).alias("pred"),
        F.min("_l")["label"].alias("label"), F.max("cont_id").alias("_last"), F.count(F.lit(1)).alias("_n"),
    )
    return per_doc.filter(F.col("_last") + 1 == F.col("_n")).select("doc_id", "pred", "label")


def mc_accuracy(df: DataFrame, metric: str = "acc", order: str = "seq") -> DataFrame:
    return mc_predictions(df, metric, order).agg(
        F.avg(truth(F.col("pred") == F.col("label"))).alias("acc"), F.count(F.lit(1)).alias("n")
    )


def gold_loss(df: DataFrame, order: str = "seq") -> DataFrame:
    """Mean loss per character and bits per byte of the single gold continuation."""
    gold = df.filter(F.col("cont_id") == 0).groupBy("doc_id").agg(
        F.min_by(_choice_value("ce_loss"), order).alias("ce"), F.min_by(_choice_value("bpb"), order).alias("bpb")
    )
    return gold.agg(F.avg("ce").alias("ce_loss"), F.avg("bpb").alias("bpb"))


# ---- classification ------------------------------------------------------------------------------------


def _counts(gold: Column, pred: Column, positive: Column) -> dict[str, Column]:
    g, p = gold == positive, pred == positive
    return {"tp": F.sum(truth(g & p)), "fp": F.sum(truth(~g & p)), "fn": F.sum(truth(g & ~p)), "tn": F.sum(truth(~g & ~p))}


def f1_binary(df: DataFrame, gold: str, pred: str, positive: int = 1) -> DataFrame:
    """F1 of one class (0 when undefined) and accuracy."""
    counts = _counts(F.col(gold), F.col(pred), F.lit(positive))
    agg = df.agg(*[e.alias(n) for n, e in counts.items()], F.avg(truth(F.col(gold) == F.col(pred))).alias("acc"))
    return agg.select(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "acc")


def f1_macro(df: DataFrame, gold: str, pred: str, classes: Sequence) -> DataFrame:
    """Mean of the per-class F1 and accuracy."""
    cells = df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("_n"))  # at most classes x classes rows

    def of_class(k) -> Column:
        g, p = F.col(gold) == F.lit(k), F.col(pred) == F.lit(k)
        n = F.col("_n")
        both = F.sum(F.when(g & p, n).otherwise(0))
        return ratio(2.0 * both, F.sum(F.when(g, n).otherwise(0)) + F.sum(F.when(p, n).otherwise(0)))

    total = of_class(classes[0])
    for k in classes[1:]:
        total = total + of_class(k)
    right = F.sum(F.when(F.col(gold) == F.col(pred), F.col("_n")).otherwise(0))
    return cells.agg((total / len(classes)).alias("f1"), (right / F.sum("_n")).alias("acc"))


def mcc(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Matthews correlation of two 0/1 columns; 0 when undefined."""
    counts = _counts(F.col(gold), F.col(pred), F.lit(1))
    agg = df.agg(*[e.alias(n) for n, e in counts.items()])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    bottom = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return agg.select(ratio(tp * tn - fp * fn, bottom).alias("mcc"))


def accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.agg(F.avg(truth(F.col(gold) == F.col(pred))).alias("acc"))


def relative_accuracy(df: DataFrame, gold: str, pred: str, k: int) -> DataFrame:
    """Improvement over chance among ``k`` classes."""
    return accuracy(df, gold, pred).select(((F.col("acc") - 1.0 / k) / (1.0 / k)).alias("relative_improvement"))


# ---- grouped correctness ---------------------------------------------------------------------------------


def group_correct(df: DataFrame, keys: Sequence[str], right: str) -> DataFrame:
    """One flag per group: all of its rows are right."""
    return df.groupBy(*keys).agg(F.min(truth(F.col(right))).alias("all_right"))


def all_correct(df: DataFrame, keys: Sequence[str], question: Sequence[str], right: str) -> DataFrame:
    """Share of groups with all rows right; the standard error groups by ``question`` alone."""
    acc = group_correct(df, keys, right).agg(F.avg("all_right").alias("acc"))
    err = group_correct(df, question, right).agg(
        (F.stddev_samp("all_right") / F.sqrt(F.count(F.lit(1)))).alias("acc_stderr")
    )
    return acc.crossJoin(F.broadcast(err))


def group_em(df: DataFrame, group: str, right: str) -> DataFrame:
    return group_correct(df, [group], right).agg(F.avg("all_right").alias("em"))


def question_f1(df: DataFrame, question: Sequence[str], gold: str, pred: str) -> DataFrame:
    """Exact match and F1 of the positive sets per question, averaged.

    Precision and recall are 1 when nothing was predicted or nothing is positive; a question with both 0 has
    no F1.
    """
    g, p = F.col(gold) == 1, F.col(pred) == 1
    per = df.groupBy(*question).agg(
        F.sum(truth(g & p)).alias("tp"), F.sum(truth(p)).alias("pp"), F.sum(truth(g)).alias("gp"),
        F.min(truth(F.col(gold) == F.col(pred))).alias("em"),
    )
    precision = ratio(F.col("tp"), F.col("pp"), 1.0)
    recall = ratio(F.col("tp"), F.col("gp"), 1.0)
    scored = per.select("em", precision.alias("p"), recall.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return scored.agg(F.avg("em").alias("em"), F.avg(f1).alias("f1"))


# ---- likelihood --------------------------------------------------------------------------------------------


def perplexity(df: DataFrame, ll: str = "ll", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.exp(-F.avg(ll)).alias("ppl"))


def corpus_perplexity(df: DataFrame, ll: str, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Word and byte perplexity and bits per byte, weighted by size."""
    sums = df.groupBy(*by).agg(
        F.sum(ll).alias("_ll"), F.sum(tx.word_count(text)).alias("_w"), F.sum(tx.byte_count(text)).alias("_b")
    )
    return sums.select(
        *by, F.exp(-F.col("_ll") / F.col("_w")).alias("word_perplexity"),
        F.exp(-F.col("_ll") / F.col("_b")).alias("byte_perplexity"),
        (-F.col("_ll") / F.col("_b") / F.log(F.lit(2.0))).alias("bits_per_byte"),
    )


def entropy_per_unit(df: DataFrame, ll: str, units: Column, base: float = 2.0) -> DataFrame:
    """Entropy per unit (bits per character by default) from mergeable sums."""
    return df.agg((-F.sum(ll) / F.sum(units) / F.log(F.lit(base))).alias("entropy"))


def token_ppl(df: DataFrame, ll: str, units: Column) -> DataFrame:
    return df.agg(F.exp(-F.sum(ll) / F.sum(units)).alias("ppl"))


def eval_loss(df: DataFrame, label: str, loss: str, weight: str | None = None) -> DataFrame:
    """Weighted mean loss and perplexity per label; labels without weight or with a NaN loss are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    means = df.groupBy(label).agg(F.sum(w).alias("_w"), F.sum(F.col(loss) * w).alias("_s"))
    return means.filter((F.col("_w") > 0) & ~F.isnan("_s")).select(
        label, (F.col("_s") / F.col("_w")).alias("loss"), F.exp(F.col("_s") / F.col("_w")).alias("ppl")
    )


def greedy_accuracy(df: DataFrame, ll: str, greedy: str) -> DataFrame:
    """Share of targets the model would have produced greedily, and the perplexity of the targets."""
    return df.agg(F.avg(truth(F.col(greedy))).alias("acc"), F.exp(-F.avg(ll)).alias("ppl"))


def exact_match(df: DataFrame, pred: str, gold: str) -> DataFrame:
    return df.agg(F.avg(truth(F.col(pred) == F.col(gold))).alias("acc"))


# ---- roll-ups and spread -----------------------------------------------------------------------------------


def accuracy_rollup(df: DataFrame, mapping: DataFrame, subject: str, right: str, sub: str, category: str) -> DataFrame:
    """Row-weighted accuracy per subject, sub-category, category and overall.

    Rows shrink to one per subject before the many-to-many map is joined. A row counts once per (sub-)category
    even when several map rows lead there.
    """
    per_subject = df.groupBy(subject).agg(F.sum(truth(F.col(right))).alias("_right"), F.count(F.lit(1)).alias("_n"))

    def level(name: str, value: Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("level"), value.cast("string").alias("name"), "_right", "_n")

    levels = level("subject", F.col(subject), per_subject).unionByName(level("overall", F.lit("all"), per_subject))
    for name, column in (("subcategory", sub), ("category", category)):
        mapped = per_subject.join(mapping.select(subject, column).distinct(), subject)
        levels = levels.unionByName(level(name, F.col(column), mapped))
    return levels.groupBy("level", "name").agg(
        (F.sum("_right") / F.sum("_n")).alias("acc"), F.sum("_n").alias("n")
    )


def mean_stderr(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, both deviations and the standard error of the mean."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("pop_stddev"), F.stddev_samp(value).alias("sample_stddev"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("stderr"),
    )


def bootstrap_stderr(
    df: DataFrame, values: Sequence[str], aggregate: Column, iters: int, seed: int | str
) -> DataFrame:
    """Standard error of any aggregate by resampling rows with replacement.

    Rows shrink to distinct value tuples with counts; draw d of replicate r is a hash of (r, d) and falls into
    the running count range of one tuple. Draws are generated on the executors and meet the ranges by an equi
    join on a coarse cell, so the table itself is never copied ``iters`` times. ``aggregate`` is an expression
    over ``values``.
    """
    spark = df.sparkSession
    tuples = df.groupBy(*values).agg(F.count(F.lit(1)).alias("_count"))
    total = df.count()
    ranges = _tuple_ranges(tuples, values)
    tasks = max(spark.sparkContext.defaultParallelism, iters * total // 50_000_000)
    draws = spark.range(0, iters * total, 1, tasks).select(
        div("id", total).alias("replicate"),
        (hash_wide(seed, div("id", total), F.col("id") % total) % total).alias("_draw"),
    )
    width = max(1, total // 4096)
    # each tuple is listed once per cell it touches: at most tuples + 4096 rows
    few = tuples.count() <= BROADCAST_TUPLES
    drawn = range_join(draws, ranges, "_draw", "_start", "_end", width, small_ranges=few)
    per_replicate = drawn.groupBy("replicate").agg(aggregate.alias("_m"))
    return per_replicate.agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("stderr"))


def _tuple_ranges(tuples: DataFrame, values: Sequence[str]) -> DataFrame:
    """Half-open running count range of every tuple, in hash order."""
    bucketed = tuples.withColumn("_h", hash_key("tuple", *values)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = bucketed.groupBy("_b").agg(F.sum("_count").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_b").orderBy("_h", *values).rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.join(F.broadcast(offsets), "_b").withColumn(  # at most 4096 rows
        "_start", F.col("_off") + F.coalesce(F.sum("_count").over(local), F.lit(0))
    )
    return placed.withColumn("_end", F.col("_start") + F.col("_count")).drop("_h", "_b", "_off", "_count")


def median(df: DataFrame, value: str) -> DataFrame:
    """Exact median from running counts of the distinct values (no task holds the whole column)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    running = range_running_sums(counts, ["n"], value)
    total = counts.agg(F.sum("n").alias("_total"))
    placed = running.crossJoin(F.broadcast(total))
    low = F.min(F.when(F.col("n_run") >= F.floor((F.col("_total") + 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("n_run") >= F.floor(F.col("_total") / 2) + 1, F.col(value)))
    return placed.agg(((low + high) / 2).alias("median"))


# ---- ranking and several golds -------------------------------------------------------------------------------


def rank_metrics(df: DataFrame, doc: str, idx: str, score: str, label: str) -> DataFrame:
    """Recall at 1 and 2 and mean reciprocal rank of the gold candidate (ties rank with the best)."""
    gold = F.max(F.when(F.col(idx) == F.col(label), F.col(score)))
    marked = with_group_stats(df, [doc], _gold=gold)
    per_doc = marked.groupBy(doc).agg(
        F.sum((F.col(score) > F.col("_gold")).cast("int")).alias("_above"),
        F.max_by(idx, F.struct(F.col(score), -F.col(idx))).alias("_best"), F.min(label).alias("_label"),
    )
    first = truth(F.col("_best") == F.col("_label"))
    second = truth(F.col("_above") == 1)
    return per_doc.agg(
        F.avg(first).alias("recall_1"), F.avg(second + first).alias("recall_2"),
        F.avg(1.0 / (F.col("_above") + 1)).alias("mrr"),
    )


def mc1_mc2(df: DataFrame, doc: str, idx: str, ll: str, is_true: str) -> DataFrame:
    """Best candidate is the first one; probability mass on the true candidates."""
    scaled = with_group_stats(df, [doc], _top=F.max(ll)).withColumn("_p", F.exp(F.col(ll) - F.col("_top")))
    per_doc = scaled.groupBy(doc).agg(
        truth(F.max_by(idx, F.struct(F.col(ll), -F.col(idx))) == 0).alias("mc1"),
        (F.sum(F.when(F.col(is_true), F.col("_p")).otherwise(0.0)) / F.sum("_p")).alias("mc2"),
    )
    return per_doc.agg(F.avg("mc1").alias("mc1"), F.avg("mc2").alias("mc2"))


def _gold_scores(df: DataFrame, doc: str, pred: str, gold: str, *keep: str) -> DataFrame:
    return df.select(
        doc, *keep, ans.token_exact(pred, gold).alias("em"), ans.token_f1(pred, gold).alias("f1")
    )


def max_over_golds(df: DataFrame, doc: str, pred: str, gold: str) -> DataFrame:
    """Per document the best exact match and token F1 over its gold answers, averaged."""
    best = _gold_scores(df, doc, pred, gold).groupBy(doc).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    return best.agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"))


def leave_one_out(df: DataFrame, doc: str, idx: str, pred: str, gold: str) -> DataFrame:
    """Each gold answer left out in turn, best score over the rest, averaged per document and overall.

    Leaving one out changes the best score only for the best gold itself, so the two best scores suffice:
    ``((n - 1) * best + second) / n``.
    """
    scores = _gold_scores(df, doc, pred, gold, idx)
    long = scores.select(doc, idx, F.explode(F.create_map(F.lit("em"), "em", F.lit("f1"), "f1")).alias("metric", "score"))
    top = Window.partitionBy(doc, "metric").orderBy(F.desc("score"), idx)
    two = long.withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= 2)
    best = two.groupBy(doc, "metric").agg(F.max("score").alias("best"), F.min("score").alias("second"))
    n = scores.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    value = ((F.col("n") - 1) * F.col("best") + F.col("second")) / F.col("n")
    per_doc = best.join(n, doc).select("metric", value.alias("score"))
    return per_doc.groupBy("metric").agg(F.avg("score").alias("score"))


def prune_prefixes(df: DataFrame, doc: str, alias: str) -> DataFrame:
    """Distinct aliases without those that start with another alias of the same document.

    In sorted order everything between an alias and one that starts with it starts with it too, so each is compared with
    the last one kept and nothing else. Aliases are dealt by document and first letter and stream past in order. An
    empty alias removes none; rows without a document or alias stay.
    """
    aliases = df.select(doc, alias).distinct()
    rows = aliases.toDF("doc", "alias")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, root = None, ""
        for batch in batches:
            keep = []
            for own, text in zip(batch.column("doc").to_pylist(), batch.column("alias").to_pylist()):
                follows = own is not None and own == last and bool(root) and text is not None and text.startswith(root)
                if not follows:
                    last, root = own, text or ""
                keep.append(not follows)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = rows.repartition("doc", F.substring("alias", 1, 1)).sortWithinPartitions("doc", "alias")
    return dealt.mapInArrow(run, rows.schema).toDF(doc, alias)


def any_alias(df: DataFrame, doc: str, alias: str, hit: str) -> DataFrame:
    """Share of documents with a hit on any alias that survives prefix pruning."""
    hits = df.groupBy(doc, alias).agg(F.max(truth(F.col(hit))).alias("_hit"))
    kept = prune_prefixes(df, doc, alias).join(hits, [doc, alias])
    return kept.groupBy(doc).agg(F.max("_hit").alias("_any")).agg(F.avg("_any").alias("acc"))


def pair_accuracy(df: DataFrame, good: str, bad: str) -> DataFrame:
    return df.agg(F.avg(truth(F.col(good) > F.col(bad))).alias("acc"))


# ---- question answering report -----------------------------------------------------------------------------------


def qa_report(df: DataFrame, pred: str, gold: str, no_answer: str) -> DataFrame:
    """Exact match and F1 in percent: overall, with and without an answer, and at the best threshold.

    A missing gold answer means the question has none; ``no_answer`` is the predicted probability of that.
    Rows with the same probability fall on the same side of a threshold.
    """
    has = F.col(gold).isNotNull()
    target = F.coalesce(F.col(gold), F.lit(""))
    scored = df.select(
        truth(has).alias("has"), ans.token_exact(pred, target).alias("exact"), ans.token_f1(pred, target).alias("f1"),
        truth(F.col(pred) != "").alias("answered"), F.col(no_answer).alias("na"),
    )
    answered = F.col("has") == 1
    summary = scored.agg(
        *[(100 * F.avg(m)).alias(m) for m in ("exact", "f1")],
        *[(100 * F.avg(F.when(answered, F.col(m)))).alias(f"has_{m}") for m in ("exact", "f1")],
        *[(100 * F.avg(F.when(~answered, F.col(m)))).alias(f"no_{m}") for m in ("exact", "f1")],
        F.sum(1 - F.col("has")).alias("_start"), F.count(F.lit(1)).alias("_n"),
    )

    def gain(m: str) -> Column:
        return F.sum(F.when(answered, F.col(m)).otherwise(-F.col("answered"))).alias(f"g_{m}")

    by_score = scored.groupBy("na").agg(gain("exact"), gain("f1"))
    running = range_running_sums(by_score, ["g_exact", "g_f1"], "na")
    peaks = running.agg(*[F.greatest(F.max(f"g_{m}_run"), F.lit(0.0)).alias(f"_p_{m}") for m in ("exact", "f1")])
    both = summary.crossJoin(F.broadcast(peaks))
    return both.select(
        "exact", "f1", "has_exact", "has_f1", "no_exact", "no_f1",
        *[(100 * (F.col("_start") + F.col(f"_p_{m}")) / F.col("_n")).alias(f"best_{m}") for m in ("exact", "f1")],
    )


# ---- rewards, preferences, runs ------------------------------------------------------------------------------------


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow; ``softplus(-x)`` is the negative log-sigmoid of x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def reward_report(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Mean, sample deviation, pair accuracy, mean loss and a 10-bin histogram on [-10, 10] of all rewards."""
    both = df.select(F.explode(F.array(chosen, rejected)).alias("reward"))
    inside = F.col("reward").between(-10.0, 10.0)
    # the upper edge belongs to the last bin
    slot = F.least(F.floor((F.col("reward") + 10) / 2), F.lit(9))
    bins = [F.sum(F.when(inside & (slot == i), 1).otherwise(0)) for i in range(10)]
    stats = both.agg(
        F.avg("reward").alias("reward_mean"), F.stddev_samp("reward").alias("reward_std"),
        F.sum(F.when(inside, 1).otherwise(0)).alias("_in"), F.array(*bins).alias("_bins"),
    ).withColumn("histogram", F.transform("_bins", lambda b: b / F.col("_in"))).drop("_in", "_bins")
    margin = F.col(chosen) - F.col(rejected)
    pairs = df.agg(F.avg(truth(margin > 0)).alias("acc"), F.avg(softplus(-margin)).alias("loss"))
    return stats.crossJoin(F.broadcast(pairs))


def pair_loss(df: DataFrame, chosen: str, rejected: str, margin: str | None = None) -> DataFrame:
    """Mean pairwise loss (with optional margin) and its log-exp form."""
    diff = F.col(chosen) - F.col(rejected)
    shifted = diff - F.col(margin) if margin else diff
    return df.agg(F.avg(softplus(-shifted)).alias("loss"), F.avg(softplus(-diff)).alias("log_exp_loss"))


def preference_report(
    df: DataFrame, beta: float, smoothing: float = 0.0, squared: bool = False,
    pi_chosen: str = "pi_chosen", pi_rejected: str = "pi_rejected", ref_chosen: str = "ref_chosen",
    ref_rejected: str = "ref_rejected",
) -> DataFrame:
    """Loss, accuracy and implied rewards of a preference-optimised policy against its reference."""
    chosen, rejected = F.col(pi_chosen) - F.col(ref_chosen), F.col(pi_rejected) - F.col(ref_rejected)
    logits = chosen - rejected
    if squared:
        loss = F.pow(logits - 1.0 / (2.0 * beta), F.lit(2.0))
    else:
        loss = softplus(-beta * logits) * (1.0 - smoothing) + softplus(beta * logits) * smoothing
    return df.agg(
        F.avg(loss).alias("loss"), F.avg(truth(beta * chosen > beta * rejected)).alias("acc"),
        F.avg(beta * chosen).alias("chosen_reward"), F.avg(beta * rejected).alias("rejected_reward"),
    )


def unpaired_report(
    df: DataFrame, beta: float, desirable: float = 1.0, undesirable: float = 1.0,
    pi: str = "pi", ref: str = "ref", kl: str = "kl", label: str = "label",
) -> DataFrame:
    """Loss of unpaired feedback: ``label`` 1 wanted, 0 unwanted, -1 mismatched rows that estimate the KL baseline.

    ``kl`` is the log-ratio used for the baseline on mismatched rows; the baseline is at least 0.
    """
    baseline = df.agg(F.greatest(F.avg(F.when(F.col(label) == -1, F.col(kl))), F.lit(0.0)).alias("_kl"))
    rows = df.filter(F.col(label) >= 0).crossJoin(F.broadcast(baseline))
    ratio_ = F.col(pi) - F.col(ref)
    wanted = F.col(label) == 1
    loss = F.when(wanted, desirable * (1 - sigmoid(beta * (ratio_ - F.col("_kl"))))).otherwise(
        undesirable * (1 - sigmoid(beta * (F.col("_kl") - ratio_)))
    )
    return rows.agg(
        F.avg(loss).alias("loss"), F.avg(F.when(wanted, beta * ratio_)).alias("chosen_reward"),
        F.avg(F.when(~wanted, beta * ratio_)).alias("rejected_reward"), F.max("_kl").alias("kl"),
    )


def even_unpaired_report(df: DataFrame, beta: float, pi: str = "pi", ref: str = "ref", label: str = "label") -> DataFrame:
    """The even-sampling form: each side's baseline is the clamped mean log-ratio of the other side."""
    ratio_ = F.col(pi) - F.col(ref)
    wanted = F.col(label) == 1
    kls = df.agg(
        F.greatest(F.avg(F.when(wanted, ratio_)), F.lit(0.0)).alias("_kc"),
        F.greatest(F.avg(F.when(~wanted, ratio_)), F.lit(0.0)).alias("_kr"),
    )
    loss = F.when(wanted, 1 - sigmoid(beta * (ratio_ - F.col("_kr")))).otherwise(
        1 - sigmoid(beta * (F.col("_kc") - ratio_))
    )
    return df.crossJoin(F.broadcast(kls)).agg(F.avg(loss).alias("loss"))


def step_accuracy(
    df: DataFrame, keys: Sequence[str], candidate: str, score: str, label: str, placeholder: str
) -> DataFrame:
    """Share of placeholder steps whose best-scored candidate is the label (lowest candidate wins ties)."""
    steps = df.filter(F.col(placeholder)).groupBy(*keys).agg(
        F.max_by(candidate, F.struct(F.col(score), -F.col(candidate))).alias("_best"), F.min(label).alias("_label")
    )
    return steps.agg(F.avg(truth(F.col("_best") == F.col("_label"))).alias("acc"), F.count(F.lit(1)).alias("n_steps"))


def eval_acc_by_step(df: DataFrame, step: str, reward: str) -> DataFrame:
    return df.groupBy(step).agg(F.avg(reward).alias("eval_acc"))


def throughput_report(
    df: DataFrame, text: str, seconds: str, batch: str, run: Sequence[str] = ()
) -> DataFrame:
    """Instances, words and tokens per second, and latency per batch, per run."""
    sums = df.groupBy(*run, batch).agg(
        F.count(F.lit(1)).alias("_i"), F.sum(tx.word_count(text)).alias("_w"), F.sum(F.size(tx.words(text))).alias("_t"),
        F.max(seconds).alias("_s"),
    ).groupBy(*run).agg(
        F.sum("_i").alias("n_instances"), F.sum("_w").alias("n_words"), F.sum("_t").alias("n_tokens"),
        F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_batches"),
    )
    per = lambda c: (F.col(c) / F.col("_s"))
    return sums.select(
        *run, "n_instances", "n_words", "n_tokens", per("n_instances").alias("instances_per_second"),
        per("n_words").alias("words_per_second"), per("n_tokens").alias("tokens_per_second"),
        (F.col("_s") / F.col("_batches") * 1000).alias("latency_ms"),
    )


def judge_counts(df: DataFrame, labels: str, doc: str) -> DataFrame:
    """Rows and distinct documents per error category (a reply may name several)."""
    named = df.select(doc, F.explode(F.array_distinct(F.col(labels))).alias("category")).filter(F.col("category") != "")
    per_doc = named.groupBy("category", doc).agg(F.count(F.lit(1)).alias("_n"))
    return per_doc.groupBy("category").agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_docs"))


def dedup_pairs(df: DataFrame, prompt: str, response: str) -> DataFrame:
    return df.select(prompt, response).distinct()


def longest_prefix(df: DataFrame, path: str, prefixes: Sequence[str], out: str = "source") -> DataFrame:
    """The longest of the given prefixes that a path starts with."""
    c, result = F.col(path), F.lit(None).cast("string")
    for prefix in sorted(prefixes, key=len):
        result = F.when(F.startswith(c, F.lit(prefix)), F.lit(prefix)).otherwise(result)
    return df.withColumn(out, result)


def source_report(df: DataFrame, source: str, tokens: str, taken: str) -> DataFrame:
    """Per source all tokens, taken tokens and the share of all taken tokens as text with 4 digits."""
    per = df.groupBy(source).agg(
        F.sum(tokens).alias("total_tokens"), F.sum(F.when(F.col(taken), F.col(tokens)).otherwise(0)).alias("taken_tokens")
    )
    return attach_totals(per, _all=F.sum("taken_tokens")).select(
        source, "total_tokens", "taken_tokens",
        F.format_string("%.4f", F.col("taken_tokens") / F.col("_all")).alias("share"),
    )


def score(df: DataFrame, reward_fn, query: str, prompt: str, label: str, out: str = "reward") -> DataFrame:
    """Reward column from a column function ``fn(query, prompt, label)`` (a pandas UDF works as well)."""
    return df.withColumn(out, reward_fn(F.col(query), F.col(prompt), F.col(label)))


METRICS: Mapping[str, object] = {
    "acc": lambda df: mc_accuracy(df, "acc"),
    "len_norm": lambda df: mc_accuracy(df, "len_norm"),
    "pmi_dc": lambda df: mc_accuracy(df, "pmi_dc"),
    "ce_loss": lambda df: gold_loss(df).select(F.col("ce_loss").alias("loss")),
    "bpb": lambda df: gold_loss(df).select(F.col("bpb").alias("loss")),
    "f1": lambda df: f1_binary(mc_predictions(df, "f1"), "label", "pred", 0),
}


def named_metric(name: str):
    """Metric by name; an unknown name is an error."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}")
    return METRICS[name]

