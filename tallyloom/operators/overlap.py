"""Text overlap scores: corpus BLEU and chrF, ROUGE, longest common subsequence."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text as tx
from ..plans.layout import spread
from .bootstrap import stderr_of_sums

# the functions below travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The tokenisation rules of the international BLEU scoring script (mteval v13a).
BLEU_RULES = [
    ("=", "<skipped>", ""),
    ("=", "-\n", ""),
    ("=", "\n", " "),
    ("=", "&quot;", '"'),
    ("=", "&amp;", "&"),
    ("=", "&lt;", "<"),
    ("=", "&gt;", ">"),
]
BLEU_SPACING = [
    ("~", r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
    ("~", r"([^0-9])([\.,])", "$1 $2 "),
    ("~", r"([\.,])([^0-9])", " $1 $2"),
    ("~", r"([0-9])(-)", "$1 $2 "),
]


def bleu_tokens(c: Column | str) -> Column:
    padded = F.concat(F.lit(" "), tx.apply_rules(c, BLEU_RULES), F.lit(" "))
    return tx.words(tx.apply_rules(padded, BLEU_SPACING))


def rouge_tokens(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def char_tokens(c: Column | str) -> Column:
    """The text without white space: its characters are the tokens."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"\s+", "")


def _token_codes(sides: Sequence[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side: a number per token (equal tokens, equal numbers) and where each row's tokens begin.

    A side is an array of token lists, or of texts whose characters are the tokens. Null has no tokens.
    """
    if pa.types.is_list(sides[0].type) or pa.types.is_large_list(sides[0].type):
        flat = pa.chunked_array([s.flatten() for s in sides]).combine_chunks().dictionary_encode()
        codes = np.asarray(flat.indices.fill_null(-1)).astype(np.int64) + 1
        sizes = [np.asarray(pc.list_value_length(s).fill_null(0)).astype(np.int64) for s in sides]
    else:
        texts = [s.fill_null("").to_pylist() for s in sides]
        codes = np.frombuffer("".join(t for side in texts for t in side).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = [np.array([len(t) for t in side], np.int64) for side in texts]
    out, at = [], 0
    for size in sizes:
        ends = np.concatenate([[0], np.cumsum(size)])
        out.append((codes[at : at + ends[-1]], ends))
        at += ends[-1]
    return out


def _gram_matches(hyp: pa.Array, ref: pa.Array, max_order: int) -> np.ndarray:
    """Per row and order: n-grams of the first side, of the second, and clipped matches."""
    sides = _token_codes([hyp, ref])
    rows = len(hyp)
    out = np.zeros((rows, 3 * max_order), np.int64)
    owner = [np.repeat(np.arange(rows), np.diff(at)) for _, at in sides]
    start = [np.arange(len(codes)) for codes, _ in sides]
    grams = [codes for codes, _ in sides]
    for n in range(1, max_order + 1):
        if n > 1:  # a gram of the order before and one token more
            for k, (codes, at) in enumerate(sides):
                fits = start[k] + n <= at[owner[k] + 1]
                start[k], owner[k], grams[k] = start[k][fits], owner[k][fits], grams[k][fits]
            last = [codes[start[k] + n - 1] for k, (codes, _) in enumerate(sides)]
            width = 1 + max((int(x.max(initial=0)) for x in last), default=0)
            grams = [g * width + x for g, x in zip(grams, last)]
        _, number = np.unique(np.concatenate(grams), return_inverse=True)  # small numbers again, equal for equal grams
        grams = [number[: len(grams[0])], number[len(grams[0]) :]]
        size = len(number) + 1
        (seen_h, count_h), (seen_r, count_r) = (np.unique(owner[k] * size + grams[k], return_counts=True) for k in (0, 1))
        both, at_h, at_r = np.intersect1d(seen_h, seen_r, assume_unique=True, return_indices=True)
        for k, (seen, count) in enumerate(((seen_h, count_h), (seen_r, count_r), (both, np.minimum(count_h[at_h], count_r[at_r])))):
            out[:, 3 * (n - 1) + k] = np.bincount(seen // size, weights=count, minlength=rows)
    return out


def clipped_matches(hyp: Column, ref: Column, max_order: int) -> Column:
    """``array<bigint>``: for each order from 1 the n-grams of ``hyp``, of ``ref``, and the clipped matches.

    Counted inside the row, so no n-gram leaves its task. Works on some thousand rows at a time.
    """

    def counts(h: pa.Array, r: pa.Array) -> pa.Array:
        parts = [_gram_matches(h[i : i + 512], r[i : i + 512], max_order) for i in range(0, len(h), 512)]
        table = np.concatenate(parts) if parts else np.zeros((0, 3 * max_order), np.int64)
        return pa.array(list(table), pa.list_(pa.int64()))

    return F.arrow_udf(counts, "array<bigint>")(hyp, ref)


def _order_sums(df: DataFrame, matches: Column, max_order: int) -> DataFrame:
    """One row with the sums of every order (``h1, r1, m1, h2, ...``)."""
    names = [f"{name}{n}" for n in range(1, max_order + 1) for name in "hrm"]
    return spread(df).select(matches.alias("_m")).agg(
        *[F.coalesce(F.sum(F.get("_m", F.lit(i))), F.lit(0)).cast("double").alias(name) for i, name in enumerate(names)]
    )


def _order_rows(df: DataFrame, matches: Column, max_order: int) -> DataFrame:
    """The counts of every order (``h1, r1, m1, h2, ...``), row by row."""
    rows = spread(df).select(matches.alias("_m"))
    return rows.select(*[F.get("_m", F.lit(i)).alias(name) for i, name in enumerate(f"{c}{n}" for n in range(1, max_order + 1) for c in "hrm")])


def _bleu(max_order: int) -> Column:
    """BLEU in percent from the sums of every order."""
    smooth, log_sum = F.lit(1.0), F.lit(0.0)
    for n in range(1, max_order + 1):
        empty = F.col(f"m{n}") == 0
        smooth = F.when(empty, smooth * 2).otherwise(smooth)
        precision = F.when(empty, 1 / (smooth * F.col(f"h{n}"))).otherwise(F.col(f"m{n}") / F.col(f"h{n}"))
        log_sum = log_sum + F.log(precision)
    penalty = F.when(F.col("h1") < F.col("r1"), F.exp(1 - F.col("r1") / F.col("h1"))).otherwise(F.lit(1.0))
    return F.when((F.col("m1") == 0) | (F.col(f"h{max_order}") == 0), F.lit(0.0)).otherwise(
        100 * penalty * F.exp(log_sum / max_order)
    )


def _chrf(max_order: int, beta: float) -> Column:
    """chrF in percent from the sums of every order."""
    orders = range(1, max_order + 1)
    usable = [(F.col(f"h{n}") > 0) & (F.col(f"r{n}") > 0) for n in orders]
    count = sum((u.cast("int") for u in usable), F.lit(0))
    mean = lambda side: sum(
        (F.when(u, F.col(f"m{n}") / F.col(f"{side}{n}")).otherwise(F.lit(0.0)) for u, n in zip(usable, orders)), F.lit(0.0)
    ) / count
    p, r, factor = mean("h"), mean("r"), beta * beta
    return F.when(p + r > 0, 100 * (1 + factor) * p * r / (factor * p + r)).otherwise(F.lit(0.0))


def corpus_bleu(df: DataFrame, hyp: str, ref: str, max_order: int = 4) -> DataFrame:
    """Corpus BLEU in percent: clipped precisions up to ``max_order``, brevity penalty, exponential smoothing."""
    sums = _order_sums(df, clipped_matches(bleu_tokens(hyp), bleu_tokens(ref), max_order), max_order)
    return sums.select(_bleu(max_order).alias("bleu"), F.col("h1").cast("bigint").alias("sys_len"), F.col("r1").cast("bigint").alias("ref_len"))


def corpus_chrf(df: DataFrame, hyp: str, ref: str, max_order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF in percent from mean character n-gram precision and recall."""
    sums = _order_sums(df, clipped_matches(char_tokens(hyp), char_tokens(ref), max_order), max_order)
    return sums.select(_chrf(max_order, beta).alias("chrf"))


def bleu_stderr(df: DataFrame, hyp: str, ref: str, iters: int, seed: int | str, max_order: int = 4) -> DataFrame:
    """Mean and standard error of corpus BLEU over resampled rows: texts are counted once, their counts are resampled."""
    rows = _order_rows(df, clipped_matches(bleu_tokens(hyp), bleu_tokens(ref), max_order), max_order)
    return stderr_of_sums(rows, rows.columns, _bleu(max_order), iters, seed)


def chrf_stderr(df: DataFrame, hyp: str, ref: str, iters: int, seed: int | str, max_order: int = 6, beta: float = 2.0) -> DataFrame:
    """Mean and standard error of corpus chrF over resampled rows."""
    rows = _order_rows(df, clipped_matches(char_tokens(hyp), char_tokens(ref), max_order), max_order)
    return stderr_of_sums(rows, rows.columns, _chrf(max_order, beta), iters, seed)


LCS_BLOCK = 1 << 14


def _lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence by bit rows: a bit is one place of the longer side, so a token costs a few operations
    on whole numbers of up to ``LCS_BLOCK`` bits. Longer texts go block by block; the carries of each token are kept."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    carry, found = bytearray(len(short)), 0
    for at in range(0, len(long), LCS_BLOCK):
        part = long[at : at + LCS_BLOCK]
        size = len(part)
        full, places = (1 << size) - 1, {}
        for i, token in enumerate(part):
            places[token] = places.get(token, 0) | 1 << i
        row = full
        for j, token in enumerate(short):
            here = row & places.get(token, 0)
            if here or carry[j]:
                total = row + here + carry[j]
                carry[j] = total >> size
                row = (total | (row - here)) & full
        found += size - row.bit_count()
    return found


@F.pandas_udf(IntegerType())
def lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence of two token arrays (null has no tokens)."""
    for left, right in batches:
        yield pd.Series([0 if a is None or b is None else _lcs_length(list(a), list(b)) for a, b in zip(left, right)], dtype="int32")


def _f_measure(match: Column, n_hyp: Column, n_ref: Column) -> Column:
    return F.when(match > 0, 2.0 * match / (n_hyp + n_ref)).otherwise(F.lit(0.0))


def rouge_n(df: DataFrame, keys: Sequence[str], pred: str, ref: str, max_order: int = 2) -> DataFrame:
    """ROUGE-n F per row in percent, one column per order."""
    rows = spread(df).select(*keys, clipped_matches(rouge_tokens(pred), rouge_tokens(ref), max_order).alias("_m"))

    def f(n: int) -> Column:
        n_hyp, n_ref, match = (F.get("_m", F.lit(3 * (n - 1) + k)) for k in range(3))
        return 100 * _f_measure(match, n_hyp, n_ref)

    return rows.select(*keys, *[f(n).alias(f"rouge{n}") for n in range(1, max_order + 1)])


def rouge_l(df: DataFrame, pred: str, ref: str, out: str = "rougeL") -> DataFrame:
    """ROUGE-L F per row in percent."""
    rows = df.withColumn("_p", rouge_tokens(pred)).withColumn("_r", rouge_tokens(ref))
    return rows.withColumn(out, 100 * _f_measure(lcs_length("_p", "_r"), F.size("_p"), F.size("_r"))).drop("_p", "_r")


def rouge(df: DataFrame, keys: Sequence[str], pred: str, ref: str) -> DataFrame:
    """ROUGE-1, ROUGE-2 and ROUGE-L F per row in percent."""
    return rouge_n(df, keys, pred, ref).join(rouge_l(df.select(*keys, pred, ref), pred, ref).drop(pred, ref), list(keys))


def ref_contrast(scored: DataFrame, doc: str, is_true: str, metrics: Sequence[str]) -> DataFrame:
    """Best score over the true references, its lead over the best false one, and whether it wins."""
    sides = scored.groupBy(doc).agg(
        *[F.max(F.when(F.col(is_true), F.col(m))).alias(f"_{m}_t") for m in metrics],
        *[F.max(F.when(~F.col(is_true), F.col(m))).alias(f"_{m}_f") for m in metrics],
    )
    lead = {m: F.col(f"_{m}_t") - F.col(f"_{m}_f") for m in metrics}
    return sides.select(
        doc, *[F.col(f"_{m}_t").alias(f"{m}_max") for m in metrics], *[lead[m].alias(f"{m}_diff") for m in metrics],
        *[(lead[m] > 0).cast("int").alias(f"{m}_acc") for m in metrics],
    )
