"""Document quality from a linear-chain conditional random field over lines.

Every line gets a handful of measures (shares of letters, symbols, repeated words and the like), each cut into bins
whose borders come from the training sample. A line's evidence for "good" is the sum of one weight per measure and bin
for the line itself, the line before and the line after. Transition weights tie neighbouring lines. The weights
maximise the conditional likelihood of line labels, for which a line takes the label of its document. A document's
quality is the mean of its lines' forward-backward marginals, weighted by length, put on a calibrated scale.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, col, rows_where, slices, text_of

MEASURES = ("chars", "letters", "upper", "digits", "blanks", "stops", "shouts", "symbols", "word_length", "repeated", "distinct", "marked", "words")
BINS = 8
#: Bytes of text measured at a time. Some twenty arrays of eight bytes for each character live at once.
PART_BYTES = 1 << 18
LETTER, UPPER, DIGIT, BLANK, STOP, SHOUT, SYMBOL = (1 << i for i in range(7))
_kinds: np.ndarray | None = None


def char_kinds() -> np.ndarray:
    """Bit set of each code point."""
    global _kinds
    if _kinds is None:
        _kinds = np.full(0x110000, LETTER, np.uint8)
        for i in range(0x3000):
            c = chr(i)
            kind = unicodedata.category(c)[0]
            if c.isspace():
                _kinds[i] = BLANK
            elif c.isdigit():
                _kinds[i] = DIGIT
            elif c in ".,;:?'\"-()":
                _kinds[i] = STOP
            elif c == "!":
                _kinds[i] = SHOUT
            elif kind not in "LM":
                _kinds[i] = SYMBOL
            elif c.isupper():
                _kinds[i] = LETTER | UPPER
    return _kinds


def line_spans(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and how many lines each text has (at least one)."""
    breaks = np.flatnonzero(points == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, at[1:]]), kind="stable")
    return starts, ends, np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1


def line_measures(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines (one row each), their lengths, and the number of lines of each text."""
    starts, ends, lines = line_spans(points, at)
    kinds = char_kinds()[points]
    size = (ends - starts).astype(float)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(float)

    some = np.maximum(size, 1)
    letters, upper = count((kinds & LETTER) > 0), count((kinds & UPPER) > 0)
    solid = (kinds & BLANK) == 0
    edge = np.zeros(len(points) + 1, bool)
    edge[starts], edge[ends] = True, True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    first = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    last = np.flatnonzero(solid & ~after)
    line = np.searchsorted(starts, first, side="right") - 1
    # a word's hash: sum of its characters times powers of an odd number, whatever its place
    step = np.uint64(0x9E3779B97F4A7C15)
    powers = np.full(int((last - first).max(initial=0)) + 1, step, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    folded = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    place = np.arange(len(points))
    begun = np.zeros(len(points), np.int64)
    begun[first] = first
    inside = np.where(solid, place - np.maximum.accumulate(begun), 0)
    terms = np.where(solid, folded * powers[inside], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    word = total[last + 1] - total[first]
    words = np.bincount(line, minlength=len(starts)).astype(float)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((word, line))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], weights=new, minlength=len(starts))
    marked = np.bincount(line, weights=(kinds[last] & (SYMBOL | SHOUT)) > 0, minlength=len(starts))
    each = np.maximum(words, 1)
    values = [
        np.log1p(size), letters / some, upper / np.maximum(letters, 1), count((kinds & DIGIT) > 0) / some, count(~solid) / some, count((kinds & STOP) > 0) / some,
        count((kinds & SHOUT) > 0) / some, count((kinds & SYMBOL) > 0) / some, count(solid) / each, np.bincount(line, weights=again, minlength=len(starts)) / each,
        (distinct + 1) / (words + 1), marked / each, np.log1p(words),
    ]
    return np.stack(values, axis=1), size, lines


def marginals(evidence: np.ndarray, ties: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and P(line, next line) as rows of four (bad-bad, bad-good, good-bad, good-good).

    ``evidence``: log odds of good for each line, text after text; ``ties``: 2 x 2 transition weights. The rows of the
    last line of a text are 0. Works on line t of all texts at once.
    """
    begin = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    begin, count = begin[order], lines[order]
    longest = int(count.max(initial=0))
    live = np.searchsorted(-count, -np.arange(1, longest + 1), side="right")
    scale = np.abs(evidence) / 2
    local = np.exp(np.stack([-evidence / 2, evidence / 2], axis=1) - scale[:, None])
    link = np.exp(ties - ties.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    for t, n in enumerate(live.tolist()):
        at = begin[:n] + t
        value = local[at] if t == 0 else (ahead[at - 1] @ link) * local[at]
        ahead[at] = value / value.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        value = (back[at + 1] * local[at + 1]) @ link.T
        back[at] = value / value.sum(axis=1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    pairs = np.zeros((len(evidence), 4))
    inner = np.ones(len(evidence), bool)
    inner[np.cumsum(lines) - 1] = False
    at = np.flatnonzero(inner)
    joint = ahead[at][:, :, None] * link[None] * (local[at + 1] * back[at + 1])[:, None, :]
    pairs[at] = joint.reshape(-1, 4) / joint.sum(axis=(1, 2))[:, None]
    return good, pairs


@dataclass
class Model:
    """Bin borders, weights (line, line before, line after), transition weights and the calibration."""

    borders: np.ndarray
    weights: np.ndarray
    bias: float
    ties: np.ndarray
    slope: float
    shift: float
    prior: float | None = None  # the answer for every text if the labels cannot teach a model

    def bins(self, measures: np.ndarray) -> np.ndarray:
        """Index of each line's weights: its own, then those of its neighbours."""
        out = np.stack([np.searchsorted(b, measures[:, i], side="right") + i * BINS for i, b in enumerate(self.borders)], axis=1)
        return out.astype(np.int64)

    def neighbours(self, bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Rows of all weights that count for a line; there is a bin of its own for "no line there"."""
        none = len(MEASURES) * BINS
        before, after = np.full_like(bins, none), np.full_like(bins, none)
        before[1:], after[:-1] = bins[:-1], bins[1:]
        final = np.cumsum(lines) - 1
        after[final] = none
        before[final - lines + 1] = none
        return np.concatenate([bins, before + none + 1, after + 2 * (none + 1)], axis=1)

    def line_marginals(self, measures: np.ndarray, lines: np.ndarray) -> np.ndarray:
        places = self.neighbours(self.bins(measures), lines)
        return marginals(self.weights[places].sum(axis=1) + self.bias, self.ties, lines)[0]

    def score(self, measures: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(lines), self.prior)
        raw = document_odds(self.line_marginals(measures, lines), size, lines)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def document_odds(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean marginal of each text."""
    first = np.cumsum(lines) - lines
    weight = size + 1
    mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first) if len(lines) else np.zeros(0)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def fit(measures: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = 160, rate: float = 0.08, decay: float = 0.5) -> Model:
    """Maximum conditional likelihood with an L2 penalty; deterministic."""
    if len(label) == 0 or label.min() == label.max():
        return Model(np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros((2, 2)), 1.0, 0.0, prior=float(label[0]) if len(label) else 1.0)
    quantiles = np.quantile(measures, np.arange(1, BINS) / BINS, axis=0).T
    bad = measures[np.repeat(label, lines) == 0]
    extra = np.quantile(bad, np.arange(1, BINS) / BINS, axis=0).T
    borders = np.sort(np.concatenate([quantiles[:, 1::2], extra[:, ::2]], axis=1), axis=1)  # both kinds of lines get borders
    width = 3 * (len(MEASURES) * BINS + 1)
    model = Model(borders, np.zeros(width), 0.0, np.zeros((2, 2)), 1.0, 0.0)
    places = model.neighbours(model.bins(measures), lines)
    truth = np.repeat(label, lines).astype(float)
    inner = np.ones(len(truth), bool)
    inner[np.cumsum(lines) - 1] = False
    pairs = np.bincount((truth[inner] * 3).astype(int), minlength=4).astype(float)
    value = np.zeros(width + 1 + 4)
    mean, spread = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, rounds + 1):
        model.weights, model.bias, model.ties = value[:width], float(value[width]), value[width + 1 :].reshape(2, 2)
        good, joint = marginals(model.weights[places].sum(axis=1) + model.bias, model.ties, lines)
        miss = truth - good
        slope = np.concatenate([np.bincount(places.ravel(), weights=np.repeat(miss, places.shape[1]), minlength=width), [miss.sum()], pairs - joint.sum(axis=0)])
        slope = (slope - decay * value) / len(label)
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        value = value + rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    raw = document_odds(model.line_marginals(measures, lines), size, lines)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the calibration, with a weak pull to the identity
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((label - p) * raw).sum() - (a - 1), (label - p).sum() - b])
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        move = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(move[0], -0.5, 0.5)), b + float(np.clip(move[1], -0.5, 0.5))
    model.slope, model.shift = a, b
    return model


def bucket(key: Column) -> Column:
    """The fold of a row; fold 2 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = 4000, most_lines: int = 200) -> Model:
    """Fit the model on a bounded sample of labelled documents outside the held-out fold.

    The sample has, of each of ``most_docs`` hash classes, the labelled id with the smallest hash, and of its text
    a run of ``most_lines`` neighbouring lines (all, if fewer) that begins where a hash of the id says, so ends and middles of
    long texts teach as much as their beginnings.
    An id with several labels takes the smallest; an id with several texts one of them. Null ids, null labels and
    labels without a document teach nothing. No usable label: every text scores 1; one class only: its label.
    """
    key, label = col(labels, id_col), col(labels, label_col)
    known = labels.where(label.isNotNull() & key.isNotNull() & (bucket(key) != 2)).groupBy(key.alias("id")).agg(F.min(label).alias("label"))
    spot = F.xxhash64("id")
    chosen = known.groupBy(F.pmod(spot, F.lit(most_docs)).alias("class")).agg(F.min(F.struct(spot.alias("spot"), "id", "label")).alias("least")).select("least.id", "least.label")
    texts = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    size = len(MEASURES) + 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                values, length, lines = line_measures(*code_points(part.column("text")))
                table, at = np.concatenate([values, length[:, None]], axis=1), np.cumsum(lines)
                rows = []
                for ident, end, n in zip(part.column("id").to_pylist(), at.tolist(), lines.tolist()):
                    take = min(n, most_lines)
                    first = end - n + crc32(f"run:{ident}".encode()) % (n - take + 1)
                    rows.append(table[first : first + take].ravel())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label").cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["id", "label", "lines"])

    kind = one.schema["id"].dataType.simpleString()
    sample = sorted(one.mapInArrow(measure, f"id {kind}, label bigint, lines array<double>").collect(), key=lambda r: str(r["id"]))
    tables = [np.array(r["lines"]).reshape(-1, size) for r in sample]
    if not tables:
        return fit(np.zeros((0, size - 1)), np.zeros(0), np.zeros(0, int), np.zeros(0))
    every = np.concatenate(tables)
    return fit(every[:, :-1], every[:, -1], np.array([len(t) for t in tables]), np.array([r["label"] for r in sample], float))


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: list[str] = ()) -> DataFrame:
    """Score every whole text: the id column, held_out, score, predicted (score >= ``threshold``), then the columns ``keep``.

    No exchange: texts are scored where they are read. Null and empty texts are one empty line. Null ids are not held
    out. Repeated rows get equal scores. Other columns are ignored and are never inputs of a score.
    """
    names = [f"k{i}" for i in range(len(keep))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                value = model.score(*line_measures(*code_points(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(value), *(part.column(n) for n in names)], ["id", "score", *names])

    rows = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"), *(col(docs, c).alias(n) for c, n in zip(keep, names)))
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", "score double", *(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)])
    scored = rows.mapInArrow(score, schema)
    held = F.coalesce(bucket(F.col("id")) == 2, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(n).alias(c) for c, n in zip(keep, names)))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of the documents that score at least ``threshold``; null and empty texts are judged like any other."""

    return rows_where(docs, text_col, lambda texts: model.score(*line_measures(*code_points(texts))) >= threshold, PART_BYTES)
