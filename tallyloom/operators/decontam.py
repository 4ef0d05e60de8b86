"""Contamination between evaluation and training text by word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.common import let
from ..plans.bloom import maybe_in

# Defaults of the cleaning rule.
NGRAM, WINDOW, MAX_HITS, MIN_PIECE = 13, 200, 10, 200


def eval_ngrams(df: DataFrame, text: str, n: int = NGRAM) -> DataFrame:
    """Every evaluation row with its normalised n-grams (column ``gram``); the text is normalised first."""
    grams = F.array_distinct(tx.word_ngrams(tx.overlap_normal(text), n))
    return df.select(*[c for c in df.columns if c != text], F.explode(grams).alias("gram"))


def matched_grams(grams: DataFrame, train: DataFrame, text: str, n: int = NGRAM) -> DataFrame:
    """Distinct evaluation n-grams that occur in the training text.

    The training side is the large one: it is deduplicated inside each document and passes a Bloom filter over the
    evaluation side, which is of fixed size. Only what may match is exchanged and compared as text.
    """
    wanted = grams.select("gram").distinct()
    seen = train.select(F.explode(F.array_distinct(tx.word_ngrams(tx.overlap_normal(text), n))).alias("gram"))
    return maybe_in(seen, "gram", wanted, "gram").join(wanted, "gram", "left_semi").distinct()


def train_overlap(
    evaluation: DataFrame, train: DataFrame, eval_text: str = "text", train_text: str = "text", n: int = NGRAM
) -> DataFrame:
    """Contaminated evaluation documents: distinct (task, doc_id), the splits of a task united."""
    grams = eval_ngrams(evaluation.select("task", "doc_id", eval_text), eval_text, n)
    hits = matched_grams(grams, train, train_text, n)
    return grams.join(hits, "gram", "left_semi").select("task", "doc_id").distinct()


def dirty_spans(train: DataFrame, contaminants: DataFrame, key: str, text: str, gram_text: str, n: int = NGRAM) -> DataFrame:
    """Per training document the n-grams that also occur in the contaminants, as ordered character spans.

    Training text is split into words before normalisation, contaminants after it. As in ``matched_grams`` only
    n-grams that may match leave the scan. Places are worked out for the documents with such an n-gram alone.
    """
    dirt = eval_ngrams(contaminants.select(gram_text), gram_text, n).distinct()
    plain = tx.ngrams_of(F.transform(tx.words(text), tx.overlap_normal), n)
    seen = maybe_in(train.select(F.col(key).alias("_key"), F.explode(plain).alias("gram")), "gram", dirt, "gram").select("_key").distinct()
    train = train.join(seen, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    # blanks survive normalisation, so a normalised n-gram is its normalised words joined
    spans = train.select(key, F.explode(tx.ngram_spans(text, n, tx.overlap_normal)).alias("g")).select(key, "g.*")
    hits = maybe_in(spans, "gram", dirt, "gram").join(dirt, "gram", "left_semi")
    return hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end"))).alias("hits"))


def _clean_pieces(text: Column, hits: Column, window: int, max_hits: int, min_piece: int) -> Column:
    """Pieces of the text between widened hits that are long enough; null hits mean a clean text."""
    n = F.length(text)

    def widened(h: Column) -> Column:
        return F.transform(
            h,
            lambda x: F.struct(
                F.greatest(x["start"] - window, F.lit(0)).alias("start"), F.least(x["end"] + window, n).alias("end")
            ),
        )

    def cut(h: Column) -> Column:
        before = F.transform(
            h,
            lambda x, i: F.struct(
                F.when(i == 0, F.lit(0)).otherwise(F.get(h, i - 1)["end"]).alias("at"), x["start"].alias("to")
            ),
        )
        kept = F.filter(before, lambda p: p["to"] - p["at"] > min_piece)
        pieces = F.transform(kept, lambda p: F.substr(text, p["at"] + 1, p["to"] - p["at"]))
        end = F.coalesce(F.try_element_at(h, F.lit(-1))["end"], F.lit(-1))
        tail = F.when(end < n - min_piece, F.array(F.substr(text, end + 2))).otherwise(F.array().cast("array<string>"))
        return F.concat(pieces, tail)

    empty = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.coalesce(hits, F.array().cast("array<struct<pos:int,start:int,end:int>>"))
    return F.when(F.size(spans) > max_hits, F.array().cast("array<string>")).otherwise(
        let(F.coalesce(widened(spans), empty), cut)
    )


def clean_text(
    train: DataFrame, contaminants: DataFrame, key: str, text: str, gram_text: str, n: int = NGRAM,
    window: int = WINDOW, max_hits: int = MAX_HITS, min_piece: int = MIN_PIECE,
) -> DataFrame:
    """Training text without contaminated stretches (``key, piece_no, text``).

    Every hit is cut out with ``window`` characters on both sides; pieces must be longer than ``min_piece``;
    a document with more than ``max_hits`` hits is dropped. Whole texts are processed.
    """
    hits = dirty_spans(train, contaminants, key, text, gram_text, n)
    joined = train.select(key, text).join(hits, key, "left")
    pieces = _clean_pieces(F.col(text), F.col("hits"), window, max_hits, min_piece)
    return joined.select(key, F.posexplode(pieces).alias("piece_no", "text"))
