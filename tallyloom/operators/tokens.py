"""Vocabulary, encoding, fixed-length chunks, shards and the reports about them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import text as tx
from ..functions.common import div
from ..plans.layout import colocate, spread
from ..plans.ordering import running_sum
from ..plans.skew import skew_join

PAD, EOS, UNK = 0, 1, 2  # reserved ids; words start behind them
DOC_BLOCK = 4096  # documents per running-sum block; a block with its token arrays is sorted in one task
BATCH_WORDS = 1 << 18  # words that a worker looks up at a time, whatever an Arrow batch holds
BROADCAST_WORDS = 1_000_000  # a vocabulary table up to this size goes to every worker, a larger one is joined by exchange


def build_vocab(df: DataFrame, text: str, size: int) -> DataFrame:
    """The ``size`` most frequent words (``word, n, token_id``), ties in word order.

    Counts are partial before the exchange and the top list is a distributed top-k, so the final numbering
    sees ``size`` rows.
    """
    words = df.select(F.explode(tx.words(text)).alias("word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return top.withColumn("token_id", rank + UNK)


def _small(vocab: DataFrame, key: str, value: str) -> dict | None:
    """The vocabulary as a dictionary if the table itself has at most ``BROADCAST_WORDS`` rows, else None."""
    rows = vocab.select(key, value).limit(BROADCAST_WORDS + 1).collect()
    return None if len(rows) > BROADCAST_WORDS else {r[0]: r[1] for r in rows}


def _in_slices(lists: pa.Array, fn: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``fn`` on runs of rows with about ``BATCH_WORDS`` elements (a longer row is a run of its own), put together again."""
    sizes = np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)
    ends, start, out = np.cumsum(sizes), 0, [pa.array([], kind)]
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_WORDS, side="right")))
        out.append(fn(lists.slice(start, stop - start)))
        start = stop
    return pa.concat_arrays(out)


def encode(
    df: DataFrame, vocab: DataFrame, key: str, text: str, keep: Sequence[str] = (), add_eos: bool = True
) -> DataFrame:
    """``key, keep..., tokens, n_tokens``: word ids of every text, unknown words as one id, end token behind.

    A vocabulary of bounded size goes to every worker, and texts are encoded where they are (a table with fewer splits
    than the cluster has cores is dealt out first); each row stays a row. For a larger one (then ``key`` must identify a row) words are joined by exchange; adaptive
    execution splits the partitions of frequent words.
    """
    ids = _small(vocab, "word", "token_id")
    if ids is None:
        return _encode_by_join(df, vocab, key, text, keep, add_eos)
    sent, end = df.sparkSession.sparkContext.broadcast(ids), [EOS] if add_eos else []

    def numbered(words: pa.Array) -> pa.Array:
        known, flat = sent.value, words.flatten().dictionary_encode()
        numbers = np.array([known.get(w, UNK) for w in flat.dictionary.to_pylist()], np.int32)[np.asarray(flat.indices)]
        sizes = np.asarray(pc.list_value_length(words).fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes + len(end))
        values = np.full(int(ends[-1]) if len(ends) else 0, EOS, np.int32)
        places = np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)) * len(end), sizes)
        values[places] = numbers
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))

    def look_up(words: pa.Array) -> pa.Array:
        return _in_slices(words, numbered, pa.list_(pa.int32()))

    tokens = F.arrow_udf(look_up, "array<int>")(tx.words(text))
    return spread(df, key).select(key, *keep, tokens.alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def _encode_by_join(
    df: DataFrame, vocab: DataFrame, key: str, text: str, keep: Sequence[str], add_eos: bool
) -> DataFrame:
    moved = colocate(df.select(key, *keep, F.col(text).alias("_text")), [key])
    words = moved.select(key, *keep, F.posexplode_outer(tx.words("_text")).alias("_pos", "word"))
    joined = words.join(vocab.select("word", "token_id"), "word", "left")
    member = F.when(
        F.col("word").isNotNull(), F.struct("_pos", F.coalesce("token_id", F.lit(UNK)).alias("id"))
    )
    tokens = F.transform(F.sort_array(F.collect_list(member)), lambda m: m["id"])
    tail = F.array(F.lit(EOS)) if add_eos else F.array().cast("array<int>")
    encoded = joined.groupBy(key, *keep).agg(F.concat(tokens, tail).alias("tokens"))
    return encoded.withColumn("n_tokens", F.size("tokens"))


def decode(df: DataFrame, vocab: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key, text`` of every token array (reserved ids left out, unknown words as ``<unk>``); exchanges as ``encode``."""
    names = _small(vocab, "token_id", "word")
    if names is None:
        return _decode_by_join(df, vocab, key, tokens)
    sent = df.sparkSession.sparkContext.broadcast({**names, UNK: "<unk>"})

    def spelled(arrays: pa.Array) -> pa.Array:
        known = sent.value
        flat = arrays.flatten().dictionary_encode()
        ids = flat.dictionary.to_pylist()
        named = np.array([i in known for i in ids], bool)
        place = np.asarray(flat.indices.fill_null(len(ids))).astype(np.int64)
        kept = np.concatenate([named, [False]])[place]
        sizes = np.asarray(pc.list_value_length(arrays).fill_null(0)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
        words = pa.array([known.get(i, "") for i in ids], pa.string()).take(pa.array(place[kept]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ")

    def look_up(arrays: pa.Array) -> pa.Array:
        return _in_slices(arrays, spelled, pa.string())

    return spread(df, key).select(key, F.arrow_udf(look_up, "string")(F.col(tokens)).alias("text"))


def _decode_by_join(df: DataFrame, vocab: DataFrame, key: str, tokens: str) -> DataFrame:
    moved = colocate(df.select(key, F.col(tokens).alias("_tokens")), [key])
    words = moved.select(key, F.posexplode_outer("_tokens").alias("_pos", "token_id"))
    named = words.join(vocab.select("token_id", "word"), "token_id", "left")
    word = F.when(F.col("token_id") == UNK, F.lit("<unk>")).otherwise(F.col("word"))
    member = F.when(word.isNotNull(), F.struct("_pos", word.alias("w")))
    listed = F.transform(F.sort_array(F.collect_list(member)), lambda m: m["w"])
    return named.groupBy(key).agg(F.array_join(listed, " ").alias("text"))


def encode_with(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Hook for a caller's tokenizer: ``fn`` maps batches of rows (pandas) to batches with token arrays."""
    return df.mapInPandas(fn, schema)


# ---- chunks ------------------------------------------------------------------------------------------------


def _cut(df: DataFrame, size: int, offset: str, arrays: Sequence[str], out: str) -> DataFrame:
    """One row per (document, block of ``size`` global positions): slices of the arrays and their place."""
    n = F.size(arrays[0])
    first, last = div(offset, size), div(F.col(offset) + n - 1, size)
    cut = df.filter(n > 0).withColumn(out, F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col(out) * size, F.col(offset))
    end = F.least((F.col(out) + 1) * size, F.col(offset) + n)
    start, length = (begin - F.col(offset) + 1).cast("int"), (end - begin).cast("int")
    return cut.withColumns({a: F.slice(a, start, length) for a in arrays}).withColumn("_at", begin)


def _placed(df: DataFrame, order: str, by: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Rows with the number of tokens before them; a length column saves reading the arrays to count them."""
    length = F.col("n_tokens") if "n_tokens" in df.columns else F.size(arrays[0])
    rows = df.withColumn("_len", length).select(*by, order, *arrays, "_len")
    return running_sum(rows, "_len", order, by, "_off", block=DOC_BLOCK)


def chunk_tokens(
    df: DataFrame, size: int, file: str, order: str, arrays: Sequence[str] = ("tokens",)
) -> DataFrame:
    """Fixed blocks of ``size`` tokens per file (``file, chunk_idx, arrays...``); a file's remainder is dropped.

    Documents are cut at block borders before the exchange, so a block is the largest unit any task puts
    together.
    """
    placed = _placed(df, order, [file], arrays)
    pieces = _cut(placed, size, "_off", arrays, "chunk_idx")
    listed = F.sort_array(F.collect_list(F.struct("_at", *arrays)))
    blocks = colocate(pieces, [file, "chunk_idx"]).groupBy(file, "chunk_idx").agg(listed.alias("_p"))
    joined = blocks.select(
        file, "chunk_idx", *[F.flatten(F.col(f"_p.{a}")).alias(a) for a in arrays]
    )
    return joined.filter(F.size(arrays[0]) == size)


def number_instances(chunks: DataFrame, offsets: DataFrame, file: str) -> DataFrame:
    """Global instance number of every chunk from the file offsets."""
    return skew_join(chunks, offsets.select(file, "start"), [file]).withColumn(
        "instance_id", F.col("start") + F.col("chunk_idx")
    ).drop("start")


def file_offsets(files: DataFrame, chunk_size: int, file: str, number: str, tokens: str, mask: str | None = None) -> DataFrame:
    """Instances per file and their global range ``[start, end)`` in the listed file order.

    A mask of another length than its token file is an error.
    """
    count = F.col(tokens)
    if mask:
        message = F.concat(F.lit("mask length differs in "), F.col(file).cast("string"))
        count = F.when(F.col(mask) == F.col(tokens), F.col(tokens)).otherwise(F.raise_error(message).cast("bigint"))
    sized = files.withColumn("n_instances", div(count, chunk_size))
    return running_sum(sized, "n_instances", number, out="start").withColumn(
        "start", F.col("start").cast("bigint")
    ).withColumn("end", F.col("start") + F.col("n_instances"))


def zip_mask(tokens: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token blocks with their mask blocks; blocks of different length are an error."""
    joined = tokens.join(masks, list(keys))
    checked = F.when(F.size("tokens") == F.size("label_mask"), F.col("label_mask")).otherwise(
        F.raise_error(F.lit("token and mask lengths differ")).cast("array<boolean>")
    )
    return joined.withColumn("label_mask", checked)


def training_instances(
    chunks: DataFrame, max_count: int = 32, max_period: int = 13, min_period: int = 1
) -> DataFrame:
    """Chunks with attention mask, document lengths and the repetition flag.

    Rejected instances stay in place with a false ``instance_mask``, as positions must not move.
    """
    tokens = F.col("tokens")
    return chunks.withColumns(
        {
            "attention_mask": ar.attention_mask(tokens, PAD), "doc_lens": ar.doc_lengths(tokens, EOS),
            "instance_mask": ~ar.repeats_too_often(tokens, max_count, max_period, min_period),
        }
    )


def filter_repetition(df: DataFrame, tokens: str, max_count: int = 32, max_period: int = 13, min_period: int = 1) -> DataFrame:
    """``instance_mask``: false where a periodic run repeats too often."""
    return df.withColumn("instance_mask", ~ar.repeats_too_often(F.col(tokens), max_count, max_period, min_period))


# ---- shards ------------------------------------------------------------------------------------------------


def shard_rows(df: DataFrame, max_tokens: int, order: str, tokens: str = "tokens") -> DataFrame:
    """Pieces of the concatenated token stream by shard (``shard, at, tokens``), ``max_tokens`` per shard.

    A document that crosses a border goes on in the next shard; no token is lost.
    """
    placed = _placed(df.withColumn("tokens", F.col(tokens)), order, [], ["tokens"])
    pieces = _cut(placed, max_tokens, "_off", ["tokens"], "_shard")
    return pieces.select(
        F.lpad(F.col("_shard").cast("string"), 5, "0").alias("shard"), F.col("_at").cast("bigint").alias("at"), "tokens"
    )


def validate_tokens(source: DataFrame, shards: DataFrame, vocab_size: int, tokens: str = "tokens") -> DataFrame:
    """Recount of documents, tokens and end tokens on both sides, and of ids out of bounds (one row)."""
    top = vocab_size + UNK

    def ends(c: str) -> Column:
        return F.sum(F.size(F.filter(c, lambda x: x == EOS)))

    src = source.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(tokens)).alias("n_tokens"))
    out = shards.agg(
        F.sum(F.size("tokens")).alias("written_tokens"), ends("tokens").alias("written_eos"),
        F.sum(F.size(F.filter("tokens", lambda x: (x < 0) | (x > top)))).alias("out_of_bounds"),
    )
    both = src.crossJoin(F.broadcast(out))
    return both.withColumn(
        "valid",
        (F.col("n_tokens") == F.col("written_tokens")) & (F.col("n_docs") == F.col("written_eos"))
        & (F.col("out_of_bounds") == 0),
    )


def split_by_size(df: DataFrame, limit: int, file: str, order: str, line: str) -> DataFrame:
    """Part number per line: running bytes of the file over ``limit``, in line order.

    A line belongs to the part its first byte falls into, so a part exceeds the limit by less than a line.
    """
    sized = running_sum(df, F.octet_length(line) + 1, order, [file], "_before")
    return sized.withColumn("part", div("_before", limit)).drop("_before")


def lines_to_pages(df: DataFrame, file: str, order: str, line: str) -> DataFrame:
    """Pages of a line stream: a first-level heading line (``= title =``) opens a page; blank pages drop out."""
    clean = F.replace(F.replace(F.col(line), F.lit("= = ="), F.lit("===")), F.lit("= ="), F.lit("=="))
    heading = tx.strip(clean).rlike("(?s)^= .* =$")
    numbered = running_sum(df.withColumn("_head", heading.cast("int")), "_head", order, [file], "_before")
    paged = numbered.withColumn("page_no", (F.col("_before") + F.col("_head")).cast("bigint"))
    lines = F.sort_array(F.collect_list(F.struct(order, line)))
    text = F.array_join(F.transform(lines, lambda x: x[line]), "\n")
    pages = paged.groupBy(file, "page_no").agg(text.alias("page"))
    return pages.filter(tx.strip("page") != "")

