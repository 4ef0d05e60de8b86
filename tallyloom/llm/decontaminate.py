"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item, or the whole item if it has fewer (but some). A window
occurs in a document only if all its shingles do, at their places. So one shingle, its rarest, is a sufficient prefix:
only documents with that shingle can hold the window. One pass counts every benchmark shingle over all documents; the
windows then order their shingles by that count (rare first) and keep the first; a second pass joins document shingles
with these prefix tokens. A candidate fixes where the window would begin, which gives the length and place bounds (it
must lie inside the document). What is left is verified word by word.

The benchmark is dealt into blocks of at most ``block_words`` words (an item is never divided). A block's index is
broadcast; a worker holds one at a time, and every batch of documents meets all blocks, so memory does not grow with
the benchmark. Documents are read twice and never exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import SLICE_BYTES, byte_view, col, rows_where, slices, text_of

SHINGLE = 3
FILTER_BITS = 20
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The lower-cased words of some texts: bytes, spans, a 64-bit hash each, and the words of each text."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    at: np.ndarray  # text i has the words at[i]:at[i + 1]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.stops[i]].tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(raw: np.ndarray, at: np.ndarray) -> Words:
    """Runs of digits, letters and all characters beyond ASCII; A-Z become a-z."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    solid = np.zeros(256, bool)
    solid[48:58] = solid[97:123] = solid[128:] = True
    data = lower[raw]
    inside = solid[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = np.full(int((stops - starts).max(initial=0)) + 1, ODD, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    begun = np.zeros(len(data), np.int64)
    begun[starts] = starts
    place = np.where(inside, np.arange(len(data)) - np.maximum.accumulate(begun), 0)
    terms = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * powers[place], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return Words(data, starts, stops, mixed(total[stops] - total[starts]), np.searchsorted(starts, at))


def shingle_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle that begins at each word, across text borders too (callers check the place)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    key = hashes[: len(hashes) - size + 1].copy()
    for i in range(1, size):
        key = key * ODD + hashes[i : len(hashes) - size + 1 + i]
    return mixed(key)


class Lookup:
    """Sorted keys behind a bit filter, so that most misses cost one look."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` of the known ones, and their numbers."""
        at = np.flatnonzero(self.filter[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        number = np.searchsorted(self.keys, keys[at])
        hit = self.keys[np.minimum(number, len(self.keys) - 1)] == keys[at] if len(self.keys) else np.zeros(0, bool)
        return at[hit], number[hit]


class Block:
    """One block of the benchmark: its words, its windows and, once they are known, their prefix tokens."""

    def __init__(self, names: list[str], texts: list[str], window: int):
        self.names = names
        self.words = words_of(*byte_view(pa.array(texts, pa.large_string())))
        at = self.words.at
        count = np.diff(at)
        windows = np.where(count >= window, count - window + 1, np.minimum(count, 1))
        item = np.repeat(np.arange(len(names)), windows)
        begin = np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        self.item, self.begin, self.length = item, begin, np.minimum(window, count[item])
        self.size = np.minimum(SHINGLE, self.length)  # shingle size of each window
        self.sizes = sorted(set(self.size.tolist()))
        self.lookups = {s: Lookup(np.concatenate([k[a : b - s + 1] for k in [shingle_keys(self.words.hashes, s)] for a, b in self.spans(s)] or [np.zeros(0, np.uint64)])) for s in self.sizes}
        self.prefixes: dict[int, tuple] = {}

    def spans(self, size: int) -> set[tuple[int, int]]:
        items = set(self.item[self.size == size].tolist())
        return {(int(self.words.at[i]), int(self.words.at[i + 1])) for i in items}

    def counts(self, words: Words) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each shingle size: numbers of the shingles that the texts hold, and how often."""
        out = {}
        for size in self.sizes:
            at, number = self.lookups[size].find(shingle_keys(words.hashes, size))
            text = np.searchsorted(words.at, at, side="right") - 1
            number = number[at + size <= words.at[text + 1]]
            out[size] = np.unique(number, return_counts=True)
        return out

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keep the rarest shingle of every window: (token lookup, windows in token order, where a token's windows begin)."""
        for size in self.sizes:
            rows = np.flatnonzero(self.size == size)
            keys = shingle_keys(self.words.hashes, size)
            best = np.full(len(rows), np.iinfo(np.int64).max)
            token, offset = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
            for shift in range(int((self.length[rows] - size).max(initial=-1)) + 1):
                inside = np.flatnonzero(shift + size <= self.length[rows])
                key = keys[self.begin[rows[inside]] + shift]
                seen = counts[size][np.searchsorted(self.lookups[size].keys, key)]
                better = seen < best[inside]
                best[inside[better]], token[inside[better]], offset[inside[better]] = seen[better], key[better], shift
            lookup = Lookup(token[best > 0])  # a shingle that no document has excludes its windows
            live = np.flatnonzero(best > 0)
            order = live[np.argsort(token[live], kind="stable")]
            first = np.searchsorted(token[order], lookup.keys)
            self.prefixes[size] = (lookup, rows[order], offset[order], np.append(first, len(order)))

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window in the texts."""
        places, windows = [], []
        for size, (lookup, rows, offset, first) in self.prefixes.items():
            at, token = lookup.find(shingle_keys(words.hashes, size))
            many = first[token + 1] - first[token]
            pick = np.repeat(first[token] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            begin, window = np.repeat(at, many) - offset[pick], rows[pick]
            text = np.searchsorted(words.at, np.repeat(at, many), side="right") - 1
            fits = (begin >= words.at[text]) & (begin + self.length[window] <= words.at[text + 1])
            places.append(begin[fits])
            windows.append(window[fits])
        begin = np.concatenate(places) if places else np.zeros(0, np.int64)
        window = np.concatenate(windows) if windows else np.zeros(0, np.int64)
        for shift in range(int(self.length[window].max(initial=0))):
            inside = shift < self.length[window]
            same = np.ones(len(begin), bool)
            same[inside] = words.hashes[begin[inside] + shift] == self.words.hashes[self.begin[window[inside]] + shift]
            begin, window = begin[same], window[same]
        return self.exact(words, begin, window)

    def exact(self, words: Words, begin: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences whose words are equal byte by byte."""
        equal: dict[tuple[int, int], bool] = {}
        keep = np.ones(len(begin), bool)
        for i, (p, w) in enumerate(zip(begin.tolist(), window.tolist())):
            b = int(self.begin[w])
            for shift in range(int(self.length[w])):
                pair = (p + shift, b + shift)
                if pair not in equal:
                    equal[pair] = words.word(pair[0]) == self.words.word(pair[1])
                if not equal[pair]:
                    keep[i] = False
                    break
        return begin[keep], window[keep]


class Matcher:
    """All blocks, one in memory at a time."""

    def __init__(self, blocks: list):
        self.blocks = blocks

    def __iter__(self) -> Iterator[Block]:
        for block in self.blocks:
            yield block.value
            if len(self.blocks) > 1:
                block.__dict__.pop("_value", None)  # read again from the worker's disk when next needed

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[int]]]:
        """For each text: words, hit words, sorted item names, and the hit runs as first and last + 1 word in turn."""
        words = words_of(*byte_view(texts))
        hit = np.zeros(len(words.starts) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(len(texts))]
        for block in self:
            begin, window = block.occurrences(words)
            np.add.at(hit, begin, 1)
            np.add.at(hit, begin + block.length[window], -1)
            text = np.searchsorted(words.at, begin, side="right") - 1
            for t, i in set(zip(text.tolist(), block.item[window].tolist())):
                found[t].add(block.names[i])
        inside = np.cumsum(hit)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(inside)])
        count = total[words.at[1:]] - total[words.at[:-1]]
        runs: list[list[int]] = [[] for _ in found]
        for t in np.flatnonzero(count).tolist():
            a, b = int(words.at[t]), int(words.at[t + 1])
            flips = np.flatnonzero(np.diff(np.concatenate([[False], inside[a:b], [False]]).astype(np.int8)))
            runs[t] = flips.tolist()
        return np.diff(words.at), count, [sorted(f) for f in found], runs


def prepare(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000) -> Matcher:
    """Index the benchmark by the rarest shingle of each window, counted over all of ``docs``."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(col(benchmark, item_col).cast("string"), F.lit("")).alias("name"), text_of(benchmark, item_text_col).alias("text"))
    sized = items.select("name", "text", (F.length("text") / 4 + 1).alias("words"))  # about the words of an item
    total = sized.agg(F.sum("words")).first()[0] or 0
    count = int(total // block_words) + 1
    parts = items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(count)))
    blocks = []
    for k in range(count if total else 0):
        rows = parts.where(F.col("block") == k).orderBy("name", "text").collect()
        blocks.append(Block([r["name"] for r in rows], [r["text"] for r in rows], window))
    sent = Matcher([spark.sparkContext.broadcast(b) for b in blocks])
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words = words_of(*byte_view(part.column("text")))
                for k, block in enumerate(sent):
                    for size, (number, n) in block.counts(words).items():
                        kind = np.full(len(number), k * SHINGLE + size - 1)
                        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(number), pa.array(n)], ["kind", "number", "n"])

    texts = docs.select(text_of(docs, text_col).alias("text"))
    counted = texts.mapInArrow(seen, "kind bigint, number bigint, n bigint").groupBy("kind", "number").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "shingle_counts") if blocks else counted  # one pass over the documents for all blocks
    for k, block in enumerate(blocks):  # at most as many rows as the block has shingles
        counts = {s: np.zeros(len(block.lookups[s].keys) + 1, np.int64) for s in block.sizes}
        for r in counted.where(F.floor(F.col("kind") / SHINGLE) == k).collect():
            counts[r["kind"] % SHINGLE + 1][r["number"]] = r["n"]
        block.choose(counts)
    for old in sent.blocks:
        old.unpersist()
    return Matcher([spark.sparkContext.broadcast(b) for b in blocks])


def benchmark_hits(docs: DataFrame, matcher: Matcher, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: the id column, n_words, n_hit (words inside an occurrence of a window), item_ids (sorted as
    strings) and hit_runs (first word and last word + 1 of each run, in turn).

    Null and empty texts have no words and no hits; items without words have no windows. A null id stays null; a null
    item id counts as the empty string. Repeated rows get equal results; repeated items count once. An empty benchmark
    hits nothing. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words, hit, names, runs = matcher.hits(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64()))], ["id", "n_words", "n_hit", "item_ids", "hit_runs"])

    rows = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_hit bigint, item_ids array<string>, hit_runs array<bigint>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def contaminated(n_words, n_hit, share: int = 20):
    """At least one hit, and hits make up 1 / ``share`` of the words or more."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def keep_clean(docs: DataFrame, matcher: Matcher, text_col: str = "text", share: int = 20) -> DataFrame:
    """All columns of the documents that aren't contaminated."""

    def clean(texts: pa.Array) -> np.ndarray:
        words, hit, _, _ = matcher.hits(texts)
        return ~contaminated(words, hit, share)

    return rows_where(docs, text_col, clean)
