"""Best-fit decreasing packing of tokenized documents into sequences of a fixed length.

Documents are tokenized where they are read, and only small piece rows (id, place, length, checksum) go on. Best-fit
decreasing looks at lengths alone, so the exact plan for any number of documents follows from the histogram of
lengths, which has one row per length and at most ``seq_len`` rows. The plan keeps a segment tree over remaining
capacities whose leaves hold the open bins; each run of equal pieces goes to the tightest open bins that fit, found in
logarithmic time. What comes out are runs: so many pieces of a length, by rank, go to so many bins in a row. Spark
then numbers the pieces of each length (counts per bucket, running sums, row numbers inside a bucket) and looks every
piece's run up. No task sees more than a bucket.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import SLICE_BYTES, code_points, col, slices, tasks_for, text_of

#: Characters that some pattern might count as white space; no cut is made next to one of them.
LOOSE = r"\s\u180e\u200b\u2060\ufeff"
_blank = re.compile(f"(?<=[^{LOOSE}]) (?=[^{LOOSE}])")
_loose: np.ndarray | None = None
#: So many new words are encoded as one text.
TOGETHER = 256


def loose_table() -> np.ndarray:
    """Which code points ``LOOSE`` covers; all of them are below U+FF00, save the byte order mark."""
    global _loose
    if _loose is None:
        _loose = np.zeros(0x110000, bool)
        for i in (*range(0x3100), 0xFEFF):
            _loose[i] = re.match(f"[{LOOSE}]", chr(i)) is not None
    return _loose


class WordEncoder:
    """A byte-level tokenizer with a cache of words.

    The tokenizer's pattern always starts a new word at a blank between two characters that aren't white space, so the
    parts between such blanks (each with its blank in front) have the ids that they have inside the text.
    """

    def __init__(self, path: str, most: int = 45_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        #: Bytes of each token: a byte-level vocabulary has one character for each.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self.loose = {chr(i) for i in np.flatnonzero(loose_table())}
        self.clear()

    def clear(self) -> None:
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {"": 0}
        self.chars = 0
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.words, self.used = 1, 0
        self.pool = np.zeros(1 << 16, np.uint32)

    def ids_of(self, parts: list[str], front: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, each with ``front`` before it, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([front + p for p in parts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def ids_of_firm(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts without loose ends, a blank before each: many are encoded as one text, which the token bytes take apart."""
        joined = [" " + " ".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        ids, _ = self.ids_of(joined, "")
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts)))
        stops = np.cumsum(self.bytes[ids])
        last = np.searchsorted(stops, ends)
        assert np.array_equal(stops[last], ends), "a token crosses two words"
        return ids, np.diff(last + 1, prepend=0)

    def learn(self, cache: dict[str, int], parts: list[str], front: str) -> None:
        alone, loose = parts, self.loose
        if front == " ":
            alone = [p for p in parts if not p or p[-1] in loose or p[0] in loose]
            firm = [p for p in parts if p and p[-1] not in loose and p[0] not in loose]
            everything = " ".join(firm)
            special = [t for t in self.added if t in everything]
            if special:
                alone += [p for p in firm if any(t in p for t in special)]
                firm = [p for p in firm if not any(t in p for t in special)]
            if firm:
                self.keep(cache, firm, *self.ids_of_firm(firm))
        if alone:
            self.keep(cache, alone, *self.ids_of(alone, front))

    def keep(self, cache: dict[str, int], some: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.words + len(some) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros(len(a), np.int64)]) for a in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        own = slice(self.words, self.words + len(some))
        self.starts[own], self.sizes[own] = self.used + np.cumsum(sizes) - sizes, sizes
        cache.update(zip(some, range(self.words, self.words + len(some))))
        self.words += len(some)
        self.used += len(ids)
        self.chars += sum(map(len, some)) + 60 * len(some)

    def numbers(self, cache: dict[str, int], parts: pa.Array, front: str) -> np.ndarray:
        """The cache's number of every part; only distinct parts are looked up."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(cache.get, distinct))
        if None in found:
            self.learn(cache, [p for p, n in zip(distinct, found) if n is None], front)
            found = list(map(cache.get, distinct))
        return np.array(found, np.int64)[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, simple: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` after each, and where each text starts and how many it has. ``simple``: no loose characters next to each other."""
        if self.chars > self.most:
            self.clear()
        plain, odd = np.flatnonzero(simple), np.flatnonzero(~simple)
        lists = [pc.split_pattern(texts.take(pa.array(plain)), " ")] if len(plain) else []
        if len(odd):
            lists.append(pa.array([_blank.split(t) for t in texts.take(pa.array(odd)).to_pylist()], pa.list_(pa.string())))
        counts = np.concatenate([pc.list_value_length(x).to_numpy() for x in lists]).astype(np.int64)
        parts = pa.concat_arrays([x.flatten().cast(pa.large_string()) for x in lists])
        after = np.cumsum(counts)
        heads = np.zeros(len(parts), bool)
        heads[after - counts] = True
        words = np.empty(len(parts), np.int64)
        words[heads] = self.numbers(self.first, parts.filter(pa.array(heads)), "")
        words[~heads] = self.numbers(self.inner, parts.filter(pa.array(~heads)), " ")
        sizes = np.concatenate([[0], np.cumsum(self.sizes[words])])
        total = np.diff(sizes[after], prepend=0) + 1  # with the end id
        last = np.cumsum(total) - 1
        ids = np.empty(int(sizes[-1]) + len(total), np.uint32)
        inside = np.ones(len(ids), bool)
        inside[last] = False
        ids[last] = end
        place = np.arange(sizes[-1])
        ids[inside] = self.pool[place + np.repeat(self.starts[words] - sizes[:-1], self.sizes[words])]
        start, length = np.empty(len(total), np.int64), np.empty(len(total), np.int64)
        order = np.concatenate([plain, odd])
        start[order], length[order] = last + 1 - total, total
        return ids, start, length


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, tokenizer: str, seq_len: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, bucket (and ids)."""
    buckets = tasks_for(docs)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, loose, row = encoder(tokenizer), loose_table(), TaskContext.get().partitionId() * 7919
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                points, at = code_points(part.column("text"))
                near = np.zeros(len(points) + 1, bool)
                odd = loose[points]
                near[1:-1] = odd[1:] & odd[:-1]
                double = np.concatenate([[0], np.cumsum(near)])
                stops = at[1:]
                simple = double[np.maximum(stops, at[:-1] + 1)] == double[at[:-1] + 1]
                ids, rows, sizes = words.encode(part.column("text"), simple, end_id)
                count = -(-sizes // seq_len)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = np.repeat((sizes - 1) % seq_len + 1, count)  # the first piece takes the rest
                start = np.where(piece > 0, head + (piece - 1) * seq_len, 0)
                length = np.where(piece > 0, seq_len, head)
                begin = rows[doc] + start
                own = [ids[b : b + n] for b, n in zip(begin.tolist(), length.tolist())]
                bucket = (np.arange(len(doc)) + row) % buckets
                row += len(doc)
                out = [part.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()), pa.array(bucket.astype(np.int32))]
                if with_ids:
                    out.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["id", "piece", "start", "length", "ids_crc32", "bucket", "ids"][: len(out)])

    rows = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, bucket int"
    return rows.mapInArrow(pieces, schema + (", ids array<bigint>" if with_ids else ""))


class Capacities:
    """Open bins by remaining capacity: a segment tree over capacities says where the next larger one is."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, first: int, count: int) -> None:
        self.bins[capacity].append((first, count))
        self.mark(capacity, True)

    def mark(self, capacity: int, value: bool) -> None:
        node = capacity + self.size
        self.any[node] = value
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that an open bin has."""
        node = length + self.size
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None

    def take(self, capacity: int) -> tuple[int, int]:
        first, count = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self.mark(capacity, False)
        return first, count


def best_fit_plan(counts: dict[int, int], seq_len: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset) of best-fit decreasing.

    The k-th piece of a run goes to bin ``first bin + k // pieces a bin`` at ``offset + k % pieces a bin * length``. A
    run ends with a length or with a run of like bins, so the number of runs depends on ``seq_len``, not on the
    number of pieces.
    """
    tree, runs, opened = Capacities(seq_len), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, bins = seq_len, opened, -(-left // (seq_len // length))
                opened += bins
            else:
                first, bins = tree.take(capacity)
            fit = capacity // length  # a bin that was the tightest stays the tightest until it is full
            full = min(bins, left // fit)
            if full:
                runs.append((length, rank, full * fit, first, fit, seq_len - capacity))
                rank, left = rank + full * fit, left - full * fit
                if capacity - fit * length:
                    tree.add(capacity - fit * length, first, full)
                first, bins = first + full, bins - full
            if bins and 0 < left < fit:
                runs.append((length, rank, left, first, left, seq_len - capacity))
                tree.add(capacity - left * length, first, 1)
                left, first, bins = 0, first + 1, bins - 1
            if bins:
                tree.add(capacity, first, bins)
    return np.array(runs, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``seq_len`` tokens as best-fit decreasing needs.

    ``tokenizer``: path of a tokenizer file, the same on every machine. A document is its ids (without added special
    tokens) and then ``end_id``. Only a longer one is cut: the first piece takes the rest, the others are full. Returns
    a row per piece: the id column, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null or empty text: one piece of one token. Null ids and repeated rows are documents of their own. No rows: no
    rows. Other columns are ignored. Pieces of one length are interchangeable, so ties go by bucket, id and piece. A
    text of any length is tokenized whole, in one task. The piece rows are written once to the shared folder, because
    they are read for the histogram and for the places. They are never broadcast, however small their file is.
    """
    pieces = materialize(cut_pieces(docs, tokenizer, seq_len, end_id, id_col, text_col, with_ids), "pieces")
    counted = pieces.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit_plan(histogram, seq_len)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("bucket", "length", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = pieces.join(offsets.hint("merge"), ["bucket", "length"]).select(*(c for c in pieces.columns if c != "bucket"), (F.col("before") + inside - 1).alias("rank"))
    keep = [c for c in pieces.columns if c not in ("bucket",)]
    ordered = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    first_run = np.searchsorted(ordered[:, 0], np.arange(seq_len + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own, lo, hi = length == n, first_run[n], first_run[n + 1]
                run[own] = lo + np.searchsorted(ordered[lo:hi, 1], rank[own], side="right") - 1
            _, since, _, first, each, offset = ordered[run].T
            k = rank - since
            out = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(first + k // each), pa.array(offset + k % each * length)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in keep)
    placed = ranked.mapInArrow(place, schema + ", sequence_id bigint, offset bigint")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and its token ids in order; needs ``pack(..., with_ids=True)``."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
