"""Line deduplication by a deletion-neighbourhood join.

A line (without blanks at its ends) goes if an equal line, or one within one edit, stands earlier: in a document with a
smaller id, or higher in the same document. Equal lines meet by hash first, so a line that half of all documents share
is one row from then on.

Two lines are within one edit if they become equal by deleting one character at the same place of both (exchanged
character), or one of them by deleting one of the other (added character). So every line emits hashed keys of all its
one-character deletions and of itself; rows with the same key join by minima, not as pairs: the earliest line with the same
deletion at the same place, and the earliest whole line and the earliest deletion with the same key. The edit distance
of each line found this way to its partner is then verified on the texts.

One edit leaves the first or the second half of a line as it is. So the lines whose halves nobody else has are left
out before any deletion is emitted, and the others emit the deletions of the half that may differ only. This loses no
match: a half is keyed for its own length and for a line that is one character shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.scratch import materialize
from .common import code_points, col, numbered, slices, tasks_for, text_of
from .quality import BLANK, PART_BYTES, char_kinds, line_spans

#: The characters that are trimmed from the ends of a line.
BLANKS = "".join(chr(i) for i in range(0x3000) if chr(i).isspace())
#: Up to so many rows (of at most some 40 bytes) a list of lines is broadcast; a longer one is joined by exchange.
BROADCAST_ROWS = 500_000
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """The first ``count`` powers; a worker keeps the longest row of them."""
    if base not in _powers or len(_powers[base]) < count:
        out = np.full(count, base, np.uint64)
        out[:1] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base][:count]


def scattered(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(STEP)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Lines:
    """The trimmed lines of some texts with hashes of any part of them."""

    def __init__(self, points: np.ndarray, at: np.ndarray):
        self.points = np.ascontiguousarray(points, np.uint32)
        starts, ends, self.lines = line_spans(points, at)
        solid = np.flatnonzero((char_kinds()[points] & BLANK) == 0)
        bounded = np.append(solid, len(points))
        first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = last > first
        self.starts = np.where(some, bounded[np.minimum(first, len(solid))], starts)
        self.ends = np.where(some, bounded[np.maximum(last - 1, 0)] + 1, self.starts)
        self.text = np.repeat(np.arange(len(self.lines)), self.lines)
        self.number = np.arange(len(starts)) - np.repeat(np.cumsum(self.lines) - self.lines, self.lines)
        self.size = self.ends - self.starts
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scattered(points) * powers(STEP, len(points)), dtype=np.uint64)])
        self.back = powers(BACK, len(points) + 2)

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the characters a to b, whatever their place."""
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def digests(self, which: np.ndarray) -> np.ndarray:
        """128-bit BLAKE2b of the characters of these lines, as two columns of numbers: what makes lines equal."""
        held = self.points.view(np.uint8).data
        spans = zip((4 * self.starts[which]).tolist(), (4 * self.ends[which]).tolist())
        joined = b"".join(blake2b(held[a:b], digest_size=16).digest() for a, b in spans)
        return np.frombuffer(joined, np.int64).reshape(-1, 2)

    def half(self, size: np.ndarray, tail: bool) -> np.ndarray:
        """Key of the first or last half of a line, for lines of ``size`` characters."""
        n = size // 2
        a, b = (self.ends - n, self.ends) if tail else (self.starts, self.starts + n)
        return scattered(self.part(a, b) ^ scattered(2 * size + tail))

    def deletions(self, line: int, head: bool, tail: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the line without one character, where a half allows it; the hash counts the length."""
        a, b = int(self.starts[line]), int(self.ends[line])
        n = b - a
        from_, to = ((n - 1) // 2 if not tail else 0), (n if head else n - (n - 1) // 2)
        place = np.arange(from_, to)
        left = self.part(np.full(len(place), a), a + place)
        right = (self.sums[b] - self.sums[a + place + 1]) * self.back[a + 1]
        return place, scattered((left + right) ^ scattered(np.full(len(place), n - 1)))


def by_size(big: DataFrame, small: DataFrame, rows: int, on: Column) -> DataFrame:
    """Join; the small side, made of that many lines, is broadcast if that is a bounded amount, else both are exchanged."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on)


def line_table(rows: DataFrame, near_chars: int) -> DataFrame:
    """(id, key, line, hash, rest, halves) of every line that isn't blank. ``rows``: id, key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                lines = Lines(*code_points(part.column("text")))
                some = np.flatnonzero(lines.size > 0)
                near = lines.size[some] >= near_chars
                halves = [lines.half(np.maximum(lines.size - less, 0), tail)[some].view(np.int64) for less in (0, 1) for tail in (False, True)]
                text, digests = pa.array(lines.text[some]), lines.digests(some)
                out = [part.column("id").take(text), part.column("key").take(text), pa.array(lines.number[some].astype(np.int32)), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
                yield pa.RecordBatch.from_arrays([*out, *(pa.array(h, mask=~near) for h in halves)], ["id", "key", "line", "hash", "rest", "a", "b", "c", "d"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key bigint, line int, hash bigint, rest bigint, a bigint, b bigint, c bigint, d bigint")


def near_lines(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """Hashes (hash, rest) of the lines that stand within one edit of an earlier other line."""
    halves = F.array(*(F.struct(F.col(c).alias("half"), F.lit(c in "bd").alias("tail")) for c in "abcd"))
    keyed = distinct.where("a is not null").select("hash", "rest", F.explode(halves).alias("h")).select("hash", "rest", "h.*")
    shared = keyed.groupBy("half", "tail").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half", "tail")
    sides = keyed.join(shared.hint("merge"), ["half", "tail"]).groupBy("hash", "rest").agg(F.max(~F.col("tail")).alias("head"), F.max("tail").alias("tail"))
    wanted = sides.join(distinct.select("hash", "rest", "first"), ["hash", "rest"]).select("first.id", "first.key", "first.line", "hash", "rest", "head", "tail")
    wanted = materialize(wanted, "wanted")
    grouped = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("line", "hash", "rest", "head", "tail")).alias("lines"))
    texts = by_size(rows.alias("r"), grouped.alias("w"), wanted.count(), F.expr("r.key = w.key and r.id <=> w.id")).select("r.id", "r.key", "r.text", "w.lines")
    kind = rows.schema["id"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                owner, found = [], []
                for i, (text, lines) in enumerate(zip(part.column("text").to_pylist(), part.column("lines").to_pylist())):
                    split = text.split("\n")
                    for x in lines:
                        owner.append(i)
                        found.append((x["line"], x["hash"], x["rest"], x["head"], x["tail"], split[x["line"]]))
                owners = pa.array(owner, pa.int64())
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id").take(owners), part.column("key").take(owners), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], ["id", "key", "line", "hash", "rest", "head", "tail", "text"])

    shown = materialize(texts.mapInArrow(pick, f"id {kind}, key bigint, line int, hash bigint, rest bigint, head boolean, tail boolean, text string").dropDuplicates(["hash", "rest"]), "shown")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES // 4):
                lines = Lines(*code_points(part.column("text")))
                whole = scattered(lines.part(lines.starts, lines.ends) ^ scattered(lines.size))
                rows_, places, keys = [np.arange(len(whole))], [np.full(len(whole), -1)], [whole]
                for i, (head, tail) in enumerate(zip(part.column("head").to_pylist(), part.column("tail").to_pylist())):
                    place, key = lines.deletions(i, head, tail)
                    rows_.append(np.full(len(place), i))
                    places.append(place)
                    keys.append(key)
                owner = pa.array(np.concatenate(rows_))
                own = [part.column(c).take(owner) for c in ("id", "key", "line", "hash", "rest")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64))], ["id", "key", "line", "hash", "rest", "place", "variant"])

    variants = shown.select("id", "key", "line", "hash", "rest", "head", "tail", "text").mapInArrow(emit, f"id {kind}, key bigint, line int, hash bigint, rest bigint, place int, variant bigint")
    rank = F.struct(F.col("id").isNull().alias("x"), "id", "key", "line", "hash", "rest")
    ranked = variants.select("variant", "place", rank.alias("rank")).repartition(tasks_for(variants), "variant")
    same, any_ = Window.partitionBy("variant", "place"), Window.partitionBy("variant")
    found = ranked.select(
        "rank",
        "place",
        F.min("rank").over(same).alias("exchanged"),
        F.min(F.when(F.col("place") < 0, F.col("rank"))).over(any_).alias("shorter"),
        F.min(F.when(F.col("place") >= 0, F.col("rank"))).over(any_).alias("longer"),
    )
    partners = F.when(F.col("place") < 0, F.array("longer")).otherwise(F.array("exchanged", "shorter"))
    pairs = found.select("rank", F.explode(partners).alias("partner")).where("partner < rank").select("rank.hash", "rank.rest", F.col("partner.hash").alias("other"), F.col("partner.rest").alias("other_rest")).distinct()
    one, two = shown.select("hash", "rest", F.col("text").alias("one")), shown.select(F.col("hash").alias("other"), F.col("rest").alias("other_rest"), F.col("text").alias("two"))
    checked = pairs.join(one.hint("merge"), ["hash", "rest"]).join(two.hint("merge"), ["other", "other_rest"])  # Spark sizes what is exploded too low to broadcast it
    return checked.where(F.levenshtein(stripped("one"), stripped("two"), 1).between(0, 1)).select("hash", "rest").distinct()


def stripped(name: str) -> Column:
    """The line without blanks at its ends."""
    return F.btrim(F.col(name), F.lit(BLANKS))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = 24) -> DataFrame:
    """(id, key, line) of every line that goes; key is the hash of id and text, line counts from 0."""
    rows = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    lines = materialize(line_table(rows, near_chars), "lines")
    rank = F.struct(F.col("id").isNull().alias("x"), "id", "key", "line")
    distinct = lines.groupBy("hash", "rest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.max(c).alias(c) for c in "abcd"))
    distinct = materialize(distinct, "distinct")
    near = near_lines(rows, distinct).withColumn("near", F.lit(True))
    decided = distinct.select("hash", "rest", "first", "copies").join(near, ["hash", "rest"], "left").where("copies > 1 or near")
    places = lines.select("id", "key", "line", "hash", "rest").join(decided, ["hash", "rest"])
    return places.where(F.col("near") | (rank != F.col("first"))).select("id", "key", "line").distinct()


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = 24, counts: tuple[str, str] | None = None) -> DataFrame:
    """All columns of ``docs``, the text without the lines that go (the others as they are, joined by line feeds).

    Lines that aren't blank are compared without blanks at their ends. Lines of at least ``near_chars`` characters also go
    if they are within one edit (insert, delete or exchange a character) of an earlier line of that size, whether that line
    stays or not. ``counts``: names of two more columns, lines and lines that went.

    A null text is an empty text with one blank line and stays null. Blank lines stay. Null ids come after all others.
    Rows that repeat id and text are one document and stay equal; equal ids with other texts are ordered by a hash. No
    rows: no rows. Other columns may have any names. Lines are equal if their 128-bit BLAKE2b digests are. A match within one
    edit could only be lost, never made, by two 64-bit keys being equal by chance, as its texts are compared.
    """
    went = materialize(dropped_lines(docs, id_col, text_col, near_chars), "went")
    grouped = went.groupBy(F.col("id").alias("went_id"), F.col("key").alias("went_key")).agg(F.sort_array(F.collect_list("line")).alias("gone"))
    rows, text_at, id_at = numbered(docs), f"c{docs.columns.index(text_col)}", f"c{docs.columns.index(id_col)}"
    columns, extra = rows.columns, list(counts) if counts else []
    marked = rows.withColumn("key", F.xxhash64(id_at, text_of(rows, text_at)))
    match = (F.col("key") == F.col("went_key")) & F.col(id_at).eqNullSafe(F.col("went_id"))
    joined = marked.join(grouped, match, "left").select(*columns, "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at, PART_BYTES):
                texts, total, lost = [], [], []
                for old, lines in zip(part.column(text_at).to_pylist(), part.column("gone").to_pylist()):
                    text = old or ""
                    if lines:
                        drop, split = set(lines), text.split("\n")
                        texts.append("\n".join(x for i, x in enumerate(split) if i not in drop))
                    else:
                        texts.append(old)
                    total.append(text.count("\n") + 1)
                    lost.append(len(lines or ()))
                out = [pa.array(texts, pa.string()) if c == text_at else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*out, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], [*columns, "total", "lost"])

    schema = StructType([*rows.schema.fields, StructField("total", LongType()), StructField("lost", LongType())])
    done = joined.mapInArrow(cut, schema)
    return (done if extra else done.drop("total", "lost")).toDF(*docs.columns, *extra)
