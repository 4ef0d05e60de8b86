"""Near-duplicate documents by SimHash and pivot distance tables.

Fingerprints have 64 bits. Equal ones are one node from the start, so copies cost one row each and no pairs.

A pivot table holds the Hamming distances of a fingerprint to reference fingerprints. By the triangle inequality two
fingerprints that differ in at most ``bits`` places differ by at most ``bits`` in every column. Two kinds of references
are used. The zero and the 64 unit fingerprints: distance to unit i minus distance to zero is 1 - 2 * bit i, so two
rows agree in a group of these columns exactly if the group's bits agree. The 64 columns are dealt into ``bits + 3``
groups; at least three of them agree for a linked pair, so every choice of three groups is an equi-join key, and no
link is lost. Inside a join bucket the table of distances to ``PIVOTS`` scattered references discards pairs by their
maximum column difference, and the Hamming distance itself verifies the survivors.

A bucket holds distinct fingerprints and gives back a star per linked set, never its pairs. Buckets of more than
``BUCKET`` members are not gathered: they are dealt again by three of the groups of the bits that are still free, and
after two such rounds at most 12 bits are free. Sets meet by passing on the smallest label along links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import SLICE_BYTES, byte_view, col, numbered, slices, text_of

PIVOTS = 32
BUCKET = 4096
#: Rows of three numbers that may be broadcast; they are counted first, as Spark sizes a table below an explode as if it made no rows.
BROADCAST_ROWS = 200_000
ALL = (1 << 64) - 1


def lower_words(raw: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (A-Z only) with one blank after each; starts and ends of words; words in each text."""
    lower, white = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    white[[9, 10, 11, 12, 13, 32]] = True
    spaced = lower[np.insert(raw, at[1:], 32)]
    at = at + np.arange(len(at))
    blank = white[spaced]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    spaced[blank] = 32
    data = spaced[keep]
    stops = np.flatnonzero(blank[keep])
    new = np.concatenate([[0], np.cumsum(keep)])[at]
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    return data.tobytes(), starts, stops, np.diff(np.searchsorted(stops, new))


def shingle_spans(starts: np.ndarray, stops: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each shingle begins and ends, and the shingles of each text: one for fewer than ``size`` words, none for none."""
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    first = np.cumsum(words) - words
    head = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    tail = np.minimum(head + size - 1, np.repeat(first + words - 1, count))
    return starts[head], stops[tail], count


def shingle_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:z], 42) for a, z in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))


def simhash(texts: pa.Array, size: int) -> np.ndarray:
    """Fingerprints of the texts; a bit is 1 if it is set in more than half of the shingle hashes."""
    data, starts, stops, words = lower_words(*byte_view(texts))
    begin, end, count = shingle_spans(starts, stops, words, size)
    out = np.zeros(len(count), np.uint64)
    some = count > 0
    if some.any():
        bits = np.unpackbits(shingle_hashes(data, begin, end).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > count[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(docs: DataFrame, text_col: str, keep: dict[str, str], name: str = "fp", size: int = 4) -> DataFrame:
    """The columns ``keep`` (old name -> new name) and the fingerprint of each row's text as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(keep.values())
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                prints = simhash(part.column(text), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(prints)], [*names, name])

    text = "text"
    while text in keep.values():
        text += "_"
    rows = docs.select(*(col(docs, old).alias(new) for old, new in keep.items()), text_of(docs, text_col).alias(text))
    rows_schema = rows.select(*(f"`{n}`" for n in keep.values())).schema
    return rows.mapInArrow(run, rows_schema.add(name, "long"))


def references() -> np.ndarray:
    """Scattered reference fingerprints: the same on every machine."""
    return np.random.default_rng(64).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(65).integers(0, 2, PIVOTS, dtype=np.uint64)


def linked_stars(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For one bucket: (member, smallest member of its linked set), without the smallest members themselves."""
    prints = np.sort(prints)
    table = np.bitwise_count(prints[:, None] ^ references()[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    column = table[order, 0]
    last = np.searchsorted(column, column + bits, side="right")
    left, right = [], []
    for i in range(len(order) - 1):
        near = order[i + 1 : last[i]]
        if len(near):
            near = near[(np.abs(table[near] - table[order[i]]) <= bits).all(axis=1)]
            near = near[np.bitwise_count(prints[near] ^ prints[order[i]]) <= bits]
            if len(near):
                left.append(np.full(len(near), order[i]))
                right.append(near)
    if not left:
        return prints[:0], prints[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(prints))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(prints))
    return prints[moved], prints[label[moved]]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks(bits: int, fixed: int = 0) -> list[int]:
    """The key masks: ``fixed`` and three of the groups that the other bits are dealt into."""
    free = [i for i in range(64) if not fixed >> i & 1]
    count = bits + 3
    groups = [sum(1 << i for i in free[g * len(free) // count : (g + 1) * len(free) // count]) for g in range(count)]
    return [fixed | sum(chosen) for chosen in combinations(groups, 3)]


def bucket_members(prints: DataFrame, bits: int, levels: list[int]) -> DataFrame:
    """(mask, key, fp, n) of every bucket with at least two members. ``prints``: fp and the bits fixed so far, one of ``levels``."""
    options = F.create_map(*(x for fixed in levels for x in (F.lit(fixed), F.array(*(F.lit(signed(m)) for m in masks(bits, fixed % (1 << 64)))))))
    keyed = prints.select("fp", F.explode(options[F.col("mask")]).alias("mask"))
    keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct() if len(levels) > 1 else keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    counts = materialize(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    return keyed.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts.hint("merge"), ["mask", "key"])


def links(nodes: DataFrame, bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Star links (fp, root) that connect exactly the fingerprints which chains of at most ``bits`` differing bits connect.

    ``nodes``: distinct fingerprints in a column fp.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [linked_stars(np.array(x, np.int64).view(np.uint64), bits) for x in batch.column("prints").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], ["fp", "root"])

    level, fixed, out = nodes.select("fp", F.lit(0).cast("bigint").alias("mask")), [0], None
    for depth in range(3):
        members = materialize(bucket_members(level, bits, fixed), f"buckets{depth}")
        small = members if depth == 2 else members.where(F.col("n") <= bucket)  # in the last round at most 2^12 can be
        found = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("prints")).mapInArrow(stars, "fp bigint, root bigint")
        out = found if out is None else out.unionByName(found)
        level = members.where(F.col("n") > bucket).select("fp", "mask")
        if depth == 2 or level.isEmpty():
            return out.distinct()
        level = materialize(level, f"level{depth}")
        fixed = sorted(r["mask"] for r in level.select("mask").distinct().collect())  # at most the masks of a level
    return out


def components(edges: DataFrame) -> DataFrame:
    """(fp, label): the smallest fingerprint that links reach, for every fingerprint in a link.

    Each round takes the smallest label among neighbours and then the label of that label, so long chains halve. Each
    round's labels are written to the shared folder.
    """
    edges = materialize(edges.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(edges.select(F.col("root").alias("a"), F.col("fp").alias("b"))), "links")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "fp"), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["fp"]).groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "fp").select("fp", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("fp").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(up, "label", "left").select("fp", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        step = materialize(jumped, "labels")
        labels = step.select("fp", "label")
        if step.where("label != old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4) -> DataFrame:
    """The id column, fingerprint (16 hexadecimal digits) and component_id (smallest id reachable) of every row.

    Null and empty texts, and texts of blanks, have fingerprint zero and are linked like any other. Null ids keep their
    fingerprint and links and never are the smallest; a component of null ids has a null component_id. Repeated rows
    are rows of one fingerprint. No rows: no rows. Other columns are ignored.
    """
    prints = materialize(with_fingerprints(docs, text_col, {id_col: "id"}, size=size), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    labels = components(links(nodes, bits))
    linked = labels.join(nodes, "fp")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    lowered = linked.join(smallest, "label").select("fp", "component_id")
    found = nodes.join(lowered, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(found, "fp").select(F.col("id").alias(id_col), shown, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4) -> DataFrame:
    """All columns of one row of each component: that with the smallest id (nulls last), and of repeated rows one.

    The rows are written once with fingerprint and row number, so that the choice and the rows cannot disagree.
    """
    rows = numbered(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    tagged = rows.withColumn("row", F.monotonically_increasing_id())
    marked = materialize(with_fingerprints(tagged, text, {c: c for c in tagged.columns}, "fp", size), "marked")
    rank = F.struct(F.col(key).isNull().alias("x"), F.col(key).alias("id"), "row")
    nodes = materialize(marked.groupBy("fp").agg(F.min(rank).alias("first")), "nodes")
    labels = components(links(nodes, bits))
    groups = nodes.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first"))
    chosen = groups.select("first.row")
    return marked.join(chosen, "row", "left_semi").select(rows.columns).toDF(*docs.columns)
