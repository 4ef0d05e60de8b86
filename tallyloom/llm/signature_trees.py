"""Joining documents by the Jaccard similarity of their word shingles, with signature trees.

A signature tree stands over the sets of a group. Its leaves are the sets, ordered so that like ones lie side by side; a
leaf has a bitmap of its shingles and its size, an inner node the OR of its children's bitmaps and the range of their
sizes. A pair of nodes is walked into only if some pair of sets below could be similar: the size ranges have to allow
it, and the bits that both bitmaps have (plus the shingles that share a bit with another of their set) are the most that
two sets can have in common. A pair of nodes whose sets are all linked already is left out as well. Pairs of leaves that
remain are compared exactly.

Groups come from a prefix filter, so that no two similar sets are in different groups: in any fixed order of all
shingles, two sets of similarity 0.8 share one of their first n - ceil(0.8 n) + 1. The order puts shingles of many
documents last (levels of counts over all documents, kept in bitmaps; a level that is too high would cost time, not
links). The lowest level is exact where it counts: a shingle of two documents is never in it, so a document with only such
shingles in its prefix is like no other and goes no further. Documents that share such a prefix shingle and may be similar by their sizes are tied in the order of sizes, a
few edges for each document; the connected sets are the groups. A large group is parted into overlapping ranges of sizes,
and what is large still is dealt into blocks: first all blocks meet the first one, then the sets outside the largest
linked set meet all others, block by block. Only links that connect something are returned, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..plans.scratch import materialize
from .common import byte_view, col, slices, tasks_for, text_of
from .simhash_pivots import lower_words, shingle_spans

FAN = 8
#: Bits of a leaf's bitmap; a group with fewer shared shingles has a bit for each, and its counts are exact.
BITS = 4096
#: Shingles in a block of a group (8 bytes each; a task holds two blocks).
BLOCK = 1 << 22
#: Shingles that one task counts at a time.
COUNTED = 1 << 22
#: A shingle is of level 1, 2 or 3 if tasks have seen it so often; cells of the bitmap of each level.
LEVELS = (2, 16, 256)
CELLS = 1 << 25
#: A counted cell is the last 36 bits of a shingle: ten of them say the part that is counted together, the others the place in it.
PARTS = 1 << 10
#: Bits of an exponent: a level's bitmap has 4 cells or more for each shingle that reaches it, between these two.
LEAST_CELLS, MOST_CELLS = 20, 29
PAIRS = 1 << 15
#: Rows of three narrow columns, of 16 to 32 bytes, that may be broadcast.
BROADCAST_ROWS = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The different shingles of each text as sorted 61-bit hashes; a text of fewer words is one shingle, one of none an empty set."""
    import xxhash

    data, starts, stops, words = lower_words(*byte_view(texts))
    offsets = np.concatenate([[0], stops + 1]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    _, _, count = shingle_spans(starts, stops, words, size)
    first = np.repeat(np.cumsum(words) - words - (np.cumsum(count) - count), count) + np.arange(count.sum())
    long = np.minimum(np.repeat(words, count), size)  # words in each shingle
    total = mixed(long.astype(np.uint64))
    for k in range(size):
        place = mixed(word + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        inside = long > k
        total[inside] += place[code[first[inside] + k]]
    hashes = (mixed(total) >> np.uint64(3)).astype(np.int64)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(count)[:-1])]


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def vertex(digests: list[bytes]) -> np.ndarray:
    """The first 63 bits of the digests. Equal ones of different sets would only put the two into one group."""
    return np.frombuffer(b"".join(digests), np.int64)[::2] & ((1 << 63) - 1)


def frequent(docs: DataFrame, size: int) -> DataFrame:
    """(token, n): shingles that a task has met in several of the documents that it counted together. ``docs``: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token[n > 1]), pa.array(n[n > 1])], ["token", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                held += sets
                total += sum(map(len, sets))
                if total >= COUNTED:
                    yield counted()
                    total = 0
        yield counted()

    return docs.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def level_bitmaps(counts: DataFrame, levels: tuple[int, ...] = LEVELS, cells: int = CELLS) -> np.ndarray:
    """One row of packed bits for each level: the cells of the shingles whose count reaches it. Of fixed size, whatever the input."""
    cell = F.pmod("token", F.lit(cells)) + 1
    reached = counts.where(F.col("n") >= levels[0]).select(cell.alias("cell"), F.explode(F.array(*(F.when(F.col("n") >= x, F.lit(k)) for k, x in enumerate(levels)))).alias("level")).where("level IS NOT NULL")
    bits = reached.groupBy("level", F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = np.zeros((len(levels), cells // 8), np.uint8)
    for r in bits.collect():  # at most len(levels) * cells bits
        part = np.frombuffer(r["bits"], np.uint8)
        at = (r["part"] - 1) * 4096
        out[r["level"], at : at + len(part)] = part[: cells // 8 - at]
    return out


def packed_places(place: np.ndarray) -> bytes:
    """Sorted different places, as the four bytes of their differences, each kind of byte for itself (which Spark's codec shortens)."""
    return np.diff(place, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_places(held: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def counted_cells(docs: DataFrame, size: int) -> DataFrame:
    """(part, level, n, places): the cells of each part that at least ``LEVELS[level]`` documents have. ``docs``: text.

    A task counts some documents at a time and sends the cells that it met as packed places, not as rows: a few bytes for each shingle.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def counted() -> Iterator[pa.RecordBatch]:
            cell = np.concatenate([*held, np.zeros(0, np.int64)])
            held.clear()
            cell = (cell >> 10 & PARTS - 1) << 26 | (cell >> 20 & 0xFFFF) << 10 | cell & 1023  # the part first
            cell, n = np.unique(cell, return_counts=True)
            cuts = np.searchsorted(cell, np.arange(PARTS + 1) << 26)
            for first in range(0, PARTS, 128):
                parts = [k for k in range(first, first + 128) if cuts[k] < cuts[k + 1]]
                place = [cell[cuts[k] : cuts[k + 1]] & (1 << 26) - 1 for k in parts]
                again = [n[cuts[k] : cuts[k + 1]] for k in parts]
                columns = [pa.array(parts, pa.int32()), pa.array(map(packed_places, place), pa.binary()), pa.array([packed_places(x[m > 1]) for x, m in zip(place, again)], pa.binary()), pa.array([m[m > 1] for m in again], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "places", "often", "times"])

        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                held += sets
                total += sum(map(len, sets))
                if total >= COUNTED:
                    yield from counted()
                    total = 0
        yield from counted()

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, more, times = None, [], [], []

        def done() -> pa.RecordBatch:
            place, n = np.unique(np.concatenate(held), return_counts=True)
            np.add.at(n, np.searchsorted(place, np.concatenate(more)), np.concatenate(times) - 1)
            levels = [place[n >= x] for x in LEVELS]
            for x in (held, more, times):
                x.clear()
            columns = [pa.array([now] * len(LEVELS), pa.int32()), pa.array(range(len(LEVELS)), pa.int32()), pa.array(map(len, levels), pa.int64()), pa.array(map(packed_places, levels), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "level", "n", "places"])

        for batch in batches:
            for part, places, often, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "places", "often", "times"))):
                if part != now:
                    if held:
                        yield done()
                    now = part
                held.append(unpacked_places(places))
                more.append(unpacked_places(often))
                times.append(np.array(counts, np.int64))
        if held:
            yield done()

    sent = docs.mapInArrow(met, "part int, places binary, often binary, times array<bigint>")
    dealt = sent.repartition(tasks_for(sent), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(reached, "part int, level int, n bigint, places binary")


def cell_bitmaps(counted: DataFrame) -> list[np.ndarray]:
    """Packed bits of each level of ``counted_cells``: bit i is that of the shingles with remainder i by the number of bits."""
    total = {r["level"]: r["n"] for r in counted.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    power = [min(max((4 * total.get(k, 0)).bit_length(), LEAST_CELLS), MOST_CELLS) for k in range(len(LEVELS))]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                own = np.zeros(1 << power[row.column("level")[0].as_py()] - 10, bool)
                own[unpacked_places(row.column("places")[0].as_py()) & len(own) - 1] = True
                yield pa.RecordBatch.from_arrays([row.column("part"), row.column("level"), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["part", "level", "bits"])

    out = [np.zeros((1 << p - 20, PARTS, 128), np.uint8) for p in power]
    for r in counted.where("n > 0").mapInArrow(bits, "part int, level int, bits binary").collect():  # at most 2^MOST_CELLS bits a level
        out[r["level"]][:, r["part"]] = np.frombuffer(r["bits"], np.uint8).reshape(-1, 128)
    return [x.ravel() for x in out]


def ordered(shingles: np.ndarray, packed: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """Shingles with their level in the two bits above the hash, sorted: the order of the prefix filter."""
    cells = [(row, shingles % (len(row) * 8)) for row in packed]
    level = sum((row[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(np.int64) for row, cell in cells)
    return np.sort(shingles | level << 61)


def with_prefixes(docs: DataFrame, packed: list[np.ndarray] | np.ndarray, size: int, percent: int, alone: bool = False) -> DataFrame:
    """id, node (digest of the set, null if it is empty), fp (its vertex), n (its size) and prefix. A node's prefix comes once in a task. ``docs``: id, text.

    ``alone``: shingles of the lowest level are known to be in one document; a prefix of such shingles only is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, prefixes = [], []
                sets = shingle_sets(part.column("text"), size)
                for x in sets:
                    node = digest(x) if len(x) else None
                    nodes.append(node)
                    if node is None or node in seen:
                        prefixes.append(None)
                        continue
                    seen.add(node)
                    prefix = ordered(x, packed)[: prefix_length(len(x), percent)]
                    prefixes.append(None if alone and prefix[-1] >> 61 & 3 == 0 else prefix)
                if len(seen) > 1 << 20:
                    seen.clear()
                fps = pa.array(vertex([d or bytes(16) for d in nodes]), mask=np.array([d is None for d in nodes]))
                columns = [part.column("id"), pa.array(nodes, pa.binary()), fps, pa.array([len(x) for x in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "node", "fp", "n", "prefix"])

    schema = docs.select("id").schema.add("node", "binary").add("fp", "long").add("n", "long").add("prefix", ArrayType(LongType()))
    return docs.mapInArrow(run, schema)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two similar sets share one of the first so many shingles of each ..."""
    return n - -(-n * percent // 100) + 1


def smaller_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """... and it is even among the first so many of the one that is not larger."""
    return n - -(-n * 2 * percent // (100 + percent)) + 1


def shared_prefixes(marked: DataFrame, percent: int) -> DataFrame:
    """Edges (fp, root) that tie the rows which share a prefix shingle, have sizes that allow the similarity, and the shingle early in the smaller.

    The rows of a key stand in the order of their sizes. Each goes into the run of the last one before it that has the
    shingle early, and a run is a star; that connects all that such pairs connect. A batch first ties its rows of one key and size and passes on one
    of them, so a key of very many documents has few rows. ``marked``: row, n, prefix.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            times = np.diff(lists.offsets.to_numpy())
            key, n, a = lists.flatten().to_numpy(), np.repeat(batch.column("n").to_numpy(), times), np.repeat(batch.column("row").to_numpy(), times)
            if not len(key):
                continue
            late = np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times) >= smaller_prefix(n, percent)
            place = n * 2 + late
            order = np.lexsort((a, place, key))
            key, place, a = key[order], place[order], a[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
            root = a[np.flatnonzero(new)[np.cumsum(new) - 1]]
            edge = np.unique(np.stack([a, root])[:, ~new], axis=1)
            tied = np.concatenate([np.zeros(int(new.sum()), bool), np.ones(len(edge[0]), bool)])
            spread = mixed((edge[0] ^ edge[1]).view(np.uint64)).view(np.int64)
            columns = [np.concatenate([key[new], spread]), np.concatenate([place[new], np.zeros(len(edge[0]), np.int64)]), np.concatenate([a[new], edge[0]]), np.concatenate([a[new], edge[1]])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:3]), pa.array(columns[3], mask=~tied)], ["key", "place", "a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple = (None, 0, 0)  # key, size and row of the last early one
        root = 0  # the first early row that a chain of ties leads to from it
        for batch in batches:
            tied = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            key, place, a = (batch.column(k).to_numpy()[~tied] for k in ("key", "place", "a"))
            found = [np.stack([batch.column("a").to_numpy()[tied], batch.column("b").drop_null().to_numpy()])]
            if len(key):
                carried = before[0] is not None
                if carried:
                    key, place, a = (np.concatenate([[x], rest]) for x, rest in zip(before, (key, place, a)))
                early = place % 2 == 0
                last = np.maximum.accumulate(np.where(early, np.arange(len(key)), -1))
                last = np.concatenate([[-1], last[:-1]])  # the last early one before each
                near = (last >= 0) & (key[last] == key) & (100 * (place[last] // 2) >= percent * (place // 2))
                head = np.maximum.accumulate(np.where(early & ~near, np.arange(len(key)), -1))  # where the run of ties begins
                first = np.where(head == 0, root if carried else a[0], a[head])
                tie = near & (first != a)
                found.append(np.stack([a[tie], first[tie]]))
                if early.any():
                    end = np.flatnonzero(early)[-1]
                    before, root = (key[end], place[end], a[end]), first[end]
            pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(pairs[0])], ["fp", "root"])

    rows = marked.where("prefix IS NOT NULL").select("row", "n", "prefix").mapInArrow(local, "key bigint, place bigint, a bigint, b bigint")
    dealt = rows.repartition(tasks_for(rows), "key").sortWithinPartitions("key", "place", "a")
    return dealt.mapInArrow(across, "fp bigint, root bigint").distinct()


def vertex_filter(vertices: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Packed bits of the cells in which a vertex lies: of fixed size, so a filter with a few false hits on very large inputs."""
    return level_bitmaps(vertices.select(F.col("fp").alias("token"), F.lit(1).alias("n")), (1,), cells)[0]


def sets_of(docs: DataFrame, wanted: np.ndarray, size: int) -> DataFrame:
    """(fp, node, shingles) of the sets whose vertex may be wanted; a set comes once in a task. ``docs``: text."""
    cells = len(wanted) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [(digest(x), x) for x in shingle_sets(part.column("text"), size) if len(x)]
                fps = vertex([d for d, _ in sets])
                cell = fps % cells
                hits = []
                for k in np.flatnonzero(wanted[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).tolist():
                    if sets[k][0] not in seen:
                        seen.add(sets[k][0])
                        hits.append(k)
                if len(seen) > 1 << 20:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(fps[hits]), pa.array([sets[k][0] for k in hits], pa.binary()), pa.array([sets[k][1] for k in hits], pa.list_(pa.int64()))], ["fp", "node", "shingles"])

    return docs.mapInArrow(run, "fp bigint, node binary, shingles array<bigint>")


class Tree:
    """The signature tree of a group of sets, and its walk."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, label: np.ndarray, percent: int):
        self.percent, self.links = percent, []
        sizes = np.diff(at)
        _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = often > 1
        dense = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = shared[code]
        owner, column = owner[inside], dense[code[inside]]
        kept = np.bincount(owner, minlength=len(sizes))
        lowest = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(lowest, owner, column)
        order = np.lexsort((sizes, lowest))
        self.own = order[kept[order] > 0]  # a set that shares nothing has no links
        self.count = len(self.own)
        if not self.count:
            return
        place = np.empty(len(sizes), np.int64)
        place[self.own] = np.arange(self.count)
        self.width = int(shared.sum())
        bits = min(self.width, BITS)
        self.exact = bits == self.width
        by_set = np.argsort(place[owner], kind="stable")
        self.columns, self.kept = column[by_set], kept[self.own]
        self.starts = np.cumsum(self.kept) - self.kept
        signature = np.zeros((self.count, -(-bits // 64)), np.uint64)
        bit = column % bits
        np.bitwise_or.at(signature, (place[owner], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        slack = self.kept - np.bitwise_count(signature).sum(axis=1, dtype=np.int64)
        self.levels = [(signature, sizes[self.own], sizes[self.own], slack)]
        while len(self.levels[-1][1]) > FAN:
            signature, low, high, slack = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(signature, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))
        self.label = np.unique(label[self.own], return_inverse=True)[1]
        self.relabel()

    def relabel(self) -> None:
        """The range of labels below each node."""
        self.ranges = [(self.label, self.label)]
        for level in self.levels[1:]:
            cut = np.arange(0, len(self.ranges[-1][0]), FAN)
            self.ranges.append((np.minimum.reduceat(self.ranges[-1][0], cut), np.maximum.reduceat(self.ranges[-1][1], cut)))

    def possible(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether some set below x and another below y may be similar and are not linked yet. For exact leaves: whether they are similar."""
        signature, low, high, slack = self.levels[level]
        first, last = self.ranges[level]
        least, most = np.minimum(first[x], first[y]), np.maximum(last[x], last[y])
        out = (least != most) & (high[x] * 100 >= low[y] * self.percent) & (high[y] * 100 >= low[x] * self.percent)
        at = np.flatnonzero(out)
        x, y = x[at], y[at]
        common = np.bitwise_count(signature[x] & signature[y]).sum(axis=1, dtype=np.int64) + np.minimum(slack[x], slack[y])
        common = np.minimum(common, np.minimum(high[x], high[y]))
        out[at] = common * (100 + self.percent) >= (low[x] + low[y]) * self.percent
        return out

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the sets of leaves are similar, by their shingles."""
        pair = np.repeat(np.tile(np.arange(len(x)), 2), self.kept[np.concatenate([x, y])])
        leaf = np.concatenate([x, y])
        at = np.repeat(self.starts[leaf] - (np.cumsum(self.kept[leaf]) - self.kept[leaf]), self.kept[leaf]) + np.arange(len(pair))
        keys = np.sort(pair * self.width + self.columns[at])
        common = np.bincount(keys[1:][keys[1:] == keys[:-1]] // self.width, minlength=len(x))
        sizes = self.levels[0][1]
        return common * (100 + self.percent) >= (sizes[x] + sizes[y]) * self.percent

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Take in the links of similar leaves that connect two labels."""
        up = {}

        def find(i: int) -> int:
            while i in up:
                i = up[i]
            return i

        for a, b in zip(x.tolist(), y.tolist()):
            p, q = find(int(self.label[a])), find(int(self.label[b]))
            if p != q:
                up[max(p, q)] = min(p, q)
                self.links.append((int(self.own[a]), int(self.own[b])))
        if up:
            to = np.arange(self.label.max() + 1)
            for i in up:
                to[i] = find(i)
            self.label = to[self.label]
            self.relabel()

    def walk(self) -> list[tuple[int, int]]:
        """Links (set, set) that connect exactly what similar pairs of sets connect, beyond equal labels."""
        if self.count < 2:
            return self.links
        top = len(self.levels) - 1
        x, y = np.triu_indices(len(self.levels[top][1]))
        todo = [(top, x, y)]
        while todo:
            level, x, y = todo.pop()
            most = PAIRS if level == 0 or top == 0 else PAIRS // FAN**2 * 4
            if len(x) > most:
                todo.append((level, x[most:], y[most:]))
                x, y = x[:most], y[:most]
            if level == 0:
                apart = x != y
                x, y = x[apart], y[apart]
            good = self.possible(level, x, y)
            x, y = x[good], y[good]
            if not len(x):
                continue
            if level == 0:
                if not self.exact:
                    step = max(1, (1 << 21) // max(1, int(self.kept[x].max()) + int(self.kept[y].max())))
                    for at in range(0, len(x), step):
                        a, b = x[at : at + step], y[at : at + step]
                        open_ = self.label[a] != self.label[b]
                        a, b = a[open_], b[open_]
                        if len(a):
                            good = self.similar(a, b)
                            self.join(a[good], b[good])
                else:
                    self.join(x, y)
                continue
            below = len(self.levels[level - 1][1])
            child = np.arange(FAN)
            a = np.repeat(x[:, None] * FAN + child, FAN, axis=1).ravel()
            b = np.tile(y[:, None] * FAN + child, (1, FAN)).ravel()
            real = (a < below) & (b < below) & (a <= b)
            a, b = a[real], b[real]
            near = a == b
            if (~near).any():
                todo.append((level - 1, a[~near], b[~near]))
            if near.any():
                todo.append((level - 1, a[near], b[near]))  # first, so that like neighbours are linked before others are compared
        return self.links


def group_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (fp, root) of nodes inside each group. ``members``: family, part (together a group), node, label (null: none yet), shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> list[tuple[bytes, bytes]]:
            if not held:
                return []
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            nodes = rows.column("node").to_pylist()
            first = sorted({n: k for k, n in reversed(list(enumerate(nodes)))}.values())  # a set may have come from several tasks
            if len(first) < 2:
                return []
            rows, nodes = rows.take(first), [nodes[k] for k in first]
            lists = rows.column("shingles").combine_chunks()
            label = {}
            labels = np.array([label.setdefault(own if own is not None else node, len(label)) for own, node in zip(rows.column("label").to_pylist(), nodes)])
            tree = Tree(lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), labels, percent)
            return [(nodes[a], nodes[b]) for a, b in tree.walk()]

        for batch in batches:
            keys = np.stack([batch.column("family").to_numpy(), batch.column("part").to_numpy()], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            links: list[tuple[bytes, bytes]] = []
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if start < stop:
                    if now != (key := tuple(keys[start].tolist())):
                        links += done()
                        now = key
                    held.append(batch.slice(start, stop - start))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["fp", "root"])
        if links := done():
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["fp", "root"])

    rows = members.select("family", "part", "node", "label", "shingles")
    dealt = rows.repartition(tasks_for(rows), "family", "part").sortWithinPartitions("family", "part")
    return dealt.mapInArrow(run, "fp binary, root binary")


def block_of(node: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(1)), blocks)


def by_size(family: Column, n: Column) -> Column:
    """The two parts of a large family that a set of n shingles belongs to: similar sets are in one class of sizes or in neighbouring ones."""
    own = F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("bigint")
    return F.array(F.xxhash64(family, own), F.xxhash64(family, own + 1))


def connected(edges: DataFrame) -> DataFrame:
    """(fp, label): the smallest vertex that edges (fp, root) reach, for every vertex of an edge.

    Each round merges every vertex into the smallest neighbour of its smallest neighbour and goes on with the edges between
    what is left, so the tables shrink and long chains take few rounds. The rounds' maps are put together from the last.
    """
    both = edges.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(edges.select(F.col("root").alias("a"), F.col("fp").alias("b")))
    left, maps = materialize(both.where("a != b").distinct(), "edges"), []
    while not left.isEmpty():
        low = left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        onward = low.select(F.col("a").alias("low"), F.col("low").alias("label"))
        maps.append(materialize(low.join(onward, "low").select(F.col("a").alias("fp"), "label"), "merged"))
        ends = [maps[-1].select(F.col("fp").alias(x), F.col("label").alias(f"new_{x}")) for x in "ab"]
        moved = left.join(ends[0], "a").join(ends[1], "b").where("new_a != new_b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        left = materialize(moved.distinct(), "edges")
    if not maps:
        return edges.select("fp", F.col("root").alias("label")).limit(0)
    out = maps.pop()
    while maps:
        further = out.select(F.col("fp").alias("label"), F.col("label").alias("last"))
        out = materialize(maps.pop().join(further, "label", "left").select("fp", F.coalesce("last", "label").alias("label")), "labels")
    return out


def joined(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """An inner join; ``right`` of three narrow columns is broadcast if its ``rows`` were counted and are few, and exchanged otherwise."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, key)


def family_links(sets_in: Callable[[DataFrame], DataFrame], families: DataFrame, sizes: DataFrame, block: int, percent: int) -> DataFrame:
    """Links (fp, root) that connect exactly the nodes which chains of similar sets connect.

    ``sets_in``: (fp, node, shingles) for a table of vertices; ``families``: fp, family, large; ``sizes``: family, large, n of
    the members. A family that is not large is one group. A large one is parted by sizes first, and a part of more than
    ``block`` shingles is dealt into blocks.
    """
    keys = lambda n: F.when(F.col("large"), by_size(F.col("family"), n)).otherwise(F.array(F.xxhash64("family")))
    blocks = sizes.where("large").select(F.explode(keys(F.col("n"))).alias("family"), "n").groupBy("family").agg(F.ceil(F.sum("n") / block).cast("bigint").alias("blocks"))
    blocks = materialize(blocks.where("blocks > 1"), "blocks")
    parted = blocks.count()

    def members(fam: DataFrame) -> DataFrame:
        own = joined(sets_in(fam), fam, "fp", fam.count())
        return own.select(F.explode(keys(F.size("shingles"))).alias("family"), "node", "shingles")

    def single(rows: DataFrame, part: Column) -> DataFrame:
        return rows.select("family", part.cast("bigint").alias("part"), "node", F.lit(None).cast("binary").alias("label"), "shingles")

    if not parted:
        return materialize(group_links(single(members(families), F.lit(0)), percent), "links")
    dealt = members(families)
    count = F.broadcast(blocks) if parted <= BROADCAST_ROWS else blocks
    dealt = dealt.join(count, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    own = block_of(F.col("node"), F.col("blocks"))
    meet = F.when((own == 0) & (F.col("blocks") > 1), F.sequence(F.lit(1).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(own))
    links = materialize(group_links(single(dealt.withColumn("part", F.explode(meet)), F.col("part")), percent), "links")
    label = connected(links).withColumnRenamed("fp", "node")
    found = materialize(joined(members(families.where("large")), blocks, "family", parted).drop("blocks"), "large")
    found = found.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    weight = found.groupBy("family", "label").agg(F.sum(F.size("shingles")).alias("n"))
    ranked = weight.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("all_n"))
    count = lambda n: F.ceil(n / block).cast("bigint")
    plan = ranked.select("family", "main", count(F.col("main_n")).alias("m"), count(F.col("all_n") - F.col("main_n")).alias("q")).where("q > 0")
    both = found.join(plan, "family")
    q, m = F.col("q"), F.col("m")
    own = F.when(F.col("label") == F.col("main"), block_of(F.col("node"), m)).otherwise(block_of(F.col("node"), q))
    zero = F.lit(0).cast("bigint")
    # block i of the rest meets the main block j in part i * (m + q) + j, and block k >= i of the rest in part i * (m + q) + m + k
    as_main = F.transform(F.sequence(zero, q - 1), lambda i: i * (m + q) + own)
    as_rest = F.concat(F.transform(F.sequence(zero, m - 1), lambda j: own * (m + q) + j), F.transform(F.sequence(own, q - 1), lambda k: own * (m + q) + m + k), F.transform(F.sequence(zero, own), lambda i: i * (m + q) + m + own))
    parts = F.array_distinct(F.when(F.col("label") == F.col("main"), as_main).otherwise(as_rest))
    more = group_links(both.select("family", F.explode(parts).alias("part"), "node", "label", "shingles"), percent)
    return links.unionByName(materialize(more, "links"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The id column, n_shingles (size of the set) and component_id (smallest id that links reach) of every row.

    Two rows are linked if 100 * shared shingles >= ``percent`` * all shingles of both. Null and empty texts, and texts of
    blanks, have an empty set and are linked with nothing: their component is their own id. Texts of fewer words than
    ``size`` are one shingle. Null ids keep their links and never are the smallest; a component of null ids has a null
    component_id. Repeated rows are rows of one set. No rows: no rows. Other columns are ignored.
    """
    rows = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    texts = rows.select("text")
    packed = cell_bitmaps(materialize(counted_cells(texts, size), "cells"))
    marked = materialize(with_prefixes(rows, packed, size, percent, alone=True).withColumn("row", F.monotonically_increasing_id()), "marked")
    groups = connected(shared_prefixes(marked, percent)).withColumnRenamed("fp", "row").withColumnRenamed("label", "family")
    sizes = materialize(marked.where("prefix IS NOT NULL").select("row", "fp", "n").join(groups, "row").drop("row"), "sizes")
    several = F.min("fp") < F.max("fp")  # rows of one set need no comparison
    large = sizes.groupBy("family").agg((F.sum("n") > block).alias("large"), several.alias("several")).where("several").drop("several")
    families = materialize(sizes.select("fp", "family").distinct().join(large, "family"), "families")
    links = family_links(lambda vertices: sets_of(texts, vertex_filter(vertices), size), families, sizes.join(large, "family"), block, percent)
    nodes = marked.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"))
    linked = connected(links).withColumnRenamed("fp", "node").join(nodes, "node")
    smallest = linked.groupBy("label").agg(F.min("first").alias("least"))
    lowered = linked.join(smallest, "label").select("node", "least")
    found = nodes.join(lowered, "node", "left").select("node", F.coalesce("least", "first").alias("component_id"))
    out = marked.select("id", "node", "n").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
