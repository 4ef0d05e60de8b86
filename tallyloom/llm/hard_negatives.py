"""Hard negatives by lists that a cluster of anchors shares.

Anchors are put into clusters by direction. For a cluster with centre c and largest angle b between c and a member, no
member of length 1 can score more with a candidate v than |v| cos(max(0, angle(v, c) - b)). Candidates are sorted by
this bound once for a cluster, and every member walks that one list: it stops when its length times the next bound is
below what could still enter its result, so what it returns is certified to be complete and exact.

Candidates are dealt into shards of bounded bytes by a hash of their row number, and each anchor is sent to every shard;
in a task one shard's candidates lie in memory and the anchors stream past, a cluster after the other. What the shards
find (at most k for each wish) meets by anchor and is ordered again. Two such walks are needed: the first finds the
positives, whose scores bound the second one's window.

Centres are fitted on at most ``SAMPLE`` anchors, chosen by a hash. They only decide how soon a walk ends, never what it
returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import div
from ..plans.scratch import materialize
from .common import col, tasks_for

SAMPLE = 4096
CLUSTERS = 64
SHARD_BYTES = 64 << 20
#: A shard gets at least so many rows before small tables are cut further for the sake of more tasks.
SHARD_ROWS = 1024
BLOCK = 512
FAR = (1 << 63) - 1
#: Sums of squares from here on are out of range: a hundred times a score has to fit into a long.
MOST = 1 << 55


def matrix(lists: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), kind)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column) -> DataFrame:
    """row, id, label, anchor and v (floor(256 x) of every component) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            squares = np.bincount(owner, np.where(np.isfinite(x), x * x, np.inf), minlength=batch.num_rows)
            good = squares < MOST
            v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)), pa.array(x[good[owner]].astype(np.int32)))
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in ("row", "id", "label", "anchor")), v], ["row", "id", "label", "anchor", "v"])

    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        col(vectors, id_col).cast("bigint").alias("id"),
        col(vectors, label_col).cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        col(vectors, vec_col).cast("array<double>").alias("v"),
    ).where(F.col("label").isNotNull() & F.col("v").isNotNull())
    return rows.mapInArrow(run, "row bigint, id bigint, label bigint, anchor boolean, v array<int>")


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros(x.shape), where=length > 0)


def fit_centres(sample: np.ndarray, clusters: int = CLUSTERS, rounds: int = 10) -> np.ndarray:
    """Unit vectors in the middle of clusters of directions; one zero vector if there is no sample."""
    directions = unit(sample.astype(np.float64))
    if not len(directions):
        return np.zeros((1, sample.shape[1]))
    k = max(1, min(clusters, len(directions) // 8))
    centres = directions[np.linspace(0, len(directions) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(directions @ centres.T, axis=1)
        sums = np.zeros(centres.shape)
        np.add.at(sums, nearest, directions)
        centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, unit(sums), centres)
    return centres


def with_clusters(anchors: DataFrame, centres: np.ndarray) -> DataFrame:
    """All columns, cluster (the centre of the smallest angle) and angle."""
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            directions = unit(matrix(batch.column("v"), centres.shape[1]).astype(np.float64))
            cosine = directions @ centres.T
            nearest = np.argmax(cosine, axis=1) if batch.num_rows else np.zeros(0, int)
            angle = np.arccos(np.clip(cosine[np.arange(batch.num_rows), nearest], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angle)], [*names, "cluster", "angle"])

    return anchors.mapInArrow(run, anchors.select("*").schema.add("cluster", "integer").add("angle", "double"))


class Shard:
    """One shard's candidates, and the list of the cluster whose anchors pass."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids, missing))  # in a tie the smaller id comes first, null last
        self.ids, self.missing, self.labels, self.v = ids[order], missing[order], labels[order], v[order]
        self.lengths = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1)) if len(ids) else np.zeros(0)
        self.cluster = None

    def sort_for(self, cluster: int, centre: np.ndarray, radius: float) -> None:
        """The list of a cluster: candidates by falling upper bound for members of length 1."""
        if self.cluster == cluster:
            return
        cosine = np.divide(self.v @ centre, self.lengths, out=np.ones(len(self.ids)), where=self.lengths > 0)
        bound = self.lengths * np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - radius))
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]
        self.cluster = cluster

    def walk(self, anchors: dict[str, np.ndarray], same: bool, k: int, examined: list[int] | None = None) -> tuple[np.ndarray, ...]:
        """(anchor, wish, candidate, score): for each wish the first k candidates with lo <= score <= hi.

        ``anchors``: v, id, label and, for each anchor and wish, lo and hi (an empty window has lo > hi).
        """
        wishes = anchors["lo"].shape[1]
        length = np.sqrt((anchors["v"].astype(np.float64) ** 2).sum(axis=1))
        exact = float(length.max(initial=0)) * float(self.lengths.max(initial=0)) < 2.0**52
        mine = anchors["v"].astype(np.float64) if exact else anchors["v"].astype(np.int64)
        need = np.where(anchors["lo"] <= anchors["hi"], anchors["lo"], FAR)  # a smaller score cannot enter
        best = [np.zeros((0, 3), np.int64) for _ in range(wishes)]  # anchor, score, candidate
        at, step, end = 0, 64, len(self.ids)
        while at < end:
            reach = length * (self.bound[at] + 1e-9 * abs(self.bound[at])) + 1e-3
            active = np.flatnonzero(reach >= need.min(axis=1))
            if not len(active):
                break
            here = self.order[at : at + step]
            if examined is not None:
                examined.append(len(active) * len(here))
            theirs = self.v[here].astype(mine.dtype)
            score = mine[active] @ theirs.T
            score = np.rint(score).astype(np.int64) if exact else score
            fits = (anchors["label"][active, None] == self.labels[None, here]) == same
            if same:
                fits &= (anchors["id"][active, None] != self.ids[None, here]) | self.missing[None, here]
            for w in range(wishes):
                a, c = np.nonzero(fits & (score >= need[active, w][:, None]) & (score <= anchors["hi"][active, w][:, None]))
                if len(a):
                    new = np.concatenate([best[w], np.stack([active[a], score[a, c], here[c]], axis=1)])
                    new = new[np.lexsort((new[:, 2], -new[:, 1], new[:, 0]))]
                    first = np.searchsorted(new[:, 0], new[:, 0])
                    best[w] = new[np.arange(len(new)) - first < k]
                    owner, n = np.unique(best[w][:, 0], return_counts=True)
                    full = n == k
                    need[owner[full], w] = best[w][np.cumsum(n)[full] - 1, 1]
            at, step = at + step, min(2 * step, 1024)
        wish = np.repeat(np.arange(wishes), [len(b) for b in best])
        found = np.concatenate(best)
        return found[:, 0], wish, found[:, 2], found[:, 1]


def walked(anchors: DataFrame, candidates: DataFrame, shards: int, width: int, centres: np.ndarray, radii: dict[int, float], same: bool, k: int) -> DataFrame:
    """(anchor, wish, id, score): for each anchor (its row) and wish the first k of every shard. ``anchors``: row, id, label, v, cluster, lo, hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state: tuple = (None, None, None)  # shard, kind, cluster
        shard: Shard | None = None

        def done() -> Iterator[pa.RecordBatch]:
            """Take in what is held: candidates of a shard, or a block of anchors of one cluster."""
            nonlocal shard, held
            if not held:
                return
            rows, held = pa.Table.from_batches(held), []
            ids = rows.column("id").combine_chunks()
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            v, label = matrix(rows.column("v"), width, np.int32), rows.column("label").to_numpy()
            if state[1] == 0:
                shard = Shard(ids.fill_null(FAR).to_numpy(), missing, label, v)
            elif shard is not None:
                wishes = int(rows.column("lo").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max())
                empty = np.arange(rows.num_rows)
                lo, hi = (np.full((rows.num_rows, wishes), fill) for fill in (1, 0))
                for name, out in (("lo", lo), ("hi", hi)):
                    lists = rows.column(name).combine_chunks()
                    n = np.diff(lists.offsets.to_numpy())
                    out[np.repeat(empty, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(zero_copy_only=False)
                shard.sort_for(state[2], centres[state[2]], radii[state[2]])
                a, wish, c, score = shard.walk({"v": v, "id": ids.fill_null(FAR).to_numpy(), "label": label, "lo": lo, "hi": hi}, same, k)
                if len(a):
                    own = pa.array(shard.ids[c], mask=shard.missing[c])
                    yield pa.RecordBatch.from_arrays([pa.array(rows.column("row").to_numpy()[a]), pa.array(wish.astype(np.int32)), own, pa.array(score)], ["anchor", "wish", "id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("shard", "kind", "cluster")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if start == stop:
                    continue
                now = tuple(keys[start].tolist())
                if now != state:
                    yield from done()
                    if now[0] != state[0]:
                        shard = None
                    state = now
                for at in range(start, stop, BLOCK):
                    held.append(batch.slice(at, min(BLOCK, stop - at)))
                    if now[1] == 1 and sum(b.num_rows for b in held) >= BLOCK:
                        yield from done()
        yield from done()

    nothing = F.array().cast("array<bigint>")
    theirs = candidates.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(0).alias("cluster"), "row", "id", "label", "v", nothing.alias("lo"), nothing.alias("hi"))
    ours = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "cluster", "row", "id", "label", "v", "lo", "hi")
    dealt = theirs.unionByName(ours).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "cluster", "row")
    return dealt.mapInArrow(run, "anchor bigint, wish int, id bigint, score bigint")


def first_of(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k of each key by score, then id, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, clusters: int = CLUSTERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchor`` is true.

    An anchor's positives are its first other rows of the same label; a positive's negatives are the first rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score. First means by score (integer
    inner product of floor(256 x)) from the highest, ties by smaller id, null ids last. An anchor without positives, and
    a positive without negatives, give no row.

    Rows with a null label, a null vector or a component that is null or not finite take no part, nor do rows whose
    scores might not fit into a long (sum of squares of floor(256 x) of 2^55 or more). A shorter vector counts as filled
    up with zeros. ``anchor`` being null means false. Repeated rows are rows of their own, but a row with the anchor's
    id is never its positive; an anchor that stands twice is answered twice. No rows: no rows. Other columns are ignored.
    """
    rows = materialize(integer_rows(vectors, id_col, vec_col, label_col, anchor), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, 1)
    shards = max(-(-n * width * 4 // SHARD_BYTES), min(tasks_for(rows), n // SHARD_ROWS), 1)
    mine = rows.where("anchor").select("row", "id", "label", "v")
    sample = mine.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").toArrow()
    centres = fit_centres(matrix(sample.column("v").combine_chunks(), width) if sample.num_rows else np.zeros((0, width)), clusters)
    mine = materialize(with_clusters(mine, centres), "anchors")
    radii = {r["cluster"]: r["radius"] + 1e-7 for r in mine.groupBy("cluster").agg(F.max("angle").alias("radius")).collect()}  # at most CLUSTERS rows
    search = lambda asking, same, k: walked(asking, rows, shards, width, centres, radii, same, k)
    bound = lambda x: F.array(F.lit(x).cast("bigint"))
    asking = mine.select("row", "id", "label", "v", "cluster", bound(-FAR).alias("lo"), bound(FAR - 1).alias("hi"))
    liked = materialize(first_of(search(asking, True, positives), positives, "anchor").select("anchor", (F.col("rank") - 1).alias("wish"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = liked.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("wish", "positive_score"))).alias("s"))  # at most ``positives`` for an anchor
    down = lambda x: div(x - F.pmod(x, F.lit(100)), 100)  # noqa: E731  floor(x / 100) in whole numbers
    lowest = lambda s: -down(-s["positive_score"] * low)
    highest = lambda s: down(s["positive_score"] * high)
    asking = mine.join(windows.withColumnRenamed("anchor", "row"), "row").select("row", "id", "label", "v", "cluster", F.transform("s", lowest).alias("lo"), F.transform("s", highest).alias("hi"))
    hard = first_of(search(asking, False, negatives), negatives, "anchor", "wish")
    named = hard.join(liked, ["anchor", "wish"]).join(mine.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
