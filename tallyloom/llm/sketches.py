"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest distinct 63-bit hashes of a text's shingles in rising order. The sketch of a union is
the ``k`` smallest of the sketches' union, so sketches of parts merge in any order. From sketches alone follow estimates
of resemblance (shared shingles by all shingles), containment and the number of distinct shingles; they are exact while
a set has fewer than ``k`` shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, byte_view, col, slices, tasks_for, text_of
from .decontaminate import ODD, mixed, words_of

K = 128
SIZE = 5
TOP = float(1 << 63)


def sketch_texts(texts: pa.Array, k: int = K, size: int = SIZE) -> list[np.ndarray]:
    """Sketches of all texts. A text of fewer than ``size`` words has one shingle, a text without words none."""
    words = words_of(*byte_view(texts))
    count = np.diff(words.at)
    out = []
    keys = words.hashes[: max(0, len(words.hashes) - size + 1)].copy()
    for i in range(1, size):
        keys = keys * ODD + words.hashes[i : i + len(keys)]
    keys = mixed(keys) >> np.uint64(1)
    for a, n in zip(words.at[:-1].tolist(), count.tolist()):
        if n >= size:
            own = keys[a : a + n - size + 1]
            if len(own) > 16 * k:  # all of the k smallest are below this bound unless most shingles are repeats
                low = own[own < np.uint64(4 * k * ((1 << 63) // len(own)))]
                found = np.unique(low)
                own = found if len(found) >= k else own
            out.append(np.unique(own)[:k])
        else:
            key = np.zeros(1, np.uint64)
            for h in words.hashes[a : a + n]:
                key = key * ODD + h
            out.append(mixed(key + np.uint64(n)) >> np.uint64(1) if n else np.zeros(0, np.uint64))
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both; two empty sets are equal."""
    both = merged(a, b, k)
    if not len(both):
        return 1.0
    last = both[-1]
    return len(np.intersect1d(a[a <= last], b[b <= last], assume_unique=True)) / len(both)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * TOP / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too; an empty set is contained."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k))


def document_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SIZE) -> DataFrame:
    """The id column and the sketch (array<bigint>) of every row. Null and empty texts have an empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = [s.astype(np.int64) for s in sketch_texts(part.column("text"), k, size)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "sketch"])

    rows = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sketch array<bigint>").withColumnRenamed("id", id_col)


def merge_sketches(sketched: DataFrame, group: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each value of ``group`` (null is a value): each task keeps k hashes of a group, then they meet."""
    hashes = sketched.select(col(sketched, group).alias("g"), F.explode(col(sketched, sketch_col)).alias("h")).distinct()
    least = hashes.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("r") <= k)
    return least.groupBy(F.col("g").alias(group)).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, copy, id, text) so dealt that the next document in falling order of ids is the next row of the part.

    Ids are cut into ranges at quantiles (as many numbers as ranges come to the driver). The first document of a range
    is also sent, as a copy, to the range before it, whose last document needs it; the very first goes to the last
    range, too. A text crosses the exchange once.
    """
    ranges = 4 * tasks_for(docs)
    rows = docs.select(col(docs, id_col).cast("bigint").alias("id"), text_of(docs, text_col).alias("text"))
    points = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    splits = [float("-inf"), *sorted({float(p) for p in points} or {0.0}), float("inf")]
    spot = Bucketizer(splits=splits, inputCol="place", outputCol="part", handleInvalid="keep")
    dealt = spot.transform(rows.withColumn("place", F.col("id").cast("double"))).withColumn("part", F.coalesce(F.col("part").cast("int"), F.lit(-1)))
    heads = {r["part"]: r["head"] for r in dealt.groupBy("part").agg(F.max("id").alias("head")).collect()}
    falling = sorted(heads, reverse=True)
    cases = {part: falling[i - 1] for i, part in enumerate(falling)}  # the range that needs a copy of this one's head
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("copy"))
    if not heads:
        return dealt.select("part", F.lit(0).alias("copy"), "id", "text")
    sent = F.create_map(*(F.lit(x) for item in cases.items() for x in item))
    first = F.create_map(*(x for p, h in heads.items() for x in (F.lit(p), F.lit(h).cast("bigint"))))
    extra = F.struct(sent[F.col("part")].alias("part"), F.lit(1).alias("copy"))
    places = F.when(F.col("id").eqNullSafe(first[F.col("part")]), F.array(own, extra)).otherwise(F.array(own))
    spread = dealt.select(F.explode(places).alias("at"), "id", "text").select("at.part", "at.copy", "id", "text")
    return spread.repartition(tasks_for(docs), "part").sortWithinPartitions(F.col("part"), F.col("copy"), F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SIZE) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how alike they and the next text's are.

    The edited text: the last third (rounded down) of the code points is replaced by as many of the first ones of the
    next document in falling order of the integer ids; the last is followed by the first. Returns the id column,
    n_chars, edited_sha256, fingerprint and edited_fingerprint (16 hexadecimal digits a hash), near_edited, near_next
    (estimated resemblance) and n_shingles (estimated distinct shingles).

    Null ids come last. Rows of one id are ordered by their texts' hashes. Null and empty texts have an empty fingerprint; two
    empty ones are equal (1), an empty and another one are not (0). A single document follows itself. No rows: no
    rows. Other columns are ignored.
    """
    ordered = with_next(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row whose follower has not come yet: part, copy, id, text, sketch
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                sketches = sketch_texts(piece.column("text"), k, size)
                rows = list(zip(*(piece.column(c).to_pylist() for c in ("part", "copy", "id", "text")), sketches))
                rows = rows if held is None else [held, *rows]
                ready = [(a, b) for a, b in zip(rows, rows[1:]) if a[1] == 0]
                assert all(a[0] == b[0] for a, b in ready), "a range ends with a copy"
                held = rows[-1]
                if ready:
                    edited = [a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3] for a, b in ready]
                    changed = sketch_texts(pa.array(edited, pa.large_string()), k, size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([a[2] for a, _ in ready], pa.int64()),
                            pa.array([len(a[3]) for a, _ in ready], pa.int64()),
                            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                            pa.array([shown(a[4]) for a, _ in ready]),
                            pa.array([shown(c) for c in changed]),
                            pa.array([resemblance(a[4], c, k) for (a, _), c in zip(ready, changed)], pa.float64()),
                            pa.array([resemblance(a[4], b[4], k) for a, b in ready], pa.float64()),
                            pa.array([distinct_count(a[4], k) for a, _ in ready], pa.float64()),
                        ],
                        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"],
                    )

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)
