"""Shuffles, samples, mixtures, slices and batches with reproducible results.

Every random choice is an order or a threshold on ``md5(seed:key)``. ``key`` lists the columns that identify
a row. Positions are exact and global, and never need the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import div
from ..plans.ordering import first_rows, hash_key, hash_unit, hash_wide, identity, running_sum, with_hash_position, with_position
from ..plans.skew import attach_totals, skew_join

TOP_ROWS = 100_000  # up to here "first n" is a top-n that one task may hold

# ---- order ---------------------------------------------------------------------------------------------


def shuffle(df: DataFrame, seed: int | str, key: Sequence[str]) -> DataFrame:
    """All rows in hash order, with their position ``pos``. Sort by ``pos`` to write them in order."""
    return with_hash_position(df, seed, key)


def epoch_order(df: DataFrame, seed: int, epoch: int, key: Sequence[str]) -> DataFrame:
    """Only the plan of an epoch: key and position; join the rows back late."""
    return with_hash_position(df.select(*key), seed + epoch, key)


def pad_or_drop(order: DataFrame, world: int, drop_last: bool, pos: str = "pos") -> DataFrame:
    """Length made a multiple of ``world``: the tail is cut, or the head is repeated behind the end."""
    sized = attach_totals(order, _n=F.count(F.lit(1)))
    n = F.col("_n")
    if drop_last:
        return sized.filter(F.col(pos) < n - n % world).drop("_n")
    missing = F.pmod(-n, F.lit(world))
    # the head may have to be repeated several times when there are fewer rows than workers
    places = F.concat(
        F.array(F.col(pos)),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(max(world - 1, 0))), lambda i: (i < missing) & (i % n == F.col(pos))),
            lambda i: n + i,
        ),
    )
    head = F.when(F.col(pos) < missing, places).otherwise(F.array(F.col(pos)))
    return sized.withColumn(pos, F.explode(head)).drop("_n")


def take(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """First n rows in the given order: a top-n while one task may hold n rows, else cut out of sorted parts."""
    return df.orderBy(*order).limit(n) if n <= TOP_ROWS else first_rows(df, n, order)


def take_fraction(df: DataFrame, fraction: float, order: str) -> DataFrame:
    """First ``floor(fraction * rows)`` rows by the integer column ``order``."""
    placed = attach_totals(with_position(df, order, out="_pos"), _n=F.count(F.lit(1)))
    return placed.filter(F.col("_pos") < F.floor(F.col("_n") * F.lit(fraction))).drop("_pos", "_n")


def iter_slice(df: DataFrame, iteration: int, size: int, order: str) -> DataFrame:
    """Rows ``[iteration * size, iteration * size + size)`` by the integer column ``order``."""
    start = iteration * size
    placed = with_position(df, order, out="_pos")
    return placed.filter((F.col("_pos") >= start) & (F.col("_pos") < start + size)).drop("_pos")


def resume(order: DataFrame, start: int = 0, limit: int | None = None, pos: str = "pos") -> DataFrame:
    """Positions from ``start`` on, below ``limit``."""
    kept = order.filter(F.col(pos) >= start)
    return kept if limit is None else kept.filter(F.col(pos) < limit)


def assign_ranks(order: DataFrame, world: int, batch: int, pos: str = "pos") -> DataFrame:
    """Worker ``rank`` by position modulo ``world`` and global ``batch`` number."""
    return order.withColumn("rank", (F.col(pos) % world).cast("int")).withColumn("batch", div(pos, batch))


# ---- samples --------------------------------------------------------------------------------------------


def sample_rows(df: DataFrame, rate: float, seed: int | str, key: Sequence[str]) -> DataFrame:
    """Each row with probability ``rate``."""
    return df.filter(hash_unit(seed, *key) < rate)


def sample_n(df: DataFrame, n: int, seed: int | str, key: Sequence[str]) -> DataFrame:
    """n rows without replacement: the first n in hash order.

    A small n is a top-n, kept small in every task; a large n is cut by position, so no task sees n rows.
    """
    if n <= TOP_ROWS:
        return df.orderBy(hash_key(seed, *key), *key).limit(n)
    return with_hash_position(df, seed, key, out="_pos").filter(F.col("_pos") < n).drop("_pos")


def limit_docs(df: DataFrame, n: int | None, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Example limit after the fixed shuffle of an evaluation run; ``None`` keeps all."""
    return df if n is None else sample_n(df, n, seed, key)


def repeat(df: DataFrame, k: int, out: str = "copy") -> DataFrame:
    """Every row k times, numbered from 0."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) if k > 0 else df.withColumn(out, F.lit(0)).limit(0)


def sample_to(df: DataFrame, n: int, seed: int | str, key: Sequence[str]) -> DataFrame:
    """Exactly n rows: a short table is repeated until it has n, then sampled in hash order."""
    sized = attach_totals(df, _n=F.count(F.lit(1)))
    copies = F.sequence(F.lit(0), F.greatest(F.ceil(F.lit(n) / F.col("_n")) - 1, F.lit(0)).cast("int"))
    repeated = sized.withColumn("copy", F.explode(copies)).drop("_n")
    return sample_n(repeated, n, seed, [*key, "copy"])


def resample_batches(df: DataFrame, m: int, size: int, seed: int | str, order: str) -> DataFrame:
    """m batches of ``size`` rows drawn with replacement (columns ``batch``, ``slot``)."""
    rows = with_position(df, order, out="_pos")
    draws = df.sparkSession.range(m * size).select(
        div("id", size).alias("batch"), (F.col("id") % size).alias("slot"),
        hash_wide(seed, "id").alias("_draw"),
    )
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    placed = draws.crossJoin(F.broadcast(total)).withColumn("_pos", F.col("_draw") % F.col("_n")).drop("_draw", "_n")
    return placed.join(rows, "_pos").drop("_pos")


def batches(df: DataFrame, n: int, order: str, out: str = "batch") -> DataFrame:
    """Fixed-size batch number by position; the last batch may be short."""
    return with_position(df, order, out="_pos").withColumn(out, div("_pos", n)).drop("_pos")


def dedup_requests(df: DataFrame, request: Sequence[str], length: Column, row: str) -> tuple[DataFrame, DataFrame]:
    """Distinct requests, longest first (``request_pos``), and the map from every row to its request.

    Requests are equal if every field is, null being a value of its own. Equal requests are counted before the
    exchange, so a request with many copies stays cheap. A null length counts as 0.
    """
    order = F.md5(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in request]))
    keyed = df.withColumn("_key", F.concat(order, identity(*request))).withColumn("_len", F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint")))
    distinct = keyed.groupBy("_key", "_len").agg(*[F.min(c).alias(c) for c in request])
    # longest first: count per length, then hash order inside a length
    sizes = distinct.groupBy("_len").agg(F.count(F.lit(1)).alias("_n"))
    span = 1 << 40
    before = running_sum(sizes.withColumn("_rev", F.lit(span) - F.col("_len")), "_n", "_rev", out="_before").select(
        "_len", "_before"
    )
    bucketed = distinct.withColumn("_b", F.substring("_key", 1, 3))
    cells = bucketed.groupBy("_len", "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_len").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_len", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_len", "_b").orderBy("_key")
    numbered = bucketed.join(offsets, ["_len", "_b"]).join(before, "_len").withColumn(
        "request_pos", (F.col("_before") + F.col("_off") + F.row_number().over(local) - 1).cast("bigint")
    )
    requests = numbered.select("request_pos", *request)
    owners = keyed.select(row, "_key").join(numbered.select("_key", "request_pos"), "_key").select(row, "request_pos")
    return requests, owners


def keep_latest(df: DataFrame, n: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The newest n rows, overall or per key; older rows leave first."""
    if not by and n <= TOP_ROWS:
        return df.orderBy(F.desc(order)).limit(n)
    if not by:
        placed = attach_totals(with_position(df, order, out="_pos"), _n=F.count(F.lit(1)))
        return placed.filter(F.col("_pos") >= F.col("_n") - n).drop("_pos", "_n")
    newest = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


# ---- mixtures -------------------------------------------------------------------------------------------


def weight_table(df: DataFrame, weights: Mapping[str, float], source: str) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()], f"{source} string, weight double")


def mix(df: DataFrame, weights: Mapping[str, float], seed: int | str, source: str, shard: Sequence[str]) -> DataFrame:
    """Shards per source by weight: 0 drops, below 1 keeps ``floor(n * w)`` in hash order, above 1 repeats
    ``floor(w)`` times. Sources without a weight are left out."""
    picked = df.join(F.broadcast(weight_table(df, weights, source)), source).filter(F.col("weight") > 0)
    sizes = picked.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_hash_position(picked, seed, shard, by=[source], out="_pos").join(F.broadcast(sizes), source)
    kept = placed.filter((F.col("weight") >= 1) | (F.col("_pos") < F.floor(F.col("_n") * F.col("weight"))))
    copies = F.greatest(F.floor(F.col("weight")), F.lit(1)).cast("int")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_n", "_pos", "weight")


def take_token_budget(
    df: DataFrame, ratio: float, seed: int | str, source: str, shard: Sequence[str], tokens: str
) -> DataFrame:
    """Shuffled shards per source until their tokens reach ``ratio`` of the source; the crossing shard stays."""
    placed = with_hash_position(df, seed, shard, by=[source], out="_pos")
    running = running_sum(placed, tokens, "_pos", [source], "_before")
    totals = df.groupBy(source).agg(F.sum(tokens).alias("_total"))
    joined = skew_join(running, totals, [source])
    return joined.filter(F.col("_before") < F.lit(ratio) * F.col("_total")).drop("_pos", "_total").withColumnRenamed(
        "_before", "tokens_before"
    )


def interleave(
    df: DataFrame, probs: Mapping[str, float], seed: int | str, source: str, order: str, stop: str = "first",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Draw sources by probability and take their rows in order; ``pos`` is the place in the result.

    ``stop="first"`` ends with the last row of the source that runs out first, ``"all"`` when every source has
    run out (a source that is through starts again).
    """
    if stop not in ("first", "all"):
        raise ValueError(f"unknown stop rule {stop}")
    spark = df.sparkSession
    probs = {s: p for s, p in probs.items() if p > 0}  # a source that is never drawn takes no part
    names = list(probs)
    if not names:
        raise ValueError("no source has a probability above 0")
    kept = df.filter(F.col(source).isin(names)).select(*(columns or df.columns))
    sizes = {r[0]: r[1] for r in kept.groupBy(source).count().collect()}  # one number per named source
    if any(sizes.get(s, 0) == 0 for s in names):
        raise ValueError("every source needs rows")
    total = sum(probs.values())
    edges, at = [], 0.0
    for s in names:
        at += probs[s] / total
        edges.append((s, at))

    def drawn(length: int) -> DataFrame:
        u, pick = hash_unit(seed, "pos"), F.lit(edges[-1][0])
        for s, edge in reversed(edges[:-1]):
            pick = F.when(u < edge, F.lit(s)).otherwise(pick)
        draws = spark.range(length).select(F.col("id").alias("pos")).withColumn(source, pick)
        return running_sum(draws, F.lit(1), "pos", [source], "_nth")

    def last_needed(draws: DataFrame) -> dict[str, int]:
        """Place where each source gives its last row (absent when the draws are too few)."""
        lengths = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
        ends = draws.filter(F.col("_nth") == F.element_at(lengths, F.col(source)) - 1)
        return {r[source]: r["pos"] for r in ends.select(source, "pos").collect()}

    decide = min if stop == "first" else max
    length = int(decide(sizes[s] / (probs[s] / total) for s in names) * 1.1) + 64
    while True:
        draws = drawn(length)
        ends = last_needed(draws)
        # "first" needs one end, which is final because every earlier place is drawn; "all" needs every end
        if ends and (stop == "first" or len(ends) == len(names)):
            break
        length *= 2
    cut = decide(ends.values())
    lengths = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    wanted = draws.filter(F.col("pos") <= cut).withColumn(
        "_row", F.col("_nth").cast("bigint") % F.element_at(lengths, F.col(source))
    )
    rows = with_position(kept, order, [source], out="_row")
    return wanted.drop("_nth").join(rows, [source, "_row"]).drop("_row")
