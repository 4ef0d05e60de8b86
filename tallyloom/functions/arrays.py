"""Functions on token arrays: runs, padding, masks, returns, windows. One row, one array; no shuffle."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, indices, let, running_starts

DOUBLES = "array<double>"
INTS = "array<int>"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def as_mask(mask: Column) -> Column:
    """Booleans or 0/1 numbers to 0.0/1.0."""
    return F.transform(mask, lambda m: m.cast("double"))


def masked(values: Column, mask: Column | None) -> Column:
    if mask is None:
        return values
    return F.zip_with(values, mask, lambda v, m: v * m.cast("double"))


# ---- runs --------------------------------------------------------------------------------------------


def end_of_first_true(flags: Column) -> Column:
    """Length of the leading run of trues."""
    at = F.array_position(flags, F.lit(False)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(flags))


def start_of_last_true(flags: Column) -> Column:
    """Start of the trailing run of trues, -1 when the last element is false."""
    run = end_of_first_true(F.reverse(flags))
    return F.when(run > 0, F.size(flags) - run).otherwise(F.lit(-1))


RUNS = "array<struct<start:int,end:int,period:int,times:int>>"


def _periods(x: Column, max_period: int, min_period: int) -> Column:
    """Periods that an array has room for three times."""
    longest = F.least(F.lit(max_period), F.floor(F.size(x) / 3).cast("int"))
    return F.when(longest >= min_period, F.sequence(F.lit(min_period), longest)).otherwise(F.array().cast(INTS))


def _same_as_before(x: Column, p: Column) -> Column:
    """A text of 1 and 0: whether an element equals the one a period before it, from place ``p`` on."""
    n = F.size(x)
    flags = F.zip_with(
        F.slice(x, p + 1, n - p), F.slice(x, F.lit(1), n - p), lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0"))
    )
    return F.array_join(flags, "")


def _may_run(x: Column, p: Column, copies: int) -> Column:
    """False where no run of ``copies`` periods can be: it would hold as many neighbouring multiples of the period."""
    places = indices(F.floor((F.size(x) - 1) / p).cast("int") - copies + 1)

    def same(k: Column, i: int) -> Column:
        return F.get(x, (k + i) * p) == F.get(x, (k + i + 1) * p)

    return F.coalesce(F.exists(places, lambda k: reduce(Column.__and__, [same(k, i) for i in range(copies)])), F.lit(False))


def periodic_runs(tokens: Column, max_period: int, min_period: int = 1) -> Column:
    """Stretches that repeat with a period, at least three times.

    A stretch is a maximal run of ``x[i] = x[i-p]``. It is reported only when the run covers a whole aligned
    block ``[kp, (k+1)p)``; the end is exclusive and the first copy belongs to the stretch.
    """

    def of_period(x: Column, p: Column) -> Column:
        def runs(pieces: Column) -> Column:
            starts = running_starts(F.transform(pieces, F.length))
            spans = F.zip_with(
                pieces, starts,
                lambda piece, at: F.struct(
                    F.startswith(piece, F.lit("1")).alias("same"), (at + p).alias("s"), (at + p + F.length(piece)).alias("e")
                ),
            )
            kept = F.filter(
                spans,
                lambda r: r["same"] & (r["e"] - r["s"] >= 2 * p)
                & ((F.ceil(r["s"] / p).cast("int") + 1) * p <= r["e"]),
            )
            return F.transform(
                kept,
                lambda r: F.struct(
                    (r["s"] - p).alias("start"), r["e"].alias("end"), p.alias("period"),
                    F.floor((r["e"] - r["s"] + p) / p).cast("int").alias("times"),
                ),
            )

        none = F.array().cast(RUNS)

        def search(flags: Column) -> Column:
            # three copies need a run of two periods; most arrays have none
            long_enough = F.contains(flags, F.repeat(F.lit("1"), 2 * p))
            return F.when(long_enough, let(F.regexp_extract_all(flags, F.lit("1+|0+"), 0), runs)).otherwise(none)

        return F.when(_may_run(x, p, 2), let(_same_as_before(x, p), search)).otherwise(none)

    def of_all(x: Column) -> Column:
        return F.flatten(F.transform(_periods(x, max_period, min_period), lambda p: of_period(x, p)))

    return let(tokens, of_all)


def repeats_too_often(tokens: Column, max_count: int = 32, max_period: int = 13, min_period: int = 1) -> Column:
    """True when some periodic stretch of ``periodic_runs`` repeats ``max_count`` times or more.

    That is a run of ``max_count - 1`` periods, and a run of two always covers an aligned block, so the stretches need not be listed.
    """
    copies = max(max_count - 1, 2)

    def runs(x: Column, p: Column) -> Column:
        found = F.contains(_same_as_before(x, p), F.repeat(F.lit("1"), copies * p))
        return F.when(_may_run(x, p, min(copies, 4)), found).otherwise(F.lit(False))

    return let(tokens, lambda x: F.exists(_periods(x, max_period, min_period), lambda p: runs(x, p)))


# ---- cutting and padding -----------------------------------------------------------------------------


def truncate(tokens: Column, limit: int, side: str = "right") -> Column:
    """Keep ``limit`` tokens; ``side`` names the end that loses tokens."""
    if side == "right":
        return F.slice(tokens, 1, limit)
    return let(tokens, lambda x: F.slice(x, F.greatest(F.size(x) - limit + 1, F.lit(1)), F.lit(limit)))


def add_eos(tokens: Column, eos: int) -> Column:
    """End token appended unless it is already last."""
    return F.when(F.try_element_at(tokens, F.lit(-1)).eqNullSafe(F.lit(eos)), tokens).otherwise(
        F.concat(tokens, F.array(F.lit(eos)))
    )


def pad(values: Column, length: Column | int, fill: Column, side: str = "right") -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    filler = F.array_repeat(fill, F.greatest(length - F.size(values), F.lit(0)))
    return F.concat(values, filler) if side == "right" else F.concat(filler, values)


def attention_mask(tokens: Column, pad_id: int) -> Column:
    return F.transform(tokens, lambda t: (t != pad_id).cast("int"))


def doc_lengths(tokens: Column, eos: int) -> Column:
    """Distances between end tokens, plus the open tail when the array does not end in one."""

    def lengths(x: Column) -> Column:
        ends = F.filter(indices(F.size(x)), lambda i: F.element_at(x, i + 1) == eos)
        last = F.size(x) - 1
        stops = F.when(F.element_at(x, -1) == eos, ends).otherwise(F.concat(ends, F.array(last)))
        return let(
            stops, lambda e: F.zip_with(e, F.concat(F.array(F.lit(-1)), F.slice(e, F.lit(1), F.size(e) - 1)), lambda a, b: a - b)
        )

    return let(tokens, lengths)


def rollout_masks(tokens: Column, input_len: Column, eos: int, pad_id: int) -> Column:
    """``struct<sequence, attention_mask, action_mask>`` of a padded prompt + response array.

    The end token is put behind the last real token (or over the last slot of a full array); attention
    covers the first real token to that slot; an action is masked in when its state token is real, the
    first action always.
    """

    def real(t: Column) -> Column:
        return (t != eos) & (t != pad_id)

    def masks(x: Column) -> Column:
        flags = F.transform(x, real)
        n = F.size(x)
        tail = F.array_position(F.reverse(flags), F.lit(True)).cast("int") - 1  # -1 without any real token
        end = n - F.greatest(tail, F.lit(1))
        first = F.greatest(F.array_position(flags, F.lit(True)).cast("int") - 1, F.lit(0))
        seq = F.transform(x, lambda t, i: F.when(i == end, F.lit(eos)).otherwise(t))
        attention = F.transform(x, lambda t, i: ((i >= first) & (i <= end)).cast("int"))

        def actions(s: Column) -> Column:
            states = F.slice(s, input_len, n - input_len)
            return F.transform(states, lambda t, i: ((i == 0) | real(t)).cast("int"))

        return let(
            seq,
            lambda s: F.struct(
                s.alias("sequence"), attention.alias("attention_mask"), actions(s).alias("action_mask")
            ),
        )

    return let(tokens, masks)


def strip_padding(sequence: Column, attention: Column, action: Column, per_action: Column) -> Column:
    """``struct<sequence, per_action>`` without the left padding and the masked-out tail."""
    right = F.size(F.filter(action, lambda m: m == 0))
    left = F.greatest(F.array_position(attention, F.lit(1)).cast("int") - 1, F.lit(0))
    return F.struct(
        F.slice(sequence, left + 1, F.greatest(F.size(sequence) - left - right, F.lit(0))).alias("sequence"),
        F.slice(per_action, F.lit(1), F.greatest(F.size(per_action) - right, F.lit(0))).alias("per_action"),
    )


def unpack(values: Column, lengths: Column) -> Column:
    """Cut a packed array into arrays of the given lengths."""
    return F.zip_with(running_starts(lengths), lengths, lambda s, n: F.slice(values, s + 1, n))


def position_ids(samples: Column) -> Column:
    """Positions that restart at every sample number of a packed mask; padding (0) gets 0."""

    def count(arrays: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.list_value_length(arrays).fill_null(0)).astype(np.int64)
        ends, flat = np.cumsum(sizes), arrays.flatten()
        number, at = np.asarray(flat.fill_null(0)), np.arange(len(flat))
        begins = np.ones(len(flat), bool)
        begins[1:] = number[1:] != number[:-1]
        begins |= np.asarray(flat.is_null())
        begins[(ends - sizes)[sizes > 0]] = True
        place = at - np.maximum.accumulate(np.where(begins, at, 0))
        values = pa.array(np.where(number == 0, 0, place).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, mask=arrays.is_null())

    return F.arrow_udf(count, INTS)(samples)


def process_labels(tokens: Column, labels: Column, placeholder: int, ignore: int = -100) -> Column:
    """The k-th label at the k-th placeholder, ``ignore`` elsewhere; surplus labels are cut."""

    def place(x: Column) -> Column:
        flags = F.transform(x, lambda t: (t == placeholder).cast("int"))
        nth = running_starts(flags)
        return F.zip_with(
            flags, nth,
            lambda f, k: F.when(f == 1, F.coalesce(F.get(labels, k), F.lit(ignore))).otherwise(F.lit(ignore)),
        )

    return let(tokens, place)


def rolling_windows(tokens: Column, max_len: int, context: int, prefix: int, disjoint: bool = False) -> Column:
    """``array<struct<input, pred>>`` for scoring a long document.

    The first window predicts up to ``max_len`` tokens behind a prefix token; later windows predict
    ``max_len - context + 1`` new tokens each and see the tokens before them as context. The disjoint form
    cuts the predicted tokens out of the input.
    """
    if not 1 <= context <= max_len:
        raise ValueError("context must lie between 1 and max_len")
    step = max_len - context + 1

    def window(inp: Column, pred: Column) -> Column:
        if disjoint:
            inp = F.slice(inp, F.lit(1), F.size(inp) - F.size(pred) + 1)
        return F.struct(inp.alias("input"), pred.alias("pred"))

    def windows(x: Column) -> Column:
        n = F.size(x)
        first = F.least(F.lit(max_len), n)
        head = window(
            F.concat(F.array(F.lit(prefix)), F.slice(x, F.lit(1), first - 1)), F.slice(x, F.lit(1), first)
        )
        more = F.ceil((n - first) / step).cast("int")

        def later(k: Column) -> Column:
            done = first + k * step
            size = F.least(n - done, F.lit(step))
            return window(
                F.slice(x, done + size - max_len, F.lit(max_len)), F.slice(x, done + 1, size)
            )

        return F.when(n > 0, F.concat(F.array(head), F.transform(indices(more), later)))

    return let(tokens, windows)


# ---- rewards and advantages --------------------------------------------------------------------------


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values that the mask keeps; null if it keeps none."""
    return F.try_divide(total(masked(values, mask)), total(as_mask(mask)))


def masked_normalize(values: Column, mask: Column, eps: float = 1e-8) -> Column:
    """Masked values minus their masked mean, over the masked population deviation (variance at least eps);
    nulls if the mask keeps none."""

    def normal(v: Column, m: Column) -> Column:
        count = total(as_mask(m))
        mean = F.try_divide(total(v), count)

        def scaled(mu: Column) -> Column:
            var = total(F.zip_with(v, m, lambda x, w: (x - mu) * (x - mu) * w.cast("double")))
            return let(F.greatest(F.try_divide(var, count), F.lit(eps)), lambda s: F.transform(v, lambda x: (x - mu) / F.sqrt(s)))

        return let(mean, scaled)

    return let(mask, lambda m: let(masked(values, m), lambda v: normal(v, m)))


def approx_kl(logp: Column, base: Column, estimator: str = "k1", mask: Column | None = None) -> Column:
    """Per-token divergence estimate from two log-probabilities of the same token."""
    forms = {
        "k1": lambda d: d,
        "k2": lambda d: d * d / 2.0,
        "k3": lambda d: F.exp(-d) - 1.0 + d,
    }
    if estimator not in forms:
        raise ValueError(f"unknown estimator {estimator}")
    diff = masked(F.zip_with(logp, base, lambda a, b: a - b), mask)
    return F.transform(diff, forms[estimator])


def token_rewards(
    reward: Column, kl: Column, mask: Column, beta: float, clip: tuple[float, float] | None = None
) -> Column:
    """``-beta * kl`` on every token, plus the (clipped) reward on the last token the mask keeps."""
    if clip is not None:
        reward = F.greatest(F.least(reward, F.lit(float(clip[1]))), F.lit(float(clip[0])))
    weight = max(beta, 0.0)
    last = F.size(mask) - F.greatest(F.array_position(F.reverse(mask), F.lit(1)).cast("int"), F.lit(1))
    return F.transform(
        kl, lambda k, i: F.when(i == last, reward).otherwise(F.lit(0.0)) - F.lit(float(weight)) * k
    )


def discounted_returns(rewards: Column, gamma: float, mask: Column | None = None) -> Column:
    """Sum of the rewards from each step on, discounted by ``gamma`` per step."""

    def scan(arrays: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.list_value_length(arrays).fill_null(0)).astype(np.int64)
        ends, flat = np.cumsum(sizes), arrays.flatten()
        reward, missing = np.asarray(flat.fill_null(0.0)), np.asarray(flat.is_null())
        out, unknown = np.zeros(len(flat)), np.zeros(len(flat), bool)
        order = np.argsort(-sizes, kind="stable")
        last, g, lost = ends[order] - 1, np.zeros(len(order)), np.zeros(len(order), bool)
        live = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for t, n in enumerate(live.tolist()):  # step t from the end of all arrays that have it
            at = last[:n] - t
            g[:n] = reward[at] + gamma * g[:n]
            lost[:n] |= missing[at]  # everything before an unknown reward is unknown
            out[at], unknown[at] = g[:n], lost[:n]
        values = pa.array(out, mask=unknown)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values, mask=arrays.is_null())

    return F.arrow_udf(scan, DOUBLES)(masked(rewards, mask).cast(DOUBLES))


def gae(values: Column, rewards: Column, gamma: float, lam: float, mask: Column | None = None) -> Column:
    """Generalised advantage estimate per step (masked values and rewards, backwards)."""

    v = masked(values, mask)
    following = F.concat(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.array(F.lit(0.0)))
    now = F.zip_with(masked(rewards, mask), v, lambda r, x: r - x)
    deltas = F.zip_with(now, following, lambda d, x: d + F.lit(float(gamma)) * x)
    return discounted_returns(deltas, gamma * lam)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)
