"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained here in numpy, on the driver, from labelled spans: a bounded number of windows of the corpus,
labelled by the base patterns, into which generated items of many written forms are put at known places. It is small
and deterministic, and its weights travel with the tasks.

Every text is read whole. Windows of ``WINDOW`` characters start every ``STRIDE`` characters, so each character lies in
two of them. A span must hold a digit or an at sign (also a spelled-out one), so only windows with such a sign are run;
the others could not give a span. Scores of overlapping windows are blended by the distance to the window's edge, and
one Viterbi pass over each stretch of neighbouring windows decides all its characters together. Decoded spans have to
pass their kind's test (address parts, checksum, number of digits) and must not touch a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, byte_view, col, slices, text_of

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN = 128, 64, 16
LABELS = len(KINDS) + 1
SYMBOLS = 128 + 4

# The base patterns.
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never begins inside a number: it would have begun before
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_evidence = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs so that the cost is linear."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _local:
            start -= 1
        domain = _domain.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and then start."""
    found = [(0, a, b) for a, b in emails(text)]
    found += [(1, *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _card.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _phone.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def passes(kind: int, text: str) -> bool:
    """The test of a decoded span of that kind."""
    digits = digits_of(text)
    if kind == 0:
        parts = re.split(r"\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?", text)
        return len(parts) == 2 and len(parts[0]) > 0 and re.search(r"\S(\.|\s?[(\[{]?dot[)\]}]?\s?)[A-Za-z]{2,}\Z", parts[1]) is not None
    if kind == 1:
        numbers = re.split(r"[^0-9]+", text)
        return len(numbers) == 4 and all(0 < len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return (8 if text.startswith("+") else 9) <= len(digits) <= 15


def symbols_of(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, then letters, digits and the rest beyond it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = points.astype(np.int16, copy=True) if len(points) else np.zeros(0, np.int16)
    for i in np.flatnonzero(points >= 128).tolist():
        c = chr(points[i])
        out[i] = 128 + (0 if c.isalpha() else 1 if c.isdigit() else 2 if c.isspace() else 3)
    return out


class Tagger:
    """Weights: for both directions a table of gate inputs by character class and a recurrent matrix; output scores; ties."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.table = draw.normal(0, 0.2, (2, SYMBOLS, 4 * HIDDEN)).astype(np.float32)
        self.table[:, :, HIDDEN : 2 * HIDDEN] += 1.0  # remember at first
        self.again = draw.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.out = draw.normal(0, 0.2, (2, HIDDEN, LABELS)).astype(np.float32)
        self.bias = np.zeros(LABELS, np.float32)
        self.ties = np.zeros((LABELS, LABELS), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.again, self.out, self.bias, self.ties]

    def states(self, symbols: np.ndarray, keep: bool = False):
        """Hidden states of both directions, [direction, place, window, unit]; ``symbols`` is [window, place]."""
        both = np.stack([symbols, symbols[:, ::-1]])
        size, length = symbols.shape
        hidden = np.zeros((2, length, size, HIDDEN), np.float32)
        h = c = np.zeros((2, size, HIDDEN), np.float32)
        trace = []
        for t in range(length):
            gates = np.stack([self.table[d][both[d, :, t]] for d in (0, 1)]) + h @ self.again
            gates[..., : 3 * HIDDEN] = 1 / (1 + np.exp(-gates[..., : 3 * HIDDEN]))
            gates[..., 3 * HIDDEN :] = np.tanh(gates[..., 3 * HIDDEN :])
            i, f, o, g = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            h = hidden[:, t] = o * squashed
            if keep:
                trace.append((gates, before, squashed))
        return (hidden, both, trace) if keep else hidden

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """Label scores of every character, [window, place, label]."""
        hidden = self.states(symbols)
        return (hidden[0] @ self.out[0] + (hidden[1] @ self.out[1])[::-1] + self.bias).transpose(1, 0, 2)

    def gradients(self, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean negative log-likelihood of the label paths."""
        hidden, both, trace = self.states(symbols, keep=True)
        scores = hidden[0] @ self.out[0] + (hidden[1] @ self.out[1])[::-1] + self.bias  # [place, window, label]
        length, size, _ = scores.shape
        ahead, back = np.empty_like(scores), np.zeros_like(scores)

        def folded(x: np.ndarray) -> np.ndarray:
            top = x.max(axis=1, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]

        ahead[0] = scores[0]
        for t in range(1, length):
            ahead[t] = scores[t] + folded(ahead[t - 1][:, :, None] + self.ties)
        for t in range(length - 2, -1, -1):
            back[t] = folded((self.ties.T + (scores[t + 1] + back[t + 1])[:, :, None]))
        total = folded(ahead[-1][:, :, None])[None]
        slope = np.exp(ahead + back - total)
        pairs = np.exp(ahead[:-1, :, :, None] + self.ties + (scores[1:] + back[1:])[:, :, None, :] - total[..., None]).sum(axis=(0, 1))
        truth = labels.T
        slope[np.arange(length)[:, None], np.arange(size)[None], truth] -= 1
        np.subtract.at(pairs, (truth[:-1].ravel(), truth[1:].ravel()), 1)
        slope /= size
        turned = [slope, slope[::-1]]
        out = np.stack([np.einsum("tbh,tbl->hl", hidden[d], turned[d]) for d in (0, 1)])
        table, again = np.zeros_like(self.table), np.zeros_like(self.again)
        into = np.stack([turned[d] @ self.out[d].T for d in (0, 1)])
        dh = dc = np.zeros((2, size, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1):
            gates, before, squashed = trace[t]
            i, f, o, g = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh = dh + into[:, t]
            dc = dc + dh * o * (1 - squashed**2)
            d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=2)
            dc = dc * f
            dh = d @ self.again.transpose(0, 2, 1)
            if t:
                again += hidden[:, t - 1].transpose(0, 2, 1) @ d
            for k in (0, 1):
                np.add.at(table[k], both[k, :, t], d[k])
        return [table, again, out, slope.sum(axis=(0, 1)), pairs / size]

    def fit(self, symbols: np.ndarray, labels: np.ndarray, rounds: int = 260, batch: int = 48, rate: float = 0.02) -> None:
        """Adam on batches in a fixed order."""
        order = np.random.default_rng(5)
        mean, spread = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()]
        for step in range(1, rounds + 1):
            pick = order.integers(0, len(symbols), batch)
            slow = rate * min(1.0, 2.0 * (rounds - step + 1) / rounds)
            for w, g, m, v in zip(self.weights(), self.gradients(symbols[pick], labels[pick]), mean, spread):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label path of each stretch. ``scores``: [place, label] of all stretches in a row."""
        order = np.argsort(-lengths, kind="stable")
        begin, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
        live = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right").tolist()
        came, path = np.zeros(scores.shape, np.int8), np.zeros(len(scores), np.int64)
        best = scores[begin].copy()
        for t, n in enumerate(live[1:], 1):
            ways = best[:n, :, None] + self.ties
            came[begin[:n] + t] = ways.argmax(axis=1)
            best[:n] = ways.max(axis=1) + scores[begin[:n] + t]
        path[begin + sizes - 1] = best.argmax(axis=1)
        for t in range(len(live) - 1, 0, -1):
            at = begin[: live[t]] + t
            path[at - 1] = came[at, path[at]]
        return path


def written_items(draw: np.random.Generator) -> tuple[int, str]:
    """A generated item: its kind (0 email ... 3 phone, -1 none of them) and one of the forms it is written in."""
    pick = lambda *options: options[draw.integers(len(options))]
    digits = lambda n: "".join(str(draw.integers(10)) for _ in range(n))
    word = lambda a, b: "".join(chr(97 + draw.integers(26)) for _ in range(draw.integers(a, b + 1)))
    kind = int(draw.integers(-2, len(KINDS)))
    if kind == 0:
        name = word(2, 9) + pick("", "." + word(2, 8), "_" + word(1, 4), digits(2), "." + digits(2), "+" + word(2, 4))
        host = pick("", word(3, 6) + ".") + word(3, 9) + pick("", digits(1)) + "." + pick("com", "org", "net", "de", "fr", "es", "io", "example.com")
        return 0, name + pick("@", "@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ") + host
    if kind == 1:
        return 1, pick(".", ".", ".", " . ", "[.]", ",").join(str(draw.integers(256)) for _ in range(4))
    if kind == 2:
        gap = pick("", " ", "-", ".")
        number = pick("4", "5", "37", "6011") + digits(18)
        return 2, gap.join(number[:16][k : k + 4] for k in range(0, 16, 4)) if pick(True, True, False) else number[: pick(15, 16, 19)]
    if kind == 3:
        return 3, pick(
            f"+{draw.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{draw.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}",
            f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{draw.integers(10, 99)} {digits(2)} {digits(7)}", f"0{digits(3)}/{digits(7)}", f"+{digits(11)}",
        )
    hexes = "".join(pick(*"0123456789abcdef") for _ in range(draw.integers(12, 40)))
    return -1, pick(digits(draw.integers(1, 7)), f"{draw.integers(1900, 2100)}", f"{draw.integers(1, 32)}.{draw.integers(1, 13)}.{draw.integers(1990, 2030)}", f"{draw.integers(1990, 2030)}-{draw.integers(10, 13)}-{draw.integers(10, 32)}", f"{draw.integers(0, 24)}:{digits(2)}", f"{draw.integers(1, 9)}.{draw.integers(1, 20)}.{draw.integers(1, 9)}", f"${digits(3)}.{digits(2)}", "password=" + hexes, hexes, "@" + word(3, 8), f"{digits(3)},{digits(3)},{digits(3)}", "AKIA" + word(8, 16).upper() + digits(2))


def training_set(contexts: list[str], size: int = 900, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their labels: contexts with their base spans, and generated items put into them."""
    draw = np.random.default_rng(seed)
    contexts = [c for c in contexts if c] or ["the and of to in that with for was on", "der und die in von zu mit", "le de la et les des en un"]
    symbols, labels = np.zeros((size, WINDOW), np.int16), np.zeros((size, WINDOW), np.int64)
    for row in range(size):
        text = contexts[draw.integers(len(contexts))]
        while len(text) < 2 * WINDOW:
            text += " " + contexts[draw.integers(len(contexts))]
        text = text[: 2 * WINDOW]
        marks = [0] * len(text)
        for kind, a, b in base_spans(text):
            marks[a:b] = [kind + 1] * (b - a)
        if row % 4:
            blanks = [i for i, c in enumerate(text) if c == " " and not marks[i]] or [0]
            for place in sorted(draw.choice(blanks, min(len(blanks), int(draw.integers(1, 4))), replace=False).tolist(), reverse=True):
                kind, item = written_items(draw)
                text = text[:place] + " " + item + text[place:]
                marks[place:place] = [0] + [kind + 1] * len(item)
        shift = int(draw.integers(0, len(text) - WINDOW + 1))
        symbols[row], labels[row] = symbols_of(text[shift : shift + WINDOW]), marks[shift : shift + WINDOW]
    return symbols, labels


def train(docs: DataFrame, text_col: str = "text", contexts: int = 400) -> Tagger:
    """Fit the network. The corpus gives at most ``contexts`` windows: of each hash class of windows around a text's
    first digit or at sign the smallest. No usable window: contexts of common words."""
    text = text_of(docs, text_col)
    cut = F.substring(text, F.greatest(F.lit(1), F.regexp_instr(text, F.lit("[0-9@]")) - 100), F.lit(2 * WINDOW))
    found = docs.where(text.rlike("[0-9@]")).select(cut.alias("context"))
    rows = found.groupBy(F.pmod(F.xxhash64("context"), F.lit(contexts)).alias("class")).agg(F.min("context").alias("context")).collect()
    tagger = Tagger()
    tagger.fit(*training_set(sorted(r["context"] for r in rows)))
    return tagger


def stretches(texts: list[str]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Windows (text, start, end) with a sign of personal data, and stretches (text, first window, last window + 1)."""
    windows, runs = [], []
    for i, text in enumerate(texts):
        numbers = sorted({k for m in _evidence.finditer(text) for k in (m.start() // STRIDE - 1, m.start() // STRIDE) if k >= 0})
        last = None
        for k in numbers:
            if last is None or k > last + 1:
                runs.append([i, len(windows), 0])
            windows.append((i, k * STRIDE, min(len(text), k * STRIDE + WINDOW)))
            runs[-1][2] = len(windows)
            last = k
    return windows, [tuple(r) for r in runs]


def decoded_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of the network for each text, after their tests."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    windows, runs = stretches(texts)
    if not windows:
        return out
    edge = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
    step = 2048
    parts = []
    for at in range(0, len(windows), step):
        symbols = np.full((min(step, len(windows) - at), WINDOW), 32, np.int16)
        for row, (i, a, b) in enumerate(windows[at : at + step]):
            symbols[row, : b - a] = symbols_of(texts[i][a:b])
        parts.append(tagger.scores(symbols))
    scores = np.concatenate(parts)
    lengths = np.array([windows[stop - 1][2] - windows[first][1] for _, first, stop in runs])
    begins = np.cumsum(lengths) - lengths
    total, weight = np.zeros((lengths.sum(), LABELS), np.float32), np.zeros((lengths.sum(), 1), np.float32)
    for (_, first, stop), begin in zip(runs, begins.tolist()):
        shift = begin - windows[first][1]
        for w in range(first, stop):
            _, a, b = windows[w]
            total[shift + a : shift + b] += scores[w, : b - a] * edge[: b - a, None]
            weight[shift + a : shift + b] += edge[: b - a, None]
    path = tagger.decode(total / weight, lengths)
    for (i, first, _), begin, length in zip(runs, begins.tolist(), lengths.tolist()):
        text, shift, own = texts[i], windows[first][1], path[begin : begin + length]
        flips = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
        for a, b in zip(flips[:-1].tolist(), flips[1:].tolist()):
            kind = int(own[a]) - 1
            if kind >= 0:
                a, b = trimmed(text, shift + a, shift + b)
                if a < b and apart(text, a, b) and passes(kind, text[a:b]):
                    out[i].append((kind, a, b))
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without blanks and punctuation at its ends."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def apart(text: str, a: int, b: int) -> bool:
    """Whether the span is no part of a longer word or number."""
    before, after = text[max(0, a - 2) : a], text[b : b + 2]
    return not re.search(r"\w\Z|[0-9][ .,/-]\Z", before) and not re.match(r"\w|[ .,/-][0-9]", after)


def personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, base and added: arrays of (kind, start, end) in code points, end exclusive, by kind and start.

    ``base`` are the patterns' spans; ``added`` are the network's that touch none of them. Null and empty texts have
    none. Null ids stay null, repeated rows get equal results, other columns are ignored. No exchange.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows_of(found: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                raw, at = byte_view(part.column("text"))
                signs = np.concatenate([[0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64) | (raw == 40) | (raw == 91) | (raw == 123))])
                some = np.flatnonzero(signs[at[1:]] > signs[at[:-1]])  # texts with a digit, an at sign or an opening bracket
                texts = part.column("text").take(pa.array(some)).to_pylist()
                base: list[list] = [[] for _ in range(part.num_rows)]
                added: list[list] = [[] for _ in range(part.num_rows)]
                for i, text, more in zip(some.tolist(), texts, decoded_spans(tagger, texts)):
                    own = base_spans(text)
                    base[i] = rows_of(own)
                    added[i] = rows_of([s for s in more if all(s[2] <= a or s[1] >= b for _, a, b in own)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))], ["id", "base", "added"])

    rows = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def joined(spans: Column | str) -> Column:
    """kind:start:end, comma-joined, by kind as listed and then start."""
    order = F.array(*(F.lit(k) for k in KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
