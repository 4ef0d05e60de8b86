"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary with one score per piece is compiled into a deterministic transducer over characters. A state
holds, for each suffix of the text read so far that could still grow into a longer piece, the last token before that
suffix and how many tokens fewer the text has there. A transition carries by how many tokens the count of the whole
prefix changes, so the sum along a text is its exact number of tokens. Two facts make this exact for greedy merging:
every part of an encoding is the encoding of its own text, and tokens follow each other in an encoding exactly if each
neighbouring pair is its own encoding.

States and transitions are made when first needed and kept in a dense table of bounded size (``max_states``; a full
table starts anew, which costs time and changes nothing). Texts are cut into chunks that run in lockstep, one numpy
step for all chunks of a batch. A chunk that starts where no piece can span the border has a constant state map. Any
other chunk gets a map from several likely entry states to exit state and count. Maps compose by a parallel prefix
scan; a chunk whose true entry state is not in its map is run once more from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, col, slices, text_of

SPACE = "▁"
CHUNK = 1024
#: Bytes of text that run in lockstep; more lanes make a step cheaper.
LOCKSTEP_BYTES = 4 << 20
#: How far before a hard cut the guesses for its entry state start.
WARM_UP = (48, 47, 33, 32)
#: States are merged by what their last tokens allow, for suffixes that this many pieces at most begin with.
MERGED = 40
#: Counts are kept with this offset so that a packed transition is never negative.
SHIFT, BITS = 32, 6


class Transducer:
    """The compiled tokenizer. ``pieces``: piece -> score, higher merges first, leftmost on a tie."""

    def __init__(self, pieces: dict[str, float], max_states: int = 120_000):
        self.pieces, self.max_states = pieces, max_states
        longer = [p for p in pieces if len(p) > 1]
        chars = sorted({c for p in longer for c in p})
        self.chars = {c: i for i, c in enumerate(chars)}
        self.names = [*chars, None, None, None, None]  # a class for each weight of characters that never merge
        self.width = len(self.names)
        self.growing: dict[str, list[str]] = {}  # proper prefix of a piece -> the pieces that it can become
        for p in longer:
            for n in range(1, len(p)):
                self.growing.setdefault(p[:n], []).append(p)
        self.bigrams = np.zeros((self.width, self.width), bool)
        for p in longer:
            for a, b in zip(p, p[1:]):
                self.bigrams[self.chars[a], self.chars[b]] = True
        self.base = len(chars)
        self.classes = np.empty(0x110000, np.int16)
        for start, stop, weight in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.classes[start:stop] = self.base + weight - 1
        for p in pieces:
            if len(p) == 1:
                self.classes[ord(p)] = self.base
        for c, i in self.chars.items():
            self.classes[ord(c)] = i
        self.weights = {c: 1 if c in pieces else len(c.encode()) for c in chars}
        self.classes[0x20] = self.classes[ord(SPACE)]  # a blank is written as the space sign
        self.space = int(self.classes[ord(SPACE)])
        self.alone: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.kinds: dict[tuple[str, str | None], tuple] = {}
        self.groups: dict[tuple, str | None] = {}
        self.restart()

    def restart(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.full(4096 * self.width, -1, np.int32)
        self.number((("", None, 0),))

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            if (found + 1) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        return found

    def merged(self, left: str, right: str) -> list[str]:
        """Greedy encoding of a short text; the parts have no influence on it."""
        parts = list(left + right)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.pieces.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: str | None, token: str) -> bool:
        """Whether ``token`` can stand after the token ``last`` (None: after any border that nothing spans)."""
        if last is None:
            found = self.alone.get(token)
            if found is None:
                found = self.alone[token] = self.merged(token, "") == [token]
            return found
        found = self.fits.get((last, token))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[last, token] = self.merged(last, token) == [last, token]
        return found

    def kept(self, suffix: str, last: str | None) -> tuple:
        """(One name for all last tokens that allow the same pieces to grow from the suffix,), or () if none can."""
        if len(self.growing[suffix]) > MERGED:
            return (last,)
        found = self.kinds.get((suffix, last))
        if found is None:
            if len(self.kinds) > 2_000_000:
                self.kinds.clear()
            allowed = tuple(p for p in self.growing[suffix] if (self.follows(None, p) if last is None else self.merged(last, p) == [last, p]))
            found = self.kinds[suffix, last] = (self.groups.setdefault((suffix, allowed), last),) if allowed else ()
        return found

    def step(self, state: tuple, kind: int) -> tuple[tuple, int]:
        """The next state and the change of the token count."""
        c = self.names[kind]
        if c is None:
            return (("", None, 0),), state[-1][2] + kind - self.base + 1
        for suffix, last, fewer in state:
            token = suffix + c
            if (not suffix or token in self.pieces) and self.follows(last, token):
                break
        else:
            raise AssertionError("a text has exactly one encoding")
        change = fewer + (1 if len(token) > 1 else self.weights[token])
        after = []
        for suffix, last, fewer in state:
            grown = suffix + c
            if grown in self.growing:
                if last is not None and not self.bigrams[self.chars[last[-1]], self.chars[grown[0]]]:
                    last = None
                for name in self.kept(grown, last):
                    after.append((grown, name, fewer - change))
        after.append(("", token, 0))
        return tuple(after), change

    def fill(self, places: np.ndarray) -> None:
        for place in places.tolist():
            if self.table[place] < 0:
                state, kind = divmod(place, self.width)
                after, change = self.step(self.states[state], kind)
                number = self.number(after)
                self.table[place] = number << BITS | change + SHIFT

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of all chunks, one symbol of each at a time."""
        order = np.argsort(-lengths, kind="stable")
        begin, state = starts[order], entry[order].astype(np.int64)
        total = np.zeros(len(order), np.int64)
        live = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
        for i, n in enumerate(live.tolist()):
            place = state[:n] * self.width
            place += symbols[begin[:n] + i]
            packed = self.table[place]
            if packed.min(initial=0) < 0:
                self.fill(np.unique(place[packed < 0]))
                packed = self.table[place]
            total[:n] += packed & ((1 << BITS) - 1)
            state[:n] = packed >> BITS
        exits, counts = np.empty_like(state), np.empty_like(total)
        exits[order], counts[order] = state, total
        return exits, counts - SHIFT * lengths

    def count(self, points: np.ndarray, at: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Tokens of every text; text i is ``points[at[i]:at[i + 1]]``."""
        if len(self.states) > self.max_states:
            self.restart()
        sizes = np.diff(at)
        prefix = (sizes > 0).astype(np.int64)  # a text that isn't empty begins with a space sign
        begin = at[:-1] + np.cumsum(prefix) - prefix
        symbols = np.empty(len(points) + int(prefix.sum()), np.int16)
        first = np.zeros(len(symbols), bool)
        first[begin[sizes > 0]] = True
        symbols[first], symbols[~first] = self.space, self.classes[points]
        border = first.copy()
        border[1:] |= ~self.bigrams[symbols[:-1], symbols[1:]]
        starts, lengths, texts, hard = self.cut(begin, sizes + prefix, border, chunk)
        tokens = np.zeros(len(sizes), np.int64)
        if len(starts):
            np.add.at(tokens, texts, self.scan(symbols, starts, lengths, hard))
        return tokens

    @staticmethod
    def cut(begin: np.ndarray, sizes: np.ndarray, border: np.ndarray, chunk: int):
        """Chunks of one to two times ``chunk`` symbols that start at a border, and hard cuts where there is none."""
        pieces = np.maximum(1, sizes // chunk) * (sizes > 0)
        texts = np.repeat(np.arange(len(sizes)), pieces)
        inside = np.arange(len(texts)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        nominal = begin[texts] + inside * chunk
        places = np.flatnonzero(border)
        near = np.append(places, len(border))[np.searchsorted(places, nominal)]
        hard = near >= nominal + chunk
        starts = np.where(hard, nominal, near)
        stops = np.append(starts[1:], 0)
        final = np.append(texts[1:] != texts[:-1], True) if len(texts) else np.zeros(0, bool)
        stops[final] = (begin + sizes)[texts[final]]
        return starts, stops - starts, texts, hard

    def scan(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """Counts of all chunks, each from its true entry state."""
        exits, counts = self.run(symbols, starts, lengths, np.zeros(len(starts), np.int64))
        if not hard.any():
            return counts
        entries, outs, sums = (np.full((len(starts), len(WARM_UP)), -1, np.int64) for _ in range(3))
        rows = np.flatnonzero(hard)
        for k, back in enumerate(WARM_UP):
            early = np.maximum(starts[rows] - back, 0)
            entries[rows, k] = self.run(symbols, early, starts[rows] - early, np.zeros(len(rows), np.int64))[0]
            outs[rows, k], sums[rows, k] = self.run(symbols, starts[rows], lengths[rows], entries[rows, k])
        outs[~hard] = exits[~hard, None]
        reached, counts = self.compose(entries, outs, hard), counts.copy()
        for j in rows.tolist():  # the first chunk of a text starts at a border, so there is one before
            known = np.flatnonzero(entries[j] == reached[j - 1])
            if len(known):
                reached[j], counts[j] = outs[j, known[0]], sums[j, known[0]]
            else:
                reached[j], counts[j] = self.follow(symbols[starts[j] : starts[j] + lengths[j]], int(reached[j - 1]))
        return counts

    def follow(self, symbols: np.ndarray, state: int) -> tuple[int, int]:
        """Exit state and count of one chunk from a state that its map lacks."""
        total, table, width = 0, self.table, self.width
        for kind in symbols.tolist():
            place = state * width + kind
            packed = int(table[place])
            if packed < 0:
                self.fill(np.array([place]))
                table = self.table
                packed = int(table[place])
            total += (packed & ((1 << BITS) - 1)) - SHIFT
            state = packed >> BITS
        return state, total

    @staticmethod
    def compose(entries: np.ndarray, outs: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """Inclusive prefix scan of the state maps by doubling: the exit state of each chunk, -1 where a map lacks it.

        After the round with distance d a row's map leads from the entry of the chunk 2d - 1 places before it to its
        own exit; a constant map ends the reach to the left.
        """
        inn, out, open_ = entries.copy(), outs.copy(), hard.copy()
        d = 1
        while open_.any() and d < len(hard):
            rows = np.flatnonzero(open_)
            rows = rows[rows >= d]
            before = rows - d
            hit = out[before][:, :, None] == inn[rows][:, None, :]
            hit &= (out[before] >= 0)[:, :, None]
            chained = np.where(hit.any(axis=2), np.take_along_axis(out[rows], hit.argmax(axis=2), axis=1), -1)
            next_in, next_open = inn[before], open_[before]
            inn[rows], out[rows], open_[rows] = next_in, chained, next_open
            d *= 2
        return np.where(open_, -1, out[:, 0])


_compiled: dict[tuple, Transducer] = {}


def compiled(model: str, max_states: int) -> Transducer:
    """The transducer of a piece model file, once for each Python worker."""
    if (model, max_states) not in _compiled:
        import sentencepiece

        model_file = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = (i for i in range(model_file.get_piece_size()) if not (model_file.is_control(i) or model_file.is_unknown(i) or model_file.is_byte(i) or model_file.is_unused(i)))
        _compiled[model, max_states] = Transducer({model_file.id_to_piece(i): model_file.get_score(i) for i in plain}, max_states)
    return _compiled[model, max_states]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, max_states: int = 120_000) -> DataFrame:
    """Exact number of tokens of every whole text.

    ``model``: path of a byte-pair piece model with byte fallback, identity normalisation and a leading space sign, the
    same on every machine. Returns one row per input row: the id column, n_bytes, n_tokens (bigint), over_limit
    (n_tokens > ``limit``). No exchange: each batch is counted where it is read.

    Null or empty text: 0 bytes, 0 tokens. A null id stays null. Repeated rows stay repeated. Other columns are
    ignored, so their names cannot clash. A text of any length is cut into chunks; memory grows with the longest text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model, max_states)
        for batch in batches:
            for part in slices(batch, "text", LOCKSTEP_BYTES):
                points, at = code_points(part.column("text"))
                tokens = transducer.count(points, at)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(tokens)], ["id", "n_bytes", "n_tokens"])

    text = text_of(docs, text_col)
    rows = docs.select(col(docs, id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
