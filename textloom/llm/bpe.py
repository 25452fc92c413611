"""Byte-level BPE: texts to token ids and back.

Where tokens may not reach across is found without a pattern: every character is a function from states to states, functions are composed
in any grouping, and the states tell where a slice begins. Slices then go through a cache to the merging of pairs.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import PORTION, bounded_batches

#: Classes of characters: letters, digits of any script, others, white space, the blank.
LETTER, NUMBER, OTHER, WHITE, BLANK = range(5)
#: What a character is beside its neighbours: white space with more white space (or the end) behind it; the last of its run, a blank or not, before
#: something else; an apostrophe before one or two letters of a contraction; the end of a text.
INNER, LAST_BLANK, LAST_WHITE, SHORT, LONG, END = range(3, 9)
SYMBOLS = 9
#: States: inside a slice of letters, digits, others or white space; after a blank that leads a slice; before the last or last two letters of a
#: contraction; after a slice that takes nothing more.
IN_WHITE, LED, ONE_LEFT, TWO_LEFT, DONE = range(3, 8)
STATES = 8
#: Slices that the cache keeps, at most, and their bytes. Longer ones are merged each time.
CACHED, CACHED_BYTES = 1 << 19, 64
#: Widths of the tables in which many slices are merged together; longer ones are merged one by one, in a heap.
WIDTHS = (8, 16, 32, 64)
NONE = np.int32(1 << 30)
#: Tokens that are decoded together.
DECODED = 1 << 20


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """State after and whether a slice begins, by state and symbol."""
    to, begins = np.full((STATES, SYMBOLS), DONE, np.uint8), np.ones((STATES, SYMBOLS), bool)
    for state, symbol in itertools.product(range(STATES), range(SYMBOLS)):
        goes_on = symbol in (LETTER, NUMBER, OTHER, SHORT, LONG) and state in (LED, OTHER if symbol in (SHORT, LONG) else symbol)
        if symbol in (LETTER, NUMBER, OTHER):
            to[state, symbol] = symbol
        elif symbol in (SHORT, LONG):
            to[state, symbol] = OTHER if goes_on else ONE_LEFT if symbol == SHORT else TWO_LEFT
        elif symbol == INNER:
            to[state, symbol], goes_on = IN_WHITE, state == IN_WHITE
        elif symbol == LAST_BLANK:
            to[state, symbol] = LED
        if symbol == LETTER and state in (ONE_LEFT, TWO_LEFT):
            to[state, symbol], goes_on = DONE if state == ONE_LEFT else ONE_LEFT, True
        begins[state, symbol] = not goes_on
    return to, begins


MOVES, BEGINS = _moves()


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions from states to states that strings of symbols give, as rows; of two of them, which one is the first and then the
    second; of each symbol, which it is. Function 0 changes nothing."""
    known = {tuple(range(STATES)): 0}
    of = [known.setdefault(tuple(MOVES[:, s].tolist()), len(known)) for s in range(SYMBOLS)]
    rows = list(known)
    for f in rows:  # grows
        for s in range(SYMBOLS):
            if (g := tuple(int(MOVES[q, s]) for q in f)) not in known:
                known[g] = len(known)
                rows.append(g)
    table = np.array([[known[tuple(g[q] for q in f)] for g in rows] for f in rows], np.uint16)
    return np.array(rows, np.uint8), table, np.array(of, np.uint16)


FUNCTIONS, THEN, OF_SYMBOL = _functions()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kind = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
    out[kind == "L"], out[kind == "N"] = LETTER, NUMBER
    # fixed values: the code points that Unicode calls white space
    out[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[0x20] = BLANK
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbols of code points; at ``ends`` stands one that belongs to no text."""
    kind = classes()[points]
    out = kind.copy()
    white = kind >= WHITE
    white[ends] = False
    out[ends] = END
    following = np.append(out[1:], END)
    next_white = np.append(white[1:], False)
    last = white & ~next_white & (following != END)
    out[white] = INNER
    out[last] = np.where(kind[last] == BLANK, LAST_BLANK, LAST_WHITE)
    quotes = np.flatnonzero((points == ord("'")) & (out == OTHER))
    padded = np.concatenate([points, np.zeros(2, points.dtype)])
    is_end = np.concatenate([out == END, [True, True]])
    # an end cuts a contraction off; at an end stands a line feed, which is no letter
    one, two = padded[quotes + 1], padded[quotes + 2]
    two = np.where(is_end[quotes + 1], 0, two)
    out[quotes[np.isin(one, list(map(ord, "stmd")))]] = SHORT
    letters = lambda a, b: (one == ord(a)) & (two == ord(b))
    out[quotes[letters("r", "e") | letters("v", "e") | letters("l", "l")]] = LONG
    return out


def slice_starts(found: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each symbol.

    The symbols are laid out in columns. Down all columns at once the functions are composed; the columns' functions, one after another,
    give the state at the head of each; from these, down all columns at once again, the states."""
    n = len(found)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    laid = np.full(width * rows, END, np.uint8)
    laid[:n] = found
    laid = np.ascontiguousarray(laid.reshape(width, rows).T)
    flat, many = THEN.ravel(), len(FUNCTIONS)
    whole = np.zeros(width, np.intp)
    for symbol in laid:
        whole = flat[whole * many + OF_SYMBOL[symbol]].astype(np.intp)
    heads = list(itertools.accumulate(whole.tolist(), lambda state, f: int(FUNCTIONS[f, state]), initial=DONE))[:-1]
    state = np.array(heads, np.intp)
    out = np.empty(laid.shape, bool)
    moves, begins = MOVES.ravel(), BEGINS.ravel()
    for k, symbol in enumerate(laid):
        at = state * SYMBOLS + symbol
        out[k] = begins[at]
        state = moves[at].astype(np.intp)
    return np.ascontiguousarray(out.T).ravel()[:n]


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, each followed by one more; the bounds of the slices in them; which slices are only that byte."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    starts = np.flatnonzero(slice_starts(symbols(points, ends)))
    bytes_before = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
    return joined.encode(), bytes_before[np.append(starts, len(points))], np.searchsorted(starts, ends)


class Merger:
    """The vocabulary of a rank file, and slices that were merged already."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.words = [b""] * size
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.frombuffer(b"".join(self.words), np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                left, right = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        self.pairs, self.size = pairs, size
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.cache: dict[bytes, bytes] = {b"": b""}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def _merged_table(self, words: list[bytes], width: int) -> list[bytes]:
        """Slices of at most ``width`` bytes, all at once: in each round every slice merges its first pair of least rank."""
        n = len(words)
        counts = np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, np.int32)
        ids[np.arange(width + 1) < counts[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        columns = np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over).tolist():
                    out[rows[k]] = ids[k, : counts[rows[k]]].tobytes()
                going = ~over
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            ids[here, at] = best
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > at[:, None]), width), axis=1)
            counts[rows] -= 1
            ids[here, counts[rows]] = -1
            ranks = np.take_along_axis(ranks, np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), width - 1), axis=1)
            ranks[:, -1] = NONE
            ranks[here, at] = NONE
            inner = at < width
            ranks[here[inner], at[inner]] = self._rank(ids[here[inner], at[inner]], ids[here[inner], at[inner] + 1])
            led = at > 0
            ranks[here[led], at[led] - 1] = self._rank(ids[here[led], at[led] - 1], ids[here[led], at[led]])
        return out

    def _merged_long(self, word: bytes) -> bytes:
        """One slice of any length: a heap of pairs by rank and place, over a chain of the tokens left."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda a, b: self.pairs.get(ids[a] * self.size + ids[b])
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank(k, k + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue  # one of them was merged since
            ids[k], ids[j] = r, -1
            after[k] = i = after[j]
            if i < n:
                before[i] = k
                if (x := rank(k, i)) is not None:
                    heapq.heappush(heap, (x, k, r, ids[i]))
            if (h := before[k]) >= 0 and (x := rank(h, k)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each slice, as bytes of 32-bit numbers. A slice that is in the vocabulary is one token."""
        if len(self.cache) > CACHED:
            self.cache = {b"": b""}
        parts = list(map(self.cache.get, words))
        missed = [k for k, ids in enumerate(parts) if ids is None]
        if missed:
            own: dict[bytes, bytes] = {}
            new: dict[int, list[bytes]] = {w: [] for w in WIDTHS}
            for word in {words[k] for k in missed}:
                if (rank := self.ranks.get(word)) is not None:
                    own[word] = np.int32(rank).tobytes()
                elif (width := next((w for w in WIDTHS if len(word) <= w), None)) is not None:
                    new[width].append(word)
                else:
                    own[word] = self._merged_long(word)
            for width, some in new.items():
                if some:
                    own.update(zip(some, self._merged_table(some, width), strict=True))
            for k in missed:
                parts[k] = own[words[k]]
            self.cache.update((w, ids) for w, ids in own.items() if len(w) <= CACHED_BYTES)
        return parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids; where each text's begin and end among them; where each token ends in its text's bytes."""
        data, bounds, ends = slices(texts)
        words = [data[a:b] for a, b in itertools.pairwise(bounds.tolist())]
        for k in ends.tolist():
            words[k] = b""  # the byte between texts
        parts = self.merged(words)
        ids = np.frombuffer(b"".join(parts), np.int32)
        tokens = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) >> 2)])
        text_ends = np.concatenate([[0], tokens[ends]]).astype(np.int64)
        token_ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        starts = np.repeat(token_ends[text_ends[:-1]], np.diff(text_ends))
        return ids, text_ends, (token_ends[1:] - starts).astype(np.int32)

    def decode(self, ids: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The bytes of tokens that end at ``stops``."""
        if not len(ids):
            return np.empty(0, np.uint8)
        lengths = self.lengths[ids]
        starts = stops - lengths
        return self.flat[np.arange(stops[-1]) + np.repeat(self.places[ids] - starts, lengths)]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of rows whose texts have about ``PORTION`` characters together."""
    lo = n = 0
    for hi, t in enumerate(texts, 1):
        n += len(t)
        if n >= PORTION or hi == len(texts):
            yield lo, hi
            lo, n = hi, 0


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` and ``stops`` in the place of ``text``: its tokens by the ranks of the file at ``path`` (present on all machines), and
    where each ends in the text's UTF-8 bytes, so that any stretch of tokens can be given back as a stretch of the text.

    Null and empty texts have no tokens. Repeated rows are encoded each; other columns stay, whatever their names but ``ids`` and ``stops``. Texts
    are whole: one longer than a portion is a portion of its own, in a task's memory with about thirty bytes a character."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    if taken := {f.name.lower() for f in kept} & {"ids", "stops"}:
        raise ValueError(f"columns that encode adds: {', '.join(sorted(taken))}")
    bounded_batches(docs.sparkSession)
    schema = StructType([*kept])
    at = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for lo, hi in _portions(texts):
                ids, ends, stops = own.encode(texts[lo:hi])
                columns = [b.column(k).slice(lo, hi - lo) for k in range(b.num_columns) if k != at]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (ids, stops)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], [*(f.name for f in kept), "ids", "stops"])

    return docs.mapInArrow(run, schema.add("ids", ArrayType(IntegerType())).add("stops", ArrayType(IntegerType())))


def decode(encoded: DataFrame, path: str, into: str = "decoded") -> DataFrame:
    """``encoded`` (ids, stops and any others) with a binary column ``into``, the bytes that the tokens stand for. Rows without tokens, or with
    null ones, have no bytes."""
    names = encoded.columns
    ids_at, stops_at = names.index("ids"), names.index("stops")
    schema = StructType([*encoded.schema.fields]).add(into, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for b in batches:
            lists, all_stops = b.column(ids_at), b.column(stops_at)
            counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            group = (np.cumsum(counts) - counts) // DECODED
            for rows in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(group)) + 1):
                lo, n = int(rows[0]) if len(rows) else 0, len(rows)
                ids = lists.slice(lo, n).flatten().to_numpy(zero_copy_only=False)
                stops = all_stops.slice(lo, n).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(counts[rows])
                last = np.where(counts[rows] > 0, stops[np.maximum(ends - 1, 0)] if len(stops) else 0, 0)
                bounds = np.concatenate([[0], np.cumsum(last)])
                made = own.decode(ids, stops + np.repeat(bounds[:-1], counts[rows]))
                column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(made.tobytes())])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in b.columns), column], [*names, into])

    return encoded.mapInArrow(run, schema)
