"""Substring dedup: repeated paragraphs by MinHash bands, repeated passages inside of paragraphs by sampled windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, different_buckets, fresh, kept, portions, stored, with_pair_blocks
from .components import connected_components
from .forest import Forest
from .grouping import map_groups

#: Words of the shingles, and of the shortest paragraph that is compared.
SHINGLE, MIN_WORDS = 5, 20
#: A pair at the similarity asked for, 0.8, shares one of the bands with probability 1 - (1 - 0.8**4)**10 = 0.995, one at 0.1 with 0.001.
BANDS, ROWS = 10, 4
#: Words of a window, and windows in a row of which one at least is taken: two texts that share 51 words or more,
#: wherever these stand in them, take one window of their common words at least.
WINDOW, REACH = 20, 32
#: Words of the shortest passage that is looked for inside of paragraphs, and across them.
PASSAGE = WINDOW + REACH - 1
#: Distinct paragraphs of a bucket that meet in one group, twice.
BLOCK_ROWS = 512
#: Bits of the table that says which paragraphs' texts may be wanted.
MARKS = 1 << 26
#: Odd multipliers of the polynomial hashes and of the mixing steps.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = 0xFF51AFD7ED558CCD
_NONE = np.uint64((1 << 64) - 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 12)
        rise = lambda x: np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size, x, dtype=np.uint64))])
        _POWERS[base] = rise(base), rise(pow(base, -1, 1 << 64))
    return _POWERS[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(BASES[1])
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of ``values[start:end]`` for all spans at once, from sums of values times powers up to each place."""
    up, down = _powers(base, len(values) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Parsed:
    """Words of several texts: their two hashes, places in code points, text and line (numbered through all texts); the lower-cased
    bytes of all texts and the words' places in them."""

    h1: np.ndarray
    h2: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    data: bytes
    first: np.ndarray
    last: np.ndarray


def parse(texts: list[str]) -> Parsed:
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[0::2], edge[1::2]
    doc = np.searchsorted(first, starts, side="right") - 1
    line = np.cumsum(data == 10)[starts]
    places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    values = data.astype(np.uint64) + np.uint64(1)
    base = places[first[doc]]
    hashes = [span_hashes(values, starts, ends, b) for b in BASES]
    return Parsed(hashes[0], hashes[1], places[starts] - base, places[ends] - base, doc, line, joined, starts, ends)


def paragraphs(p: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """First word and last word + 1 of each line of ``MIN_WORDS`` words or more."""
    n = len(p.line)
    begin = np.flatnonzero(np.concatenate([[True], p.line[1:] != p.line[:-1]])) if n else np.zeros(0, dtype=np.int64)
    stop = np.concatenate([begin[1:], [n]]) if n else begin
    long = stop - begin >= MIN_WORDS
    return begin[long], stop[long]


def digests(p: Parsed, begin: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """The XXH3 of 128 bits of each span's words with one blank between them: what the same words are told by."""
    return [xxhash.xxh3_128_digest(b" ".join(p.data[a:b].split())) for a, b in zip(p.first[begin].tolist(), p.last[stop - 1].tolist(), strict=True)] if len(begin) else []


def mark_of(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 4)), 16, 10).cast("long")


def marks_of(nodes: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(x[:4], "big") for x in nodes], dtype=np.int64)


def band_keys(p: Parsed, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys: ``ROWS`` minima each over the hashes of the paragraph's shingles."""
    at = np.arange(max(0, len(p.h1) - SHINGLE + 1))
    h = np.append(span_hashes(p.h1, at, at + SHINGLE, BASES[1]), _NONE)
    cut = np.stack([begin, stop - SHINGLE + 1], axis=1).ravel()
    keys = np.empty((len(begin), BANDS), dtype=np.uint64)
    if not len(begin):
        return keys
    rng = np.random.default_rng(6)
    for band in range(BANDS):
        key = np.full(len(begin), band + 1, dtype=np.uint64)
        for _ in range(ROWS):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            v = (h ^ b) * (a | np.uint64(1))
            low = np.minimum.reduceat(v ^ (v >> np.uint64(31)), cut)[::2]
            key = mixed(key * np.uint64(BASES[0]) + low)
        keys[:, band] = key
    return keys


def seeds(p: Parsed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows taken: of every ``REACH`` in a row that lie in one text, the last with the least hash. With them
    the first and the last of the passages of ``PASSAGE`` words that each is taken for: these are all of a text's, each once."""
    n = len(p.h1) - PASSAGE + 1
    full = np.flatnonzero(p.doc[:n] == p.doc[PASSAGE - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    if not len(full):
        return full, full, full
    at = np.arange(len(p.h1) - WINDOW + 1)
    rows = np.lib.stride_tricks.sliding_window_view(span_hashes(p.h1, at, at + WINDOW, BASES[0]), REACH)
    taken = np.empty(len(full), dtype=np.int64)
    for lo in range(0, len(full), 1 << 16):
        some = full[lo : lo + (1 << 16)]
        taken[lo : lo + len(some)] = some + REACH - 1 - rows[some, ::-1].argmin(axis=1)
    begin = np.flatnonzero(np.concatenate([[True], taken[1:] != taken[:-1]]))
    return taken[begin], full[begin], full[np.append(begin[1:], len(full)) - 1]


def windows(p: Parsed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and the two hashes of the windows taken."""
    at = seeds(p)[0]
    return at, span_hashes(p.h1, at, at + WINDOW, BASES[0]), span_hashes(p.h2, at, at + WINDOW, BASES[1])


def surroundings(p: Parsed, at: np.ndarray) -> np.ndarray:
    """Hashes of all words, and their places, that a passage around the windows ``at`` may have. What windows with one such hash are
    taken for is the same word by word and character by character."""
    step = np.diff(p.start, prepend=0)
    if len(step):
        step[np.concatenate([[True], p.doc[1:] != p.doc[:-1]])] = 0
    placed = mixed(p.h2 ^ (step.astype(np.uint64) * np.uint64(BASES[0])) ^ ((p.end - p.start).astype(np.uint64) * np.uint64(MIX)))
    lo = np.maximum(at - (REACH - 1), np.searchsorted(p.doc, p.doc[at], side="left"))
    hi = np.minimum(at + PASSAGE, np.searchsorted(p.doc, p.doc[at], side="right"))
    return mixed(span_hashes(placed, lo, hi, BASES[1]) + (at - lo).astype(np.uint64) * np.uint64(BASES[0]))


def thinned(at: np.ndarray, around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows to keep of those that overlap their forerunner's passage and are the same, as in a text that says the same over
    and over: the first, the last, the first apart from the first, and so many that their passages touch."""
    if not len(at):
        return np.zeros(0, dtype=bool)
    go_on = np.concatenate([[False], (around[1:] == around[:-1]) & (doc[1:] == doc[:-1]) & (np.diff(at) < PASSAGE)])
    d = at - at[np.maximum.accumulate(np.where(go_on, 0, np.arange(len(at))))]
    step = np.where(d < PASSAGE, d // (PASSAGE // 2 + 1), 2 + (d - PASSAGE) // (PASSAGE // 2))
    return ~go_on | np.append(~go_on[1:], True) | np.concatenate([[True], step[1:] != step[:-1]])


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paragraphs (window false) with their places, digest (``line``) and, the first time in a portion, band keys; and windows with the
    places of all that they are taken for. ``at`` gives the order in a text: a paragraph's start or the number of a window's first word."""
    for b in batches:
        ids, row_keys = b["doc_id"].to_numpy(), b["row_key"].to_numpy()
        for rows, texts in portions(b):
            p = parse(texts)
            begin, stop = paragraphs(p)
            node = digests(p, begin, stop)
            keys: list = [None] * len(node)
            once = list({x: k for k, x in reversed(list(enumerate(node)))}.values())  # the first of each in the portion
            for k, x in zip(once, _signed(band_keys(p, begin[once], stop[once])), strict=True):
                keys[k] = x
            at, low, high = seeds(p)
            around = surroundings(p, at)
            some = thinned(at, around, p.doc[at])
            at, low, high, around = at[some], low[some], high[some], around[some]
            first, last = np.concatenate([begin, low]), np.concatenate([stop, high + PASSAGE]) - 1
            doc = rows[p.doc[first]] if len(first) else np.zeros(0, dtype=np.int64)
            window = np.arange(len(first)) >= len(begin)
            start = p.start[first].astype(np.int64)
            base = np.searchsorted(p.doc, p.doc[at], side="left")
            yield pd.DataFrame(
                {
                    "doc_id": ids[doc],
                    "row_key": row_keys[doc],
                    "window": window,
                    "start": start,
                    "end": p.end[last].astype(np.int64),
                    "n_words": (last - first + 1).astype(np.int64),
                    "line": pd.Series([*node, *([None] * len(at))], dtype=object),
                    "keys": pd.Series([*keys, *([None] * len(at))], dtype=object),
                    "node": _signed(np.concatenate([np.zeros(len(node), dtype=np.uint64), span_hashes(p.h1, at, at + WINDOW, BASES[0])])),
                    "around": _signed(np.concatenate([np.zeros(len(node), dtype=np.uint64), around])),
                    "at": np.concatenate([start[: len(begin)], at - base]).astype(np.int64),
                    "lead": np.concatenate([np.zeros(len(begin), dtype=np.int64), at - low]).astype(np.int64),
                }
            )


def _wanted(marks: np.ndarray):
    """Of the windows that are marked, the hashes of all passages that they are taken for, and where these begin and end, in
    characters from the beginning of the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row_keys = b["row_key"].to_numpy()
            for rows, texts in portions(b):
                p = parse(texts)
                at, low, high = seeds(p)
                around = surroundings(p, at)
                word = at - np.searchsorted(p.doc, p.doc[at], side="left")
                of = row_keys[rows[p.doc[at]]] if len(at) else row_keys[:0]
                place = ((around >> np.uint64(8)) ^ (of.astype(np.int64).view(np.uint64) >> np.uint64(8)) ^ word.astype(np.uint64)).astype(np.int64) & (MARKS - 1)
                set_ = marked(marks, place)
                at, low, high, around, word, of = at[set_], low[set_], high[set_], around[set_], word[set_], of[set_]
                size = high - low + 1
                cut = np.cumsum(size)
                x = np.arange(cut[-1] if len(cut) else 0) + np.repeat(low - (cut - size), size)
                base = np.repeat(p.start[low], size)
                each = [_signed(span_hashes(p.h2, x, x + PASSAGE, BASES[1])), (p.start[x] - base).astype(np.int64), (p.end[x + PASSAGE - 1] - base).astype(np.int64)]
                lists = [pd.Series(np.split(v, cut[:-1]) if len(cut) else [], dtype=object) for v in each]
                node = _signed(span_hashes(p.h1, at, at + WINDOW, BASES[0]))
                yield pd.DataFrame({"row_key": of, "at": word.astype(np.int64), "node": node, "around": _signed(around), "hashes": lists[0], "starts": lists[1], "ends": lists[2]})

    return run


def _marks(places: DataFrame) -> np.ndarray:
    """A table of ``MARKS`` bits of which those at ``places`` (at) are set: of one size whatever the input's. The fuller it is, the more
    is fetched that nobody asked for, up to all; what was asked for is joined to it by key, so results don't depend on it."""
    at = F.pmod("at", F.lit(MARKS))
    parts = places.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod(at, F.lit(1 << 15)) + 1)).alias("bits")).collect()
    out = np.zeros((MARKS >> 15, 4096), dtype=np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.ravel()


def marked(marks: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _line_texts(marks: np.ndarray):
    """Texts of the paragraphs whose mark is set: all that are asked for, and few others while the table is not full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b["row_key"].to_numpy()
            for rows, texts in portions(b):
                p = parse(texts)
                begin, stop = paragraphs(p)
                node = digests(p, begin, stop)
                set_ = marked(marks, marks_of(node) & (MARKS - 1))
                begin, stop, node = begin[set_], stop[set_], [x for x, yes in zip(node, set_.tolist(), strict=True) if yes]
                doc = p.doc[begin] if len(begin) else np.zeros(0, dtype=np.int64)
                start, end = (p.start[begin], p.end[stop - 1]) if len(begin) else (doc, doc)
                lines = [texts[d][s:e] for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)]
                yield pd.DataFrame({"row_key": keys[rows[doc]] if len(doc) else keys[:0], "start": start.astype(np.int64), "node": pd.Series(node, dtype=object), "line": pd.Series(lines, dtype=object)})

    return run


def shingle_set(line: str) -> frozenset:
    words = line.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def _verified(similarity: float):
    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        sets = [shingle_set(x) for x in g["line"]]
        nodes = g["node"].tolist()
        low, crossed = g["lo_block"].iat[0], g["lo_block"].iat[0] != g["hi_block"].iat[0]
        left = [k for k, x in enumerate(g["block"].tolist()) if x == low]
        right = [k for k, x in enumerate(g["block"].tolist()) if x != low] if crossed else left
        forest = Forest()
        for i in left:
            for j in right:
                if (not crossed and j <= i) or forest.find(nodes[i]) == forest.find(nodes[j]):
                    continue
                a, b = sets[i], sets[j]
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and (both := len(a & b)) >= similarity * (len(a) + len(b) - both):
                    forest.join(nodes[i], nodes[j])
        edges = list(forest.edges())
        return pd.DataFrame(edges, columns=["a", "b"]) if edges else None

    return run


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key(docs).alias("row_key"))


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text. With the doc_id beside it, it tells rows apart: rows with one doc_id and text are one record."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce("text", F.lit("")))


def _seen_again(windows: DataFrame) -> DataFrame:
    """The windows that stand more than once. Most stand once: these go by their number alone, before anything else of them is gathered."""
    often = windows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    return stored(windows.join(often, "node", "left_semi"))


def _windowed(ready: DataFrame, seen: DataFrame, place: Column) -> DataFrame:
    """The maximal runs of words of which every ``PASSAGE`` in a row stand elsewhere too.

    Equal passages of ``PASSAGE`` words have the same window taken, so only windows that stand twice are looked at. Those with
    the same surroundings are one: each passage around them is repeated as often. Where surroundings differ, the first window of
    each is asked for the hashes of its passages. So nothing is compared in pairs, and a passage that the first text with
    a window does not share is found among the others.
    """
    again = seen.groupBy("node").agg((F.min("around") != F.max("around")).alias("differ"), (F.min(place) != F.max(place)).alias("twice")).filter("twice").drop("twice")
    taken = seen.join(again, "node")
    same = stored(taken.groupBy("node", "around", "differ").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("own"), (F.min(place) != F.max(place)).alias("twice"), F.first("n_words").alias("n_words"), F.first(F.col("end") - F.col("start")).alias("length")))
    odd = same.filter("differ").select("node", "around", "n", "own", "twice", F.col("own.row_key").alias("row_key"), F.col("own.at").alias("at"))
    marks = _marks(odd.select(F.shiftrightunsigned("around", 8).bitwiseXOR(F.shiftrightunsigned("row_key", 8)).bitwiseXOR(F.col("at")).alias("at")))
    asked = ready.select("text", "row_key").mapInPandas(_wanted(marks), "row_key long, at long, node long, around long, hashes array<long>, starts array<long>, ends array<long>")
    asked = asked.join(odd, ["node", "around", "row_key", "at"]).dropDuplicates(["node", "around"])
    each = stored(asked.select("node", "around", "n", "own", "twice", F.posexplode(F.arrays_zip("hashes", "starts", "ends"))).select("node", "around", "n", "own", "twice", F.col("pos").alias("k"), "col.*"))
    alone = Window.partitionBy("node", "hashes")
    each = each.withColumns({"total": F.sum("n").over(alone), "first": F.min("own").over(alone), "again": F.bool_or("twice").over(alone) | (F.min("own").over(alone) != F.max("own").over(alone))}).filter("again")
    # a passage that overlaps the first one in its own text goes on with it
    alike = lambda one, other: one["row_key"].eqNullSafe(other["row_key"]) & one["doc_id"].eqNullSafe(other["doc_id"])
    apart = lambda one, other: ~alike(one, other) | (one["at"] - other["at"] >= PASSAGE)
    is_first = F.col("first") == F.col("own")
    ends = ((F.min, "starts", "start"), (F.max, "ends", "end"), (F.min, "k", "low"), (F.max, "k", "high"), (F.max, "total", "n"), (F.min, "first", "first"))
    span = lambda cond: F.struct(*(f(F.when(cond, F.col(c))).alias(name) for f, c, name in ends))
    told = each.groupBy("node", "around").agg(span(is_first).alias("begun"), span(~is_first & apart(F.col("own"), F.col("first"))).alias("met"), span(F.lit(True)).alias("all"), F.first("own").alias("own"))
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(0).alias("low"), (F.col("n_words") - PASSAGE).cast("int").alias("high"), F.col("n").alias("n"), F.col("own").alias("first"))
    none = F.lit(None).cast(told.schema["met"].dataType)
    plain = same.filter("not differ").select("node", "around", whole.alias("begun"), none.alias("met"), whole.alias("all"), "own")
    spread = taken.drop("differ").join(told.unionByName(plain), ["node", "around"])
    here = F.struct("doc_id", "row_key", "at")
    own = alike(here, F.col("own")) & (F.col("at") == F.col("own.at"))
    later = F.when(apart(here, F.col("own")), F.col("all")).otherwise(F.col("met"))
    part = lambda kept, s: F.struct(F.lit(kept).alias("kept"), s.alias("s"))
    both = F.when(own, F.array(part(True, F.col("begun")), part(False, F.col("met")))).otherwise(F.array(part(False, later)))
    parts = spread.select("doc_id", "row_key", "node", "start", F.col("at").alias("word"), "lead", F.explode(both).alias("p"))
    parts = parts.filter("p.s.start is not null").select(
        "doc_id",
        "row_key",
        "node",
        F.col("p.kept").alias("kept"),
        (F.col("start") + F.col("p.s.start")).alias("start"),
        (F.col("start") + F.col("p.s.end")).alias("end"),
        (F.col("word") - F.col("lead") + F.col("p.s.low")).alias("low"),
        (F.col("word") - F.col("lead") + F.col("p.s.high") + PASSAGE).alias("high"),
        F.col("p.s.n").alias("n"),
        F.col("p.s.first").alias("first"),
    )
    order = Window.partitionBy("doc_id", "row_key", "kept").orderBy("low", "high", "node")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = parts.withColumn("new", F.when(F.col("low") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "row_key", "kept", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("high") - F.min("low")).cast("long").alias("n_words"),
        F.min(F.struct("low", "high", "node", "n", "first")).alias("head"),
    )


def repeated_passages(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Every occurrence of a repeated passage in ``docs`` (doc_id, text).

    A passage is a paragraph (line) of ``MIN_WORDS`` words or more, repeated if another has the same words or, by the Jaccard
    similarity of the sets of 5-word shingles, at least ``similarity``; or a window: a run of ``PASSAGE`` words or more, as long as
    it can be, of which every ``PASSAGE`` stand elsewhere too, in any paragraphs. Shorter runs are none. Case of A-Z and white space do not matter. Returns row_key, doc_id, kind
    (``paragraph`` or ``window``), start, end (code points of the text), n_words, class_id, occurrences (in the
    class), first_doc_id and kept (it is the class's first occurrence, by doc_id, start and row_key). A run that is kept holds the words that
    stand here first, one that is not kept those that stand earlier; class_id, occurrences and first_doc_id are those of its beginning.

    Rows with one doc_id and text are one record, whose runs come once, though each counts as an occurrence; null and empty texts have no passages; a null doc_id comes after
    all; an empty table gives no rows; other columns are left out. Classes of paragraphs are components of
    verified pairs. Equal paragraphs are one before bands are compared, pairs of a large bucket are dealt in blocks, and
    texts are fetched for verification only where a band has met.
    """
    bounded_batches(docs.sparkSession)
    ready = _ready(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    units = kept(ready.mapInPandas(_units, f"doc_id {kind}, row_key long, window boolean, start long, end long, n_words long, line binary, keys array<long>, node long, around long, at long, lead long"))
    found = stored(units.filter("not window").select("doc_id", "row_key", "start", "end", "n_words", F.col("line").alias("node"), "keys", "at"))
    seen = _seen_again(units.filter("window").drop("window", "line", "keys"))
    units.unpersist()  # what is wanted of it is stored
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at", "row_key")
    count = [F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("twice")]
    # equal ones are one node; those that stand once stay in, for they may be near others
    lines = stored(found.groupBy("node").agg(*count))
    # a short name of each node travels with the keys; whatever nodes share one are all looked at
    short = F.xxhash64("node").alias("short")
    banded = found.filter("keys is not null").select(short, F.explode("keys").alias("key"))
    # a window, so that keys are dealt out once: for telling which several have, and for those that have them
    same_key = Window.partitionBy("key")
    members = banded.withColumn("shared", F.min("short").over(same_key) != F.max("short").over(same_key)).filter("shared")
    members = stored(members.select("key", "short").distinct())
    named = found.select("node", short).join(members.select("short").distinct(), "short", "left_semi").distinct()
    dealt = stored(with_pair_blocks(different_buckets(members, "key", "short").join(named, "short").select("key", "node"), ["key"], "node", BLOCK_ROWS))
    asked = named.select("node")
    met = asked.join(lines, "node").select("node", F.col("first.row_key").alias("row_key"), F.col("first.at").alias("start"))
    fetched = ready.select("row_key", "text").mapInPandas(_line_texts(_marks(asked.select(mark_of(F.col("node")).alias("at")))), "row_key long, start long, node binary, line string")
    texts = fetched.join(met, ["row_key", "start", "node"], "left_semi").select("node", "line").dropDuplicates(["node"])
    pairs = map_groups(dealt.join(texts, "node"), ["key", "lo_block", "hi_block"], _verified(similarity), "a binary, b binary")
    roots = connected_components(pairs)
    classed = lines.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "n", "first", "twice", F.coalesce("component", "node").alias("class_id"))
    totals = classed.groupBy("class_id").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first"), (F.bool_or("twice") | (F.count(F.lit(1)) > 1)).alias("twice")).filter("twice")
    line_classes = classed.select("node", "class_id").join(totals.drop("twice"), "class_id")
    lined = found.join(line_classes, "node")
    runs = _windowed(ready, seen, place)
    return lined.select(
        "row_key",
        "doc_id",
        F.lit("paragraph").alias("kind"),
        "start",
        "end",
        "n_words",
        F.lower(F.hex("class_id")).alias("class_id"),
        "occurrences",
        F.col("first.doc_id").alias("first_doc_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.at")) & (F.col("row_key") == F.col("first.row_key"))).alias("kept"),
    ).unionByName(
        runs.select(
            "row_key",
            "doc_id",
            F.lit("window").alias("kind"),
            "start",
            "end",
            "n_words",
            F.lower(F.hex("head.node")).alias("class_id"),
            F.col("head.n").alias("occurrences"),
            F.col("head.first.doc_id").alias("first_doc_id"),
            "kept",
        )
    )


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def without_repeats(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text and any others) with every occurrence of a repeated passage but the first cut out of the texts.

    All rows and columns stay; a text that is all repeats becomes white space or empty, a null stays null. The first is that of the
    least doc_id, then the earliest in the text, then the least row key, so ties are decided; rows that agree in doc_id and text are
    one record and are cut alike, each. An empty table gives no rows. A text is held whole by the task that cuts it."""
    key, of, cut, owner = (fresh(docs, x) for x in ("row_key", "of_key", "cut", "owner"))
    spans = repeated_passages(docs, similarity).filter("not kept").groupBy(F.col("doc_id").alias(owner), F.col("row_key").alias(of)).agg(F.collect_set(F.struct("start", "end")).alias(cut))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else _without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(without("text", cut))
    whole = docs.withColumn(key, row_key(docs))
    whole = whole.join(spans, (F.col(key) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(owner)), "left").withColumn("text", text)
    return whole.select(*(F.col(f"`{c}`") for c in docs.columns))
