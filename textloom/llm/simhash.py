"""SimHash near-dedup by a self-join of binary tries, and near copies at a similarity that it alone does not reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bounded_batches, different_buckets, fresh, portions, stored, with_pair_blocks
from .components import connected_components
from .forest import ArrayForest, Forest
from .grouping import map_groups
from .paragraphs import BASES, SHINGLE, _signed, band_keys, digests, parse, span_hashes
from .xxh64 import span_digests

BITS = 64
#: Fingerprints are looked up by the bits of each segment in turn. Four differing bits spread over three segments
#: leave one with at most one of them.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints that a cell of the upper trie should hold, and node pairs that a lower trie holds at once.
CELL_ROWS, FRONTIER = 256, 1 << 16
#: Fingerprints of a cell, guests included, that one task holds at most, twice.
CELL_BLOCK = 1 << 13
#: Distinct texts of a bucket of candidates that meet in one group, twice.
COPIES_ROWS = 128
#: The white space of words.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: The digest of no words.
EMPTY = bytes(16)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return int(fingerprints_of([text], shingle)[0])


def fingerprints_of(texts: list[str | None], shingle: int = 4) -> np.ndarray:
    """Majority bits of the XXH64 (seed 42) of all shingles of each text's lower-cased words, repeats included."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    every = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = SPACE[every]
    before = np.concatenate([[True], space[:-1]])
    # one blank stays after each word
    stays = ~(space & before)
    data = np.where(space[stays], np.uint8(32), every[stays])
    last_byte = np.flatnonzero(data == 32)
    start = np.concatenate([[0], last_byte[:-1] + 1]) if len(last_byte) else last_byte
    size = last_byte - start
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    count = np.bincount(np.searchsorted(begins, np.flatnonzero(~space & before), side="right") - 1, minlength=len(texts))
    data = data.tobytes()
    n = np.where(count > 0, np.maximum(1, count - shingle + 1), 0)
    stop = np.cumsum(n)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.arange(len(doc)) + np.repeat((np.cumsum(count) - count) - (stop - n), n)
    last = first + np.repeat(np.minimum(count, shingle), n) - 1
    totals = np.zeros((len(texts), BITS), dtype=np.int64)
    for lo in range(0, len(doc), FRONTIER):
        part = slice(lo, lo + FRONTIER)
        h = span_digests(data, start[first[part]], start[last[part]] + size[last[part]], 42)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.diff(doc[part], prepend=-1))
        totals[doc[part][begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * totals > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (a signed long of the same bits) of every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows, texts in portions(b):
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[rows].to_numpy(), "fp": fingerprints_of(texts, shingle).view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp long")


def _rotated(fps: np.ndarray, start: int) -> np.ndarray:
    """The bits from ``start`` on come first, as those of highest value."""
    return (fps << np.uint64(start)) | (fps >> np.uint64(BITS - start)) if start else fps


def trie_links(home: np.ndarray, guests: np.ndarray | None, depth: int, segment: int, errors: int, forest: ArrayForest) -> None:
    """Join all pairs within ``errors`` bits of two sorted arrays of rotated fingerprints (or of one with itself).

    An array is a trie: a node is a range of values that agree in their first bits. From the roots, which agree
    within in ``depth`` bits, pairs of nodes go down together; a pair is dropped once its ranges' common bits differ
    in more than ``errors``, or in more than one of the first ``segment``. Pairs are taken from a stack in portions,
    so memory does not grow with their number.
    """
    a, b = home, home if guests is None else guests
    if not len(a) or not len(b):
        return
    first = np.array([[0, len(a), 0, len(b)]], dtype=np.int64)
    stack = [(depth, first)]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(bit, pairs[i : i + FRONTIER]) for i in range(0, len(pairs), FRONTIER)]
            continue
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16
        if bit == BITS:
            small[:] = True
        _leaves(a, b, pairs[small], guests is None, segment, errors, forest)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        mask = np.uint64(1) << np.uint64(BITS - 1 - bit)
        am, bm = _split(a, pairs[:, 0], pairs[:, 1], mask), _split(b, pairs[:, 2], pairs[:, 3], mask)
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                p = np.stack([am if x else pairs[:, 0], pairs[:, 1] if x else am, bm if y else pairs[:, 2], pairs[:, 3] if y else bm], axis=1)
                parts.append(p[(p[:, 0] < p[:, 1]) & (p[:, 2] < p[:, 3])])
        p = np.concatenate(parts)
        if guests is None:
            p = p[p[:, 0] <= p[:, 2]]
        if len(p):
            fixed = np.uint64(((1 << (bit + 1)) - 1) << (BITS - 1 - bit))
            differ = (a[p[:, 0]] ^ b[p[:, 2]]) & fixed
            head = np.uint64(((1 << segment) - 1) << (BITS - segment))
            p = p[(np.bitwise_count(differ) <= errors) & (np.bitwise_count(differ & head) <= 1)]
        if len(p):
            stack.append((bit + 1, p))


def _split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Where in each range the bit ``mask``, the first that may differ, turns to 1: a bisection of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (v[np.minimum(mid, len(v) - 1)] & mask) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _leaves(a, b, pairs, same, segment, errors, forest) -> None:
    if not len(pairs):
        return
    na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    each = np.repeat(np.arange(len(pairs)), na * nb)
    k = np.arange(len(each)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    i, j = pairs[each, 0] + k // nb[each], pairs[each, 2] + k % nb[each]
    if same:
        i, j = i[i < j], j[i < j]
    differ = a[i] ^ b[j]
    near = np.bitwise_count(differ) <= errors
    forest.join(a[i[near]], b[j[near]])


def _cells(prefix: int, errors: int):
    """Deal each fingerprint to its cell of the upper trie and, as a guest, to those with one more bit set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy().astype(np.uint64)
            for s, (start, _) in enumerate(SEGMENTS):
                r = _rotated(fps, start)
                cell = (r >> np.uint64(BITS - prefix)).astype(np.int64) if prefix else np.zeros(len(r), dtype=np.int64)
                yield pd.DataFrame({"segment": s, "cell": cell, "guest": False, "fp": b["fp"]})
                for bit in range(prefix if errors else 0):
                    low = (cell >> bit) & 1 == 0
                    yield pd.DataFrame({"segment": s, "cell": cell[low] | (1 << bit), "guest": True, "fp": b["fp"].to_numpy()[low]})

    return run


def _joined(prefix: int, errors: int):
    """Links within a cell, or between two blocks of one: of its own fingerprints with each other and with guests."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        start, length = SEGMENTS[key[0]]
        r = _rotated(group["fp"].to_numpy().astype(np.uint64), start)
        guest, first = group["guest"].to_numpy(), (group["block"] == key[2]).to_numpy()
        crossed = key[2] != key[3]
        forest = ArrayForest(r)

        def visits(home: np.ndarray, guests: np.ndarray) -> None:
            # guests' first bits differ from the cell's in one bit, which may stand at any place of the prefix
            for bit in range(prefix if len(home) else 0):
                of = guests[((guests ^ home[0]) >> np.uint64(BITS - prefix)) == np.uint64(1 << bit)]
                trie_links(home, of, prefix, length, errors, forest)

        home, guests = ([np.sort(r[(guest == g) & (first == f)]) for f in (True, False)] for g in (False, True))
        trie_links(home[0], home[1] if crossed else None, prefix, length, errors, forest)
        visits(home[0], guests[1] if crossed else guests[0])
        if crossed:
            visits(home[1], guests[0])
        edges = forest.edges()
        back = _rotated(edges, BITS - start) if start else edges
        return pd.DataFrame({"a": back[:, 0].astype(np.int64), "b": back[:, 1].astype(np.int64)})

    return run


def fingerprint_links(distinct: DataFrame, errors: int = 4) -> DataFrame:
    """Links (a, b) that join the same fingerprints of ``distinct`` (fp) as all pairs within ``errors`` bits do.

    The upper levels of the trie are walked by the shuffle: a fingerprint goes to the cell of its first bits and to
    the cells that a pair of nodes with one differing bit leads to; the lower levels are walked in the cells. This is
    done for three orders of the bits, since every pair within four bits differs in at most one bit of one of the
    segments 0-20, 21-41, 42-63. Cells are the smaller the more fingerprints there are; one with very many all the same, as near copies
    give, is dealt in blocks, each of which meets each other.
    """
    if errors > 2 * len(SEGMENTS) - 1:
        raise ValueError("errors: more than the segments allow")
    n = distinct.count()
    prefix = min(SEGMENTS[0][1], max(0, int(np.ceil(np.log2(max(1, n) / CELL_ROWS)))))
    cells = distinct.mapInPandas(_cells(prefix, errors), "segment int, cell long, guest boolean, fp long")
    dealt = with_pair_blocks(cells, ["segment", "cell"], "fp", CELL_BLOCK)
    return dealt.groupBy("segment", "cell", "lo_block", "hi_block").applyInPandas(_joined(prefix, errors), "a long, b long")


def near_duplicates(docs: DataFrame, errors: int = 4, shingle: int = 4) -> DataFrame:
    """Fingerprint and class of every row of ``docs`` (doc_id, text).

    Documents link if their fingerprints differ in at most ``errors`` bits (equal ones included); classes are the
    components of all links. Returns doc_id, fingerprint (16 hex digits), component_id (the least doc_id of the
    class). Fewer words than a shingle are one shingle; null, empty and wordless texts have fingerprint zero and
    link like others. Repeated rows are in one class; a null doc_id is no class id unless alone; an empty table
    gives no rows; other columns are left out. Fingerprints are unique before they are compared, so copies in any
    number cost one comparison.
    """
    prints = stored(fingerprints(docs, shingle))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(distinct.select("fp"), errors)
    roots = connected_components(links)
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).cast(StringType())
    return prints.join(classes, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of all words of each text, its fingerprint, and MinHash band keys; none for texts of fewer words than a shingle."""
    for b in batches:
        for rows, texts in portions(b):
            p = parse(texts)
            begin, stop = np.searchsorted(p.doc, np.arange(len(texts)), side="left"), np.searchsorted(p.doc, np.arange(len(texts)), side="right")
            long = stop - begin >= SHINGLE
            lists = [None] * len(texts)
            full = np.flatnonzero(stop > begin)
            nodes = [EMPTY] * len(texts)
            for k, x in zip(full.tolist(), digests(p, begin[full], stop[full]), strict=True):
                nodes[k] = x
            for k, v in zip(np.flatnonzero(long).tolist(), _signed(band_keys(p, begin[long], stop[long])), strict=True):
                lists[k] = v
            yield pd.DataFrame({"row": b["row"].to_numpy()[rows], "doc_id": b["doc_id"].to_numpy()[rows], "node": pd.Series(nodes, dtype=object), "keys": pd.Series(lists, dtype=object), "fp": fingerprints_of(texts, SHINGLE).view(np.int64)})


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for rows, texts in portions(b):
            p = parse(texts)
            at = np.arange(max(0, len(p.h1) - SHINGLE + 1))
            h = _signed(span_hashes(p.h1, at, at + SHINGLE, BASES[1]))
            begin, stop = np.searchsorted(p.doc, np.arange(len(texts)), side="left"), np.searchsorted(p.doc, np.arange(len(texts)), side="right")
            sets = [np.unique(h[x : max(x, y - SHINGLE + 1)]) for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield pd.DataFrame({"node": b["node"].to_numpy()[rows], "shingles": pd.Series(sets, dtype=object)})


def _verified(similarity: float):
    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        sets, nodes = g["shingles"].tolist(), g["node"].tolist()
        low, crossed = g["lo_block"].iat[0], g["lo_block"].iat[0] != g["hi_block"].iat[0]
        left = [k for k, x in enumerate(g["block"].tolist()) if x == low]
        right = [k for k, x in enumerate(g["block"].tolist()) if x != low] if crossed else left
        forest = Forest()
        for i in left:
            for j in right:
                if (not crossed and j <= i) or forest.find(nodes[i]) == forest.find(nodes[j]):
                    continue
                a, b = sets[i], sets[j]
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and (both := len(np.intersect1d(a, b, assume_unique=True))) >= similarity * (len(a) + len(b) - both):
                    forest.join(nodes[i], nodes[j])
        edges = list(forest.edges())
        return pd.DataFrame(edges, columns=["a", "b"]) if edges else None

    return run


def one_of_each(docs: DataFrame, similarity: float = 0.8, errors: int = 4) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each class of near copies: the one with the least doc_id, then the
    least digest of doc_id and text; of rows that agree in both, any one.

    Texts link if they have the same words, or if the Jaccard similarity of the sets of their 5-word shingles is ``similarity`` or
    more; classes are the components of all links found. Candidates are texts whose fingerprints (of 5-word shingles) are in one
    component of ``fingerprint_links``. Fingerprints of 64 bits alone find too few: at a similarity of 0.9 a third of the pairs
    are within four bits, at 0.8 one in fifteen, and at the ten bits these need a trie prunes nothing. So texts that share a MinHash
    band are candidates too, which a pair at 0.8 does with probability 0.995, closer ones more often; all are verified exactly.

    Null, empty and wordless texts are the same, and link with no other. Texts of fewer words than a shingle link with equal ones.
    Equal texts are one before they are compared, and pairs of a large bucket are dealt in blocks. All columns stay; an empty table
    gives no rows.
    """
    bounded_batches(docs.sparkSession)
    name = fresh(docs, "row")
    # 128 bits of doc_id and text
    own = F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("~")), F.md5(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumn(name, F.unhex(own))
    ready = keyed.select(F.coalesce("text", F.lit("")).alias("text"), F.col(name).alias("row"), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    told = ready.mapInPandas(_texts, f"row binary, doc_id {kind}, node binary, keys array<long>, fp long")
    nodes = stored(told.groupBy("node").agg(F.min(place).alias("least"), F.min("keys").alias("keys"), F.min("fp").alias("fp")))
    roots = connected_components(fingerprint_links(nodes.filter("keys is not null").select("fp").distinct(), errors)).withColumnRenamed("node", "fp")
    alike = nodes.filter("keys is not null").select("node", "fp").join(roots, "fp", "left").select("node", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("key"))
    banded = nodes.select("node", F.explode("keys").alias("key")).unionByName(alike)
    dealt = stored(with_pair_blocks(different_buckets(stored(banded.distinct()), "key", "node"), ["key"], "node", COPIES_ROWS))
    asked = dealt.select("node").distinct().join(nodes, "node").select("node", F.col("least.row").alias("row"))
    sets = ready.join(asked, "row").dropDuplicates(["node"]).select("node", "text").mapInPandas(_shingles, "node binary, shingles array<long>")
    pairs = map_groups(dealt.join(sets, "node"), ["key", "lo_block", "hi_block"], _verified(similarity), "a binary, b binary")
    classes = nodes.select("node", "least").join(connected_components(pairs), "node", "left").select("least", F.coalesce("component", "node").alias("root"))
    chosen = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(name))
    once = keyed.join(chosen, name, "left_semi")
    return once.dropDuplicates([name]).select(*(F.col(f"`{c}`") for c in docs.columns))
