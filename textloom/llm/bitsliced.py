"""Ranked lexical search over an index of bit slices.

Documents lie in blocks. Of every term a block keeps, for each bit of its impacts, a bitmap over the block's documents. A query's scores
are sums of such numbers: bitmaps are added with carries, for all documents and all queries of a group at once, and the best documents are
found from the highest bitmap of the sums down.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, stored
from .grouping import map_groups

#: Documents of a block at most, and bytes of its texts that close it.
BLOCK_ROWS, BLOCK_BYTES = 1 << 12, 1 << 23
#: Terms of queries, counted by query, that one pass over the index answers; a group of queries has at most so many, or is one query.
GROUP_TERMS = 1 << 14
#: Queries whose sums are held at once.
TOGETHER = 256
#: Bytes of a text that belong to terms as they are; capital letters are lowered and all others part terms.
_TERM_BYTES = bytes(i if i >= 0x80 or chr(i).isdigit() or chr(i).islower() else i + 32 if chr(i).isupper() else 0x20 for i in range(256))
TOTALS = "documents long, length long"
SLICED = "block long, term string, df int, slices int, at binary, bits binary"
FOUND = "query long, doc_id long, score long"


def split_terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of digits, letters and whatever is not ASCII, with A-Z lowered."""
    return (text or "").encode().translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Index:
    """``sliced``: of each block and term the bitmaps of its impacts, and with an empty term the block's documents; ``weights``: term, df, weight;
    ``documents`` and ``length``: how many have a term, and their terms together."""

    sliced: DataFrame
    weights: DataFrame
    documents: int
    length: int


@dataclass(frozen=True)
class Block:
    """``ids``: of documents in order (null last), with their ``sizes``; ``terms`` in order, with their ``dfs``; of each term its documents
    (places in ``ids``) in order, with their ``tfs``."""

    ids: list[int | None]
    sizes: np.ndarray
    terms: list[bytes]
    dfs: np.ndarray
    docs: np.ndarray
    tfs: np.ndarray


def _block(ids: list[int | None], found: list[np.ndarray], vocabulary: list[bytes]) -> Block:
    """The block of documents of which ``found`` has the terms, as places in ``vocabulary``."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    by_term = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    rank = np.empty(len(vocabulary), np.int64)
    rank[by_term] = np.arange(len(vocabulary))
    sizes = np.array([len(own) for own in found])
    code = rank[np.concatenate(found)]
    code *= len(ids)
    code += np.repeat(place, sizes)
    code.sort()
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    tf = np.diff(starts, append=len(code))
    term, doc = np.divmod(code[starts], len(ids))
    return Block([ids[k] for k in order], sizes[order], [vocabulary[k] for k in by_term], np.bincount(term, minlength=len(vocabulary)), doc.astype(np.int32), tf.astype(np.int32))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of neighbouring rows (doc_id, text)."""
    new = lambda: ([], [], defaultdict(count().__next__))
    held, (ids, found, known) = 0, new()
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            terms = split_terms(text := text.as_py())
            found.append(np.fromiter(map(known.__getitem__, terms), np.int32, len(terms)))
            ids.append(doc_id.as_py())
            held += len(text or "")
            if len(ids) >= BLOCK_ROWS or held >= BLOCK_BYTES:
                yield _block(ids, found, list(known))
                held, (ids, found, known) = 0, new()
    if ids:
        yield _block(ids, found, list(known))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task have a term, and their terms together."""
    documents = length = 0
    for b in batches:
        for text in b.column(0):
            n = len(split_terms(text.as_py()))
            documents += n > 0
            length += n
    yield pa.RecordBatch.from_pydict({"documents": [documents], "length": [length]})


def impacts(tf: np.ndarray, size: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in a document of ``size`` terms, in 64-bit integers, below 2^20."""
    norm = 25 + (75 * size * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def _sliced(block: int, own: Block, documents: int, length: int, most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows of SLICED of one block. Of a term's bitmaps only bytes that hold a document are kept: ``at`` says which, in two
    bytes each, and ``bits`` has the slices of one such byte after the other's, least first."""
    known = np.packbits([k is not None for k in own.ids], bitorder="little")
    head = np.array([k or 0 for k in own.ids], "<i8")
    yield _rows(block, [b""], np.zeros(1), 0, np.array([0, head.nbytes]), head, np.array([0, known.nbytes]), known)
    first = np.concatenate([[0], np.cumsum(own.dfs)])
    for lo in range(0, len(own.dfs), most):
        dfs, (begin, end) = own.dfs[lo : lo + most], first[[lo, min(lo + most, len(own.dfs))]]
        docs = own.docs[begin:end]
        value = impacts(own.tfs[begin:end].astype(np.int64), own.sizes[docs], documents, length)
        slices = max(1, int(value.max()).bit_length())
        # bytes that hold a document, term by term, and in each slice the bits of the documents that share a byte
        owner = np.repeat(np.arange(len(dfs)), dfs)
        new = np.ones(len(docs), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (docs[1:] >> 3 != docs[:-1] >> 3)
        starts = np.flatnonzero(new)
        at = (docs[starts] >> 3).astype("<u2")
        bit = (1 << (docs & 7)).astype(np.uint8)
        plane = np.empty((len(starts), slices), np.uint8)
        for s in range(slices):
            plane[:, s] = np.bitwise_or.reduceat(np.where(value >> s & 1, bit, 0).astype(np.uint8), starts)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[starts], minlength=len(dfs)))])
        yield _rows(block, own.terms[lo : lo + most], dfs, slices, bounds * 2, at, bounds * slices, plane)


def _rows(block: int, terms: list[bytes], dfs: np.ndarray, slices: int, at_bounds: np.ndarray, at: np.ndarray, bit_bounds: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    n = len(terms)
    binary = lambda bounds, data: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    columns = [pa.array(np.full(n, block), pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(dfs.astype(np.int32)), pa.array(np.full(n, slices), pa.int32()), binary(at_bounds, at), binary(bit_bounds, bits)]
    return pa.RecordBatch.from_arrays(columns, ["block", "term", "df", "slices", "at", "bits"])


def build_index(docs: DataFrame) -> Index:
    """Index all of ``docs`` (doc_id, text), as tables in the shared folder.

    The texts are read twice, so ``docs`` has to give the same rows both times: impacts lean on the number and the length of all documents,
    which are counted first; then terms are counted and bitmaps made where a document lies, in blocks of neighbouring rows, of which a task
    holds one at a time, however many it is given. What is shuffled are counts of terms by block. A part of the index is sorted by term, so a search of few terms skips the others. Null, empty and termless texts are documents that no
    query finds and that no statistics count; rows of one doc_id are documents of their own; a null doc_id comes after all others."""
    bounded_batches(docs.sparkSession)
    one = docs.select("text").mapInArrow(_totals, TOTALS).agg(F.sum("documents").alias("n"), F.sum("length").alias("l")).first()
    documents, length = int(one["n"] or 0), int(one["l"] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for nth, own in enumerate(_blocks(batches)):
            yield from _sliced(first + nth, own, documents, length)

    sliced = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SLICED).sortWithinPartitions("term"))
    df = sliced.filter("term <> ''").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
    weights = stored(df.select("term", "df", weight.cast("long").alias("weight")))
    return Index(sliced, weights, documents, length)


def _powers(times: int) -> list[int]:
    return [s for s in range(times.bit_length()) if times >> s & 1]


def add_into(total: np.ndarray, more: np.ndarray) -> None:
    """Add numbers to others, both as slices (least first), bit by bit with a carry; ``total`` has room."""
    carry = np.zeros_like(total[0])
    for s in range(len(total)):
        if s < len(more):
            half = total[s] ^ more[s]
            carry, total[s] = (total[s] & more[s]) | (half & carry), half ^ carry
        else:
            carry, total[s] = total[s] & carry, total[s] ^ carry


def weighted(bits: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers as slices times a weight at each byte: shifted by every bit of the weights and added."""
    out = np.zeros((len(bits) + int(weight.max(initial=0)).bit_length(), bits.shape[1]), np.uint8)
    for s in range(int(weight.max(initial=0)).bit_length()):
        mask = np.where(weight >> s & 1, 0xFF, 0).astype(np.uint8)
        add_into(out[s:], bits & mask)
    return out


def top(slices: np.ndarray, k: int) -> np.ndarray:
    """Which documents are the ``k`` of highest number above 0, of each query: slices (least first) of queries by bytes. Of equal numbers the
    first documents are taken.

    ``sure`` are those that belong to the best in any case, ``level`` those that agree with the last of them in all slices so far."""
    level = np.bitwise_or.reduce(slices, axis=0)
    sure = np.zeros_like(level)
    for own in slices[::-1]:
        ahead = sure | (level & own)
        many = (np.bitwise_count(ahead).sum(axis=1, dtype=np.int64) > k)[:, None]
        sure = np.where(many, sure, ahead)
        level &= np.where(many, own, ~own)
    of = lambda x: np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")
    sure_bits, level_bits = of(sure), of(level)
    room = k - sure_bits.sum(axis=1, dtype=np.int64)
    return sure_bits.astype(bool) | (level_bits.astype(bool) & (np.cumsum(level_bits, axis=1, dtype=np.int64) <= room[:, None]))


@dataclass(frozen=True)
class Group:
    """Queries that are answered together. ``steps``: of each query its terms and the shift at which each is added, a repeated term once for
    every bit of its number; ``weights``: of the terms; ``bits``: slices that no sum outgrows."""

    queries: list[int]
    steps: list[list[tuple[str, int]]]
    weights: dict[str, int]
    bits: int

    @staticmethod
    def of(rows: list) -> Group:
        steps: dict[int, list[tuple[str, int]]] = {}
        sums: dict[int, int] = {}
        for r in rows:
            steps.setdefault(r["query"], []).extend((r["term"], s) for s in _powers(r["times"]))
            sums[r["query"]] = sums.get(r["query"], 0) + r["times"] * r["weight"]
        queries = sorted(steps, key=lambda q: -len(steps[q]))
        return Group(queries, [steps[q] for q in queries], {r["term"]: r["weight"] for r in rows}, (max(sums.values(), default=0) << 20).bit_length())

    def best(self, rows: pd.DataFrame, k: int) -> pd.DataFrame | None:
        """The ``k`` best documents of one block for every query: FOUND."""
        head = rows[rows["term"] == ""].iloc[0]
        ids = np.frombuffer(head["at"], "<i8")
        own = rows[rows["term"] != ""]
        if not len(own):
            return None
        width = -(-len(ids) // 64) * 8
        at = [np.frombuffer(a, "<u2").astype(np.intp) for a in own["at"]]
        bounds = np.concatenate([[0], np.cumsum([len(a) for a in at])]).tolist()
        bits = np.zeros((int(own["slices"].max()), bounds[-1]), np.uint8)
        for lo, hi, n, b in zip(bounds[:-1], bounds[1:], own["slices"].tolist(), own["bits"], strict=True):
            bits[:n, lo:hi] = np.frombuffer(b, np.uint8).reshape(hi - lo, n).T
        weight = np.repeat([self.weights[t] for t in own["term"]], [len(a) for a in at])
        worth = weighted(bits, weight)
        where = {t: i for i, t in enumerate(own["term"])}
        steps = [[(where[t], s) for t, s in some if t in where] for some in self.steps]
        order = sorted((q for q in range(len(steps)) if steps[q]), key=lambda q: -len(steps[q]))
        known = np.unpackbits(np.frombuffer(head["bits"], np.uint8), bitorder="little").astype(bool)
        out = []
        for lo in range(0, len(order), TOGETHER):
            some = order[lo : lo + TOGETHER]
            query, place, score = self._added([steps[q] for q in some], worth, at, bounds, width, k)
            doc = pd.Series(ids[place], dtype="Int64").mask(~known[place])
            out.append(pd.DataFrame({"query": np.array(self.queries)[np.array(some)[query]], "doc_id": doc, "score": score}))
        return pd.concat(out, ignore_index=True) if out else None

    def _added(self, steps: list[list[tuple[int, int]]], worth: np.ndarray, at: list[np.ndarray], bounds: list[int], width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of some queries, those of most steps first: query, place and score. Each step adds the next term of every query that has one."""
        total = np.zeros((self.bits, len(steps), width // 8), np.uint64)
        for nth in range(len(steps[0])):
            asking = [q for q in steps if len(q) > nth]
            more = np.zeros((min(self.bits, len(worth) + max(q[nth][1] for q in asking)), len(asking), width), np.uint8)
            for i, q in enumerate(asking):
                t, shift = q[nth]
                high = min(len(worth), len(more) - shift)
                more[shift : shift + high, i, at[t]] = worth[:high, bounds[t] : bounds[t + 1]]
            add_into(total[:, : len(asking)], more.view(np.uint64))
        query, place = np.nonzero(top(total, k))
        flat = total.view(np.uint8)
        score = np.zeros(len(query), np.int64)
        for s in range(self.bits):
            score += ((flat[s, query, place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(np.int64) << s
        return query, place, score


def _groups(pairs: DataFrame) -> int:
    """Into how many groups queries are dealt by the hash of their number, so that none has more than GROUP_TERMS terms, but single queries."""
    sizes = pairs.groupBy("query").agg(F.count(F.lit(1)).alias("terms"))
    total = sizes.agg(F.coalesce(F.sum("terms"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // GROUP_TERMS))
    while sizes.groupBy(_group_of(groups)).agg(F.sum("terms").alias("terms"), F.count(F.lit(1)).alias("n")).filter(f"terms > {GROUP_TERMS} AND n > 1").limit(1).count():
        groups *= 2
    return groups


def _group_of(groups: int):
    return F.pmod(F.xxhash64("query"), F.lit(groups)).alias("group")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each of ``queries`` (item_id, text): item_id, rank (from 1), doc_id, score.

    A score is the sum of weight times impact over the query's terms, repeats included, in exact 64-bit integers; equal scores are ranked by
    doc_id. Equal rows of ``queries`` are one query; rows of one item_id with different texts are ranked each for itself; null, empty and
    termless ones find nothing. Queries are answered in groups whose terms (at most GROUP_TERMS) go to all tasks; one group is one pass over
    the bitmaps of its terms, which meet by block. Any number of groups is answered, one after another."""
    spark = queries.sparkSession
    bounded_batches(spark)
    numbered = stored(queries.select("item_id", "text").filter("text is not null").distinct().withColumn("query", F.monotonically_increasing_id()))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != ""))
    times = numbered.select("query", term.alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    pairs = stored(times.join(index.weights, "term").filter("weight > 0").select("query", "term", "times", "weight"))
    groups = _groups(pairs)
    best: DataFrame | None = None
    for g in range(groups):
        mine = pairs.filter(_group_of(groups) == g)
        group = Group.of(mine.collect())  # bounded by GROUP_TERMS
        asked = F.broadcast(mine.select("term").distinct().unionByName(spark.range(1).select(F.lit("").alias("term"))))
        met = index.sliced.drop("df").join(asked, "term", "left_semi")
        found = map_groups(met, ["block"], lambda rows, group=group: group.best(rows, k), FOUND)
        best = found if best is None else best.unionByName(found)
        if g % 16 == 15:
            best = stored(best)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
