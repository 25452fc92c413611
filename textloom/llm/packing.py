"""Best-two-fit packing of token sequences."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, kept

#: Ranges that pieces of one length are numbered in, at least, and rows of a range.
MIN_RANGES, RANGE_ROWS = 64, 1 << 16


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """The byte-level BPE of ``vocabulary`` (ranks, one a line). The two forms of the vocabulary give the same ids,
    which a test holds against the other library; this one is the faster."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit numbers; the end mark's own string is that mark, as the other library has it."""
    enc = _encoder(vocabulary)
    if hasattr(enc, "encode_to_numpy"):
        return enc.encode_to_numpy(text, allowed_special="all")
    return np.array(enc.encode(text, allowed_special="all"), dtype="<u4")


def pieces(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32. A document is its ids and then
    ``end``; a longer one than ``capacity`` is cut into whole pieces after a first one that takes the remainder."""
    bounded_batches(docs.sparkSession)
    from_path = vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = from_path or public_vocabulary()
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b["text"]):
                ids = np.append(token_ids(text or "", path), end).astype("<u4")
                cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                at += [k] * (len(cut) - 1)
                rows += [(p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for p, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy()[at])
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``counts[length]`` pieces of each length; returns (length, first, last, sequence, offset, run): the
    pieces of a length that are numbered ``first`` to ``last - 1`` go, ``run`` in a row, to ``sequence`` and those
    after it, from ``offset`` on.

    Sequences are filled one by one: the longest piece left, then the longest that fits, until none does. Then the
    last and smallest piece gives way to the two left that together fill the widened gap best, if they fill it
    better. What a sequence gets depends on which lengths are left, not on how many of each, so the same filling is
    used as often as the pieces last: the work grows with the number of lengths and not with that of documents.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError("lengths: from 1 to the capacity")
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    out, sequence = [], 0
    lengths = np.arange(capacity + 1)

    def longest(have: np.ndarray) -> np.ndarray:
        """At ``x``: the longest length of at most ``x`` that is left, or 0."""
        return np.maximum.accumulate(np.where(have > 0, lengths, 0))

    upto = longest(left)
    while upto[capacity]:
        have, fits = left.copy(), upto
        filling: list[list[int]] = []
        gap = capacity
        while gap and (size := int(fits[gap])):
            n = min(int(have[size]), gap // size)
            filling.append([size, n])
            have[size] -= n
            gap -= n * size
            if not have[size]:
                fits = longest(have)
        if gap:
            small = filling[-1][0]
            room = gap + small
            have[small] += 1
            fits = longest(have)
            a = np.flatnonzero(have[: room + 1] > 0)
            # the longer one of the pair is at least half of the room, or else both are less: then the longest such is best
            below = a[2 * a < room]
            a = np.concatenate([below[-1:], a[2 * a >= room]])
            # the partner of each, the longest that fits beside it; of its own length only if there are two
            b = fits[room - a]
            same = (b == a) & (have[a] < 2)
            if same.any():
                fewer = np.where(a[same] > 0, fits[np.maximum(np.minimum(room - a[same], a[same] - 1), 0)], 0)
                b = b.copy()
                b[same] = fewer
            total = np.where(b > 0, a + b, 0)
            if len(total) and total.max() > small:
                k = int(total.argmax())
                filling[-1][1] -= 1
                filling = [x for x in filling if x[1]] + [[int(a[k]), 1], [int(b[k]), 1]]
        need: dict[int, int] = {}
        for size, n in filling:
            need[size] = need.get(size, 0) + n
        times = min(int(left[size]) // n for size, n in need.items())
        offset = 0
        for size, n in filling:
            out.append((size, int(used[size]), int(used[size]) + times * n, sequence, offset, n))
            used[size] += times * n
            left[size] -= times * n
            offset += size * n
        sequence += times
        if any(not left[size] for size in need):
            upto = longest(left)
    return out


def pack(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns the columns of ``pieces`` with sequence_id and offset (gapless from 0). Null and empty texts are the end
    mark alone; repeated rows are packed each; an empty table gives no rows; other columns are left out.

    Only the number of pieces of each length, ``capacity`` numbers, comes to the driver, which plans fillings from it. A piece
    finds its place by its number among those of its length; numbers come from ranges that are counted on
    their own, so a length that very many pieces have is in no one task.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # pieces that agree in all columns are one record until they get their numbers
    cut = kept(pieces(docs, capacity, end, vocabulary).groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows")))
    counts = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").agg(F.sum("_rows").alias("count")).collect()}
    plan = np.array(sorted(best_two_fit(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    ranges = max(MIN_RANGES, -(-max(counts.values(), default=0) // RANGE_ROWS))
    numbered = cut.withColumn("_range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)).cast("int"))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = numbered.groupBy("length", "_range").agg(F.sum("_rows").alias("count")).select("length", "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.sum("_rows").over(Window.partitionBy("length", "_range").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("_start") + F.coalesce("_within", F.lit(0))
    numbered = numbered.withColumn("_within", within).join(starts, ["length", "_range"])
    numbered = numbered.select(*columns, F.explode(F.sequence(first, first + F.col("_rows") - 1)).alias("_number"))
    #: A length and a number within it as one key; numbers stay below 2^50.
    firsts = plan[:, 0] * (1 << 50) + plan[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, number = b["length"].to_numpy(), b.pop("_number").to_numpy()
            row = plan[np.searchsorted(firsts, length * (1 << 50) + number, side="right") - 1]
            turn = number - row[:, 1]
            yield b.assign(sequence_id=row[:, 3] + turn // row[:, 5], offset=row[:, 4] + turn % row[:, 5] * length)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
