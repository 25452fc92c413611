"""Near-duplicate vectors by binary codes of random rotations with correction factors."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, with_pair_blocks
from .components import connected_components
from .forest import joined, roots_of

#: Distinct vectors that meet in one group at most, twice, and pairs that are estimated at once.
BLOCK_ROWS, PAIRS = 1024, 1 << 18
#: Standard deviations of the estimate's error that its bound allows.
CONFIDENCE = 5.0
#: Vectors that a bucket should hold, and the greatest chance that a pair at the threshold shares no bucket.
BUCKET_ROWS, MISS = 16, 0.002
#: Bits of a bucket key beyond which a key would not fit a long.
KEY_BITS = 62
#: Bits that a rotated component is rounded to where a vector stands on the other side of a code: a sign and a magnitude.
QUERY_BITS = 5
KEY = ["dim", "band", "bucket", "lo_block", "hi_block"]


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket key and number of keys for ``n`` vectors: a pair at the threshold agrees in a bit with
    probability 1 - angle / pi. Without any ``miss`` there is one bucket, which holds all."""
    if miss <= 0:
        return 0, 1
    bits = min(KEY_BITS, max(6, round(math.log2(max(1, n) / BUCKET_ROWS))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


@functools.lru_cache(maxsize=8)
def rotations(dim: int, turns: int, seed: int) -> np.ndarray:
    """``turns`` random rotations below each other: (turns * dim, dim)."""
    rng = np.random.default_rng([seed, dim, turns])
    parts = []
    for _ in range(turns):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts)


def units(v: np.ndarray) -> np.ndarray:
    """The rows scaled to length 1, whatever their size."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def band_keys(unit: np.ndarray, width: int, bands: int, seed: int) -> np.ndarray:
    """(rows, bands): each key is ``width`` signs of components of the vector under random rotations."""
    if not width:
        return np.zeros((len(unit), bands), dtype=np.int64)
    turned = unit @ rotations(unit.shape[1], -(-width * bands // unit.shape[1]), seed)[: width * bands].T
    return (turned > 0).reshape(len(unit), bands, width) @ (1 << np.arange(width, dtype=np.int64))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    room = -bits.shape[-1] % 64
    return np.packbits(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, room)]), axis=-1).view(np.uint64)


@dataclass(frozen=True)
class Codes:
    """What is known of vectors without the vectors. ``sign``: (rows, words), the signs of the vector under one rotation, that is the
    corner of a cube next to it. ``factor``: the inner product of vector and corner (of length 1). ``planes``: (bits, rows, words), the
    rotated components rounded at random to numbers from 0 to 2^bits - 1, which stand for ``low + step * number``."""

    sign: np.ndarray
    factor: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    dim: int

    def estimate(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Unbiased estimates of the products of vectors ``i`` and ``j``: of corner ``i`` and rounded ``j``, by AND and counts of bits,
        over the factor of ``i``."""
        code, total = self.sign[i], np.zeros(len(i))
        for b in range(len(self.planes)):
            plane = self.planes[b][j]
            total += np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) * float(2 << b) - np.bitwise_count(plane).sum(axis=1, dtype=np.int64) * float(1 << b)
        count = 2.0 * np.bitwise_count(code).sum(axis=1, dtype=np.int64) - self.dim
        return (self.low[j] * count + self.step[j] * total) / math.sqrt(self.dim) / self.factor[i]

    def room(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """How far the estimate of a pair at the threshold or above it may fall short: the part of one vector across the other, which the
        corner sees by chance, and the rounding, each by ``CONFIDENCE`` deviations."""
        f = self.factor[i]
        across = math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0.0, 1 - f**2)) / f / math.sqrt(max(1, self.dim - 1))
        rounding = self.step[j] / 2 / f
        return CONFIDENCE * np.sqrt(across**2 + rounding**2) + 1e-9

    def packed(self) -> list[bytes]:
        head = np.stack([self.factor, self.low, self.step], axis=1).astype("<f8")
        body = np.concatenate([self.sign[None], self.planes]).transpose(1, 0, 2).reshape(len(self.sign), -1)
        return [a.tobytes() + b.tobytes() for a, b in zip(head, body, strict=True)]

    @staticmethod
    def unpacked(rows: list[bytes], dim: int) -> Codes:
        raw = np.frombuffer(b"".join(rows), dtype=np.uint64).reshape(len(rows), -1)
        head = np.ascontiguousarray(raw[:, :3]).view("<f8")
        body = np.ascontiguousarray(raw[:, 3:].reshape(len(rows), 1 + QUERY_BITS, -1).transpose(1, 0, 2))
        return Codes(body[0], head[:, 0], body[1:], head[:, 1], head[:, 2], dim)


def encode(unit: np.ndarray, seed: int) -> Codes:
    """Codes of unit vectors by one random rotation, which is not among those of the band keys: that two vectors share a bucket so
    says nothing about their codes."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, 1, seed + 1).T
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum((high - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    shift = np.random.default_rng([seed, dim]).random(dim)  # rounding up or down by chance leaves sums unbiased
    number = np.clip(np.floor((turned - low[:, None]) / step[:, None] + shift), 0, (1 << QUERY_BITS) - 1).astype(np.int64)
    planes = np.stack([_words((number >> b) & 1 == 1) for b in range(QUERY_BITS)])
    return Codes(_words(turned > 0), np.maximum(np.abs(turned).sum(axis=1) / math.sqrt(dim), 1e-9), planes, low, step, dim)


def _raw(column: pd.Series, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).astype(np.float64).reshape(-1, dim)


def _banded(width: int, bands: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["embedding"].map(len)):
                unit = units(np.stack(part["embedding"].to_numpy()).astype(np.float64))
                keys, codes = band_keys(unit, width, bands, seed), encode(unit, seed).packed()
                for band in range(bands):
                    yield pd.DataFrame({"dim": dim, "band": band, "bucket": keys[:, band], "key": part["key"].to_numpy(), "code": codes})

    return run


def _bytes(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "copies": b["copies"], "vector": [np.asarray(x, dtype=kind).tobytes() for x in b["embedding"]]})

    return run


def group_pairs(starts: np.ndarray, stop: int, crossed: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, about ``PAIRS`` at once; groups begin at ``starts``. In a crossed group only pairs of rows of
    different blocks: the others meet elsewhere."""
    end = np.repeat(np.append(starts[1:], stop), np.diff(np.append(starts, stop)))
    row = np.arange(stop)
    upto = np.cumsum(end - row - 1)
    lo = 0
    while lo < stop:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = end[lo:hi] - row[lo:hi] - 1
        i = np.repeat(row[lo:hi], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        take = ~crossed[i] | (block[i] != block[j])
        yield i[take], j[take]
        lo = hi


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches sorted by ``KEY`` as portions of whole groups, with the rows that groups begin at."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if len(b):
            starts = _starts(b)
            yield from _by_dim(b.iloc[: starts[-1]], starts[:-1])
            rest = b.iloc[starts[-1] :]
    if rest is not None:
        b = rest.reset_index(drop=True)
        yield from _by_dim(b, _starts(b))


def _starts(b: pd.DataFrame) -> np.ndarray:
    new = np.zeros(len(b), dtype=bool)
    new[0] = True
    for k in KEY:
        v = b[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _by_dim(b: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    if not len(b):
        return
    dim = b["dim"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(dim)) + 1).tolist(), len(b)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield b.iloc[lo:hi].reset_index(drop=True), starts[(starts >= lo) & (starts < hi)] - lo


def _candidates(threshold: float):
    """Of each group the rows that have a pair whose estimate does not rule a link out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, starts in whole_groups(batches):
            codes = Codes.unpacked(g["code"].tolist(), int(g["dim"].iat[0]))
            found = np.zeros(len(g), dtype=bool)
            for i, j in group_pairs(starts, len(g), (g["lo_block"] != g["hi_block"]).to_numpy(), g["block"].to_numpy()):
                near = codes.estimate(i, j) >= threshold - codes.room(i, j, threshold)
                found[i[near]] = True
                found[j[near]] = True
            if found.any():
                yield g.loc[found, [*KEY, "block", "key"]]

    return run


def _linked(threshold: float, width: int, bands: int, seed: int, kind: str):
    """Links of each row of a group, and its least row within the group along links, exactly. A pair counts in the first band that it
    shares."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, starts in whole_groups(batches):
            unit = units(_raw(g["vector"], kind, int(g["dim"].iat[0])))
            keys = band_keys(unit, width, bands, seed)
            ids, copies, band = g["key"].to_numpy(), g["copies"].to_numpy(), g["band"].to_numpy()
            links, least = np.zeros(len(g), dtype=np.int64), np.arange(len(g))
            for i, j in group_pairs(starts, len(g), (g["lo_block"] != g["hi_block"]).to_numpy(), g["block"].to_numpy()):
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[near], j[near]
                first = (keys[i] == keys[j]).argmax(axis=1) == band[i]
                i, j = i[first], j[first]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                joined(least, i, j)
            some = np.flatnonzero((links > 0) | (least != np.arange(len(g))))
            if len(some):
                yield pd.DataFrame({"key": ids[some], "links": links[some], "peer": ids[roots_of(least)[some]]})

    return run


def similar_vectors(vectors: DataFrame, threshold: float = 0.95, miss: float = MISS, seed: int = 9) -> DataFrame:
    """Links of every row of ``vectors`` (vec_id, embedding) by cosine, in double precision, of at least ``threshold``.

    Returns vec_id, n_links (other rows linked directly), component_id (least vec_id reachable) and kept (it is its
    own). Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do
    vectors of different lengths. Repeated vectors link with each other; they are compared once, with their number.
    A repeated vec_id is a row like others; a null one links with nothing. An empty table gives no rows; other columns are left out.
    ``vec_id`` may be of any whole-number type.

    Vectors that share one of the band keys (signs under random rotations) meet in a bucket, large buckets in blocks (see
    ``with_pair_blocks``). What meets there is a code: the signs of a rotation of its own, the correction factor and the
    rounded components, so no vector is shuffled by band. A pair's product is estimated from code and factor, and only
    rows with a pair that the estimate's confidence bound leaves open go on: their vectors are fetched by id and these pairs
    computed exactly. A pair at the threshold shares no bucket with probability ``miss``, a closer one less; ``miss=0`` is
    the exact way: one bucket, all of whose blocks meet.
    """
    bounded_batches(vectors.sparkSession)
    if not 0 < threshold < 1:
        raise ValueError("threshold: between 0 and 1")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").withColumn("_ok", F.coalesce(finite, F.lit(False)))
    good = rows.filter("_ok and vec_id is not null")
    alike = good.groupBy("embedding").agg(F.min(F.col("vec_id").cast("long")).alias("id"), F.count(F.lit(1)).alias("copies"))
    distinct = stored(alike.withColumn("key", F.monotonically_increasing_id()))  # rows that share an id stay apart
    width, bands = plan(distinct.count(), threshold, miss)
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    banded = distinct.select("key", "embedding").mapInPandas(_banded(width, bands, seed), "dim int, band int, bucket long, key long, code binary")
    dealt = with_pair_blocks(banded, ["dim", "band", "bucket"], "key", BLOCK_ROWS)
    asked = stored(dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInPandas(_candidates(threshold), "dim int, band int, bucket long, lo_block int, hi_block int, block int, key long"))
    raw = distinct.join(asked.select("key").distinct(), "key", "left_semi").select("key", "copies", "embedding").mapInPandas(_bytes(kind), "key long, copies long, vector binary")
    met = asked.join(raw, "key").repartition(*KEY).sortWithinPartitions(*KEY)
    found = stored(met.mapInPandas(_linked(threshold, width, bands, seed, kind), "key long, links long, peer long"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("key <> peer").select(F.col("key").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "key")
    # few vectors have links; the others' classes are their own
    classes = links.join(roots, "key").join(distinct.select("key", "id"), "key")
    least = classes.groupBy("component").agg(F.min("id").alias("least"))
    classes = classes.join(least, "component").select("key", "links", "least")
    classes = distinct.join(classes, "key", "left").select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    linked = good.select("vec_id", "embedding").join(classes, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not _ok or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
