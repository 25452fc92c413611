"""Language identification: averaged embeddings of hashed subwords with a linear softmax, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, fresh

#: Subwords are runs of so many bytes of the text, ASCII letters lower-cased, white space as one kind of byte.
GRAMS = (1, 2, 3, 4)
BUCKETS, WIDTH = 1 << 15, 16
#: Letters and few others, such as fractions, which ``has_letter`` tells apart.
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Bytes of a text that are hashed at once, and of a training segment.
PORTION, SEGMENT = 1 << 16, 256
#: Bytes of the longest texts that have a cut of their own, and of the shortest pieces that the temperature is set by.
LONGEST, SHORTEST = 1024, 32
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def subwords(data: bytes) -> Iterator[np.ndarray]:
    """Bucket ids of all subwords of a text, in portions that overlap so that none is lost or met twice."""
    longest = GRAMS[-1]
    for at in range(0, max(1, len(data)), PORTION):
        part = _FOLD[np.frombuffer(data[at : at + PORTION + longest - 1], dtype=np.uint8)]
        own = min(PORTION, len(data) - at)
        h = np.zeros(len(part), dtype=np.uint32)
        ids = []
        for n in range(1, longest + 1):
            h = (h[: len(part) - n + 1] if n > 1 else h) * np.uint32(16777619)
            h = (h ^ part[n - 1 :]) * np.uint32(2654435761)
            if n in GRAMS:
                ids.append(h[:own] >> np.uint32(17))
        yield np.concatenate(ids)


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    #: Embedding and linear layer as one table: what a bucket adds to each label and, last, to noise.
    table: np.ndarray
    bias: np.ndarray
    #: Divides the logits so that scores are probabilities on pieces that training did not have.
    temperature: float
    #: At ``k``: texts of 2^k bytes or more whose margin is less are rejected; the last holds for all longer ones.
    cuts: tuple[float, ...]

    def logits(self, data: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.bias)), 0
        for ids in subwords(data):
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        return total / max(1, n) + self.bias

    def told(self, data: bytes) -> tuple[int, float, float]:
        """Label, its probability, and its margin: how far its logit lies above all others', noise's included. Probabilities of long
        texts are 1 to the last digit; margins still tell them apart."""
        z = self.logits(data)
        k = int(z[:-1].argmax())
        top = z.max()
        p = np.exp((z - top) / self.temperature)
        return k, float(p[k] / p.sum()), float(z[k] - np.delete(z, k).max())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, its score, and whether the margin reaches the cut of texts of this length."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, False
        data = text.encode("utf-8", "surrogatepass")
        k, score, margin = self.told(data)
        return self.labels[k], score, margin >= self.cut(len(data))

    def cut(self, n_bytes: int) -> float:
        return self.cuts[min(n_bytes.bit_length() - 1, len(self.cuts) - 1)] if self.cuts else -np.inf


def noise(text: str, rng: np.random.Generator) -> str:
    """The characters of a text in random order: letters of a language without its words."""
    letters = list(text)
    rng.shuffle(letters)
    return "".join(letters)


def _pieces(text: str, size: int) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[at : at + size] for at in range(0, len(data), size)]


def _features(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a segment and how often each is met, in two bytes each: the driver holds those of all segments."""
    ids, n = np.unique(np.concatenate(list(subwords(piece))), return_counts=True)
    return ids.astype(np.uint16), n.astype(np.uint16)


def train(texts: list[str], langs: list[str], rejected: float = 0.005, epochs: int = 4, rate: float = 2.0, seed: int = 8) -> LanguageModel:
    """Fit on texts, cut into segments of ``SEGMENT`` bytes, by stochastic gradient descent. Besides the languages one more class is
    learnt from segments whose characters are shuffled, as many as an average language has.

    A tenth of the texts is set aside, cut into pieces of every power of two of bytes up to ``LONGEST``, and sets the temperature
    (least loss) and the cuts: by split conformal prediction a piece that is told rightly, of any of these lengths, has a margin below
    its cut with a probability of at most ``rejected``. Where too few pieces are at hand to promise that, the cut of shorter ones
    holds, and where there are none nothing is rejected."""
    labels = tuple(sorted(set(langs)))
    if not labels:
        return LanguageModel((), np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(1), 1.0, ())
    rng = np.random.default_rng(seed)
    # every tenth text of each language, so that all are held out alike
    held, met = [], dict.fromkeys(labels, 0)
    for y in langs:
        met[y] += 1
        held.append(met[y] % 10 == 0)
    samples = [(*_features(piece), labels.index(y)) for t, y, out in zip(texts, langs, held, strict=True) if not out for piece in _pieces(t, SEGMENT)]
    odd = len(labels)
    learnt = [t for t, out in zip(texts, held, strict=True) if not out and t]
    for t in (learnt[k] for k in rng.integers(0, len(learnt), 1 + len(samples) // odd)) if learnt else ():
        at = int(rng.integers(0, max(1, len(t) - SEGMENT)))
        samples += [(*_features(piece), odd) for piece in _pieces(noise(t[at : at + SEGMENT], rng), SEGMENT)[:1]]
    counts = np.bincount([x[2] for x in samples], minlength=odd + 1)
    weigh = np.minimum(counts.sum() / (odd + 1) / np.maximum(counts, 1), 10.0)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, odd + 1), dtype=np.float32), np.zeros(odd + 1, dtype=np.float32)
    step, steps = 0, epochs * len(samples)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            ids, n, y = samples[k]
            share = (n / n.sum()).astype(np.float32)
            now = rate * (1 - step / steps)
            x = share @ embed[ids]
            z = x @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = (now * min(1.0, float(weigh[y])) * p).astype(np.float32)
            embed[ids] -= share[:, None] * (layer @ g)
            layer -= np.outer(x, g)
            bias -= 0.1 * g
            step += 1
    model = LanguageModel(labels, embed @ layer, bias, 1.0, ())
    return calibrated(model, [t for t, out in zip(texts, held, strict=True) if out], [y for y, out in zip(langs, held, strict=True) if out], rejected, rng)


def calibrated(model: LanguageModel, texts: list[str], langs: list[str], rejected: float, rng: np.random.Generator) -> LanguageModel:
    """The model with temperature and cuts from texts that it was not trained on."""
    z: list[np.ndarray] = []
    truth: list[int] = []
    cuts: list[float] = []
    for k in range(LONGEST.bit_length()):
        parts = [(x, model.labels.index(y)) for t, y in zip(texts, langs, strict=True) for x in _pieces(t, 1 << k)[:64] if len(x) == 1 << k and has_letter(x.decode("utf-8", "ignore"))]
        told = [model.told(x) for x, _ in parts]
        # those named wrongly are no measure of how surely the others are named
        margins = sorted(m for (label, _, m), (_, y) in zip(told, parts, strict=True) if label == y)
        nth = int(rejected * (len(margins) + 1))
        # where there are too few, that of shorter pieces, which are told less surely
        cuts.append(margins[nth - 1] if nth else (cuts[-1] if cuts else -np.inf))
        odd = [(x, len(model.labels)) for t in texts[:: len(model.labels)] for x in _pieces(noise(t[:LONGEST], rng), 1 << k)[:4] if len(x) == 1 << k]
        if 1 << k >= SHORTEST:
            z += [model.logits(x) for x, _ in parts + odd]
            truth += [y for _, y in parts + odd]
    if not z:
        return model
    logits, y = np.array(z), np.array(truth)

    def loss(t: float) -> float:
        s = logits / t
        top = s.max(axis=1)
        return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(y)), y]).mean())

    temperature = float(min(np.geomspace(0.05, 2000, 90), key=loss))
    return LanguageModel(model.labels, model.table, model.bias, temperature, tuple(float(x) for x in cuts))


def fit(docs: DataFrame, usable: Column, per_language: int = 400, per_text: int = 32, seed: int = 8, **how) -> LanguageModel:
    """Train on at most ``per_language`` different texts of each language among the ``usable`` rows of ``docs`` (text, lang), and at
    most ``per_text`` segments of each, which lie evenly over it. A null ``usable`` means no; null texts and languages are left out;
    copies of a text in one language count once. The texts are those that come first by a hash of text and seed, so the choice is the
    same wherever rows lie and however many there are; an empty table gives a model without labels.

    Only segments of rows whose hash is among about three times as many are shuffled or sent, so what is gathered grows
    with the number of languages and not with that or the length of rows."""
    size = 1 << 30
    rows = docs.filter(F.coalesce(usable, F.lit(False)) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("text", F.lit(seed)).alias("h")).withColumn("o", F.pmod("h", F.lit(size)))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return train([], [], seed=seed, **how)
    least = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(size, 3 * per_language * size // r["n"])))), F.col("lang"))
    n = F.length("text")
    at = F.sequence(F.lit(0), F.lit(per_text - 1))
    spread = F.transform(at, lambda i: F.substring(F.col("text"), (i * (n - SEGMENT) / F.lit(per_text)).cast("int") + 1, F.lit(SEGMENT)))
    parts = F.when(n <= per_text * SEGMENT, F.array("text")).otherwise(spread)
    some = rows.filter(F.col("o") < least).groupBy("lang", "o", "h").agg(F.min(parts).alias("parts"))
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "h"))).filter(F.col("n") <= per_language)
    sample = sorted((r["lang"], r["o"], r["h"], r["parts"]) for r in first.select("lang", "o", "h", "parts").collect())
    return train(["\n".join(x[3]) for x in sample], [x[0] for x in sample], seed=seed, **how)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred (a label of the model; ``und`` if the text is null or has no letter), score (0 to 1; 0
    for ``und``) and accepted (not ``und``, and the margin reaches the model's cut for texts of this length). Nothing but the text is
    read for it, so repeated rows are told alike. Whole texts are scored in portions, however long. Columns of these names are
    replaced, all others kept; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    ready = docs.drop("lang_pred", "score", "accepted")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    told = fresh(ready, "told")
    predict = F.pandas_udf(run, "lang_pred string, score double, accepted boolean")
    return ready.withColumn(told, predict(F.col("text"))).select(*(F.col(f"`{c}`") for c in ready.columns), f"{told}.lang_pred", f"{told}.score", f"{told}.accepted")
