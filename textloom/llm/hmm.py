"""A hidden Markov language model: Baum-Welch over partitions, exact scores by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Words of their own in the emissions, classes of all others (by their last bytes), words whose counts workers hold.
TOP, CLASSES, KNOWN = 1 << 15, 1 << 10, 1 << 18
SUFFIX = 2
#: The end of a text, counted as a token; no word is empty.
END = b""
#: Tokens of a training segment, and of its text on either side of it that are read with it but not counted.
SEGMENT, CONTEXT = 512, 32
#: Tokens that are taken together, distinct words that a task counts before it hands them on.
TOGETHER, COUNTED = 1 << 20, 1 << 19
#: Weight of the words' overall shares in a state's emissions, in counts, and of equal shares in its transitions.
EMISSION_PRIOR, MOVE_PRIOR = 50.0, 1.0


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; empty: the end) and c over all rows of ``docs`` (text). Tasks count before they shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def out() -> pd.DataFrame:
            got = pd.DataFrame({"word": list(found), "c": list(found.values())}, columns=["word", "c"])
            found.clear()
            return got

        for b in batches:
            for text in b["text"]:
                found.update(tokens(text))
                if len(found) > COUNTED:
                    yield out()
        if found:
            yield out()

    return docs.select("text").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """Words that workers know: their counts, and the ids of those with emissions of their own."""

    counts: dict[bytes, int]
    ids: dict[bytes, int]
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.ids) + CLASSES


def _cut(steps: dict[int, tuple[int, int]], most: int) -> int:
    """The least count such that at most ``most`` words have it or more; ``steps``: words and least count by step."""
    words, least = 0, 1 << 62
    for k in sorted(steps, reverse=True):
        words += steps[k][0]
        if words > most:
            break
        least = steps[k][1]
    return least


def vocabulary(counts: DataFrame, own: int, held: int) -> tuple[Vocabulary, int, int]:
    """The most frequent words of ``counts`` (word, c): at most ``held``, of them at most ``own`` with ids besides the end. Words
    as frequent, to an eighth of a doubling, are taken or left together. Also the least counts of both."""
    whole = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    step = F.floor(8 * F.log2("c")).cast("int")
    steps = {r["step"]: (r["words"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).collect()}
    top, known = _cut(steps, own), _cut(steps, max(own, held))
    rows = counts.filter((F.col("c") >= known) | (F.col("word") == F.lit(END))).toPandas()
    have = dict(sorted((bytes(w), int(c)) for w, c in zip(rows["word"], rows["c"], strict=True)))
    ids: dict[bytes, int] = {END: 0}
    for w, c in have.items():
        if w != END and c >= top:
            ids[w] = len(ids)
    return Vocabulary(have, ids, int(whole[0] or 0), int(whole[1])), top, known


def encoded(docs: DataFrame, vocab: Vocabulary, classes: pd.DataFrame, discount: float, train: Column) -> DataFrame:
    """Every row of ``docs`` as key (a number of the row's own), doc_id, train, n_tokens, ids (16-bit emission
    ids) and, over the tokens that workers know, n_known, base (sum of log10(c + 0.1)) and within (sum of log10 of
    the word's share of its class); the other words, with their number, are in ``rest``."""
    n_of = classes["n"].to_numpy()
    first = len(vocab.ids)
    place = {w: k for k, w in enumerate(vocab.counts)}
    if END not in place:  # no training text; the end has its id all the same
        place[END] = len(place)
    group = np.array([word_class(w) for w in place])
    own = np.array([vocab.ids.get(w, -1) for w in place])
    c = np.array([vocab.counts.get(w, 0) for w in place])
    ids = np.where(own >= 0, own, first + group).astype("<u2")
    base = np.log10(c + 0.1)
    within = np.where(own >= 0, 0.0, np.log10(np.maximum(c - discount, 1e-9) / np.maximum(n_of[group], 1)))
    known = c > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = place.get
        for b in batches:
            rows = []
            for doc_id, mine, text in zip(b["doc_id"], b["train"], b["text"], strict=True):
                words = tokens(text)
                at = np.fromiter(map(find, words, repeat(-1)), dtype=np.int64, count=len(words))
                lacking = np.flatnonzero(at < 0).tolist()
                number = ids[at]
                if lacking:
                    number[lacking] = [first + word_class(words[k]) for k in lacking]
                    at = at[at >= 0]
                rest = [{"word": w, "n": n} for w, n in Counter(words[k] for k in lacking).items()]
                rows.append((doc_id, bool(mine), len(words), int(known[at].sum()), float(base[at].sum()), float(within[at].sum()), number.tobytes(), rest))
            yield pd.DataFrame(rows, columns=["doc_id", "train", "n_tokens", "n_known", "base", "within", "ids", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", train.alias("train"), "text").mapInPandas(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base double, within double, ids binary, rest array<struct<word:binary,n:long>>")


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (ids, states)


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The natural log of each sequence's probability, by the recursion scaled at every token. Sequences go on side by side, the
    longest first, so that those still running are a prefix."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order])
    flat = np.concatenate([texts[k] for k in order]) if order else np.zeros(0, dtype=np.uint16)
    at = np.cumsum(lengths) - lengths
    out = np.zeros(len(texts))
    alpha = np.zeros((0, len(model.start)))
    for t in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        here = model.emit[flat[at[:n] + t]]
        alpha = here * (alpha[:n] @ model.move if t else model.start)
        scale = alpha.sum(axis=1)
        out[:n] += np.log(scale)
        alpha /= scale[:, None]
    back = np.empty(len(texts))
    back[order] = out
    return back


@dataclass(frozen=True)
class Segments:
    """Parts of texts side by side. A row's first ``lengths`` tokens are its text's; of these the first ``lead`` and those from
    ``counted`` on are context, which belongs to the segments before and after. Without a lead rows begin texts."""

    table: np.ndarray
    lengths: np.ndarray
    counted: np.ndarray
    lead: int


def expected_counts(model: Model, s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts of texts, moves and emissions (states, ids) of the segments: of every token, and of the move to it, once over
    all segments of a text. A segment within a text begins anywhere in its context, by the chain's long-run shares; what that lets
    out fades with each token of the context, so that counts are those of the whole text."""
    rows, width = s.table.shape
    k = len(model.start)
    first = long_run(model.move) if s.lead else model.start
    inside = lambda ends, t: None if ends.min() > t else (t < ends)[:, None]  # noqa: E731  None: all rows
    masked = lambda x, m, other: x if m is None else np.where(m, x, other)
    alphas = np.empty((width, rows, k))
    for t in range(width):
        a = model.emit[s.table[:, t]] * (alphas[t - 1] @ model.move if t else first)
        a /= a.sum(axis=1, keepdims=True)
        alphas[t] = a if t == 0 else masked(a, inside(s.lengths, t), alphas[t - 1])
    beta = np.ones((rows, k))
    moves = np.zeros((k, k))
    most = int(s.counted.max())
    posterior = np.empty((most - s.lead, rows, k))
    for t in range(width - 1, s.lead - 1, -1):
        if t < most:
            g = alphas[t] * beta
            g /= g.sum(axis=1, keepdims=True)
            posterior[t - s.lead] = masked(g, inside(s.counted, t), 0.0)
        if t:
            live = inside(s.lengths, t)
            ahead = model.emit[s.table[:, t]] * beta
            back = ahead @ model.move.T
            total = (alphas[t - 1] * back).sum(axis=1, keepdims=True)
            if t < most:
                moves += alphas[t - 1].T @ masked(ahead / total, inside(s.counted, t), 0.0)
            beta = masked(back / total, live, 1.0)
    flat = s.table[:, s.lead : most].T.ravel()
    emitted = np.stack([np.bincount(flat, weights=posterior[:, :, x].ravel(), minlength=len(model.emit)) for x in range(k)])
    return np.zeros(k) if s.lead else posterior[0].sum(axis=0), moves * model.move, emitted


def long_run(move: np.ndarray) -> np.ndarray:
    """Shares of the states after very many moves."""
    return np.linalg.matrix_power(move, 1 << 12).mean(axis=0)


def updated(start: np.ndarray, moves: np.ndarray, emitted: np.ndarray, shares: np.ndarray) -> Model:
    start = start + MOVE_PRIOR
    moves = moves + MOVE_PRIOR
    emitted = emitted + EMISSION_PRIOR * shares
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), np.ascontiguousarray((emitted / emitted.sum(axis=1, keepdims=True)).T))


def in_segments(texts: list[np.ndarray]) -> Iterator[Segments]:
    """The texts cut into segments, in groups of about a quarter of ``TOGETHER`` tokens of equal lead."""
    group = max(1, TOGETHER // SEGMENT // 4)
    for lead in (0, CONTEXT):
        starts = [(t, i) for t in texts for i in ((0,) if not lead else range(SEGMENT, len(t), SEGMENT))]
        parts = sorted(((t[i - lead : i + SEGMENT + CONTEXT], lead + min(SEGMENT, len(t) - i)) for t, i in starts if len(t)), key=lambda x: (len(x[0]), x[1]))
        for i in range(0, len(parts), group):
            some = parts[i : i + group]
            lengths = np.array([len(p) for p, _ in some])
            table = np.zeros((len(some), int(lengths.max())), dtype=np.int64)
            for r, (p, _) in enumerate(some):
                table[r, : len(p)] = p
            yield Segments(table, lengths, np.array([n for _, n in some]), lead)


def gathered(batches: Iterator[pd.DataFrame], together: int = TOGETHER) -> Iterator[pd.DataFrame]:
    """Batches of ``together`` tokens or more, so that many sequences go side by side."""
    held, n = [], 0
    for b in batches:
        for i in range(0, len(b), 512):
            part = b.iloc[i : i + 512]
            held.append(part)
            n += int(part["ids"].map(len).sum()) // 2
            if n >= together:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _texts(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2") for x in column]


def first_model(sample: list[np.ndarray], size: int, shares: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    """Baum-Welch on a bounded sample, from random emissions and states that tend to stay."""
    rng = np.random.default_rng(seed)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    emit = shares * rng.gamma(1.0, size=(states, size)) + 0.1 * shares
    model = Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T))
    for _ in range(rounds):
        sums = [expected_counts(model, g) for g in in_segments(sample)]
        if not sums:
            break
        model = updated(*(sum(x) for x in zip(*sums, strict=True)), shares)
    return model


def train(rows: DataFrame, size: int, shares: np.ndarray, states: int, rounds: int, sample_rows: int, seed: int) -> Model:
    """Baum-Welch over all rows (ids): ``rounds`` passes, started from ``first_model`` on the ``sample_rows`` rows that
    come first by a hash. A pass sums the expected counts of every token of every row: tasks hand on a row
    for each id that they met, which are summed by id; ``size`` rows come to the driver."""
    # only rows whose hash is among about three times as many are sorted, so what tasks hand on does not grow with the input
    share = min(1.0, 3 * sample_rows / max(1, rows.count()))
    place = F.pmod(F.xxhash64("ids", F.lit(seed)), F.lit(1 << 30))
    sample = rows.select("ids", place.alias("place")).filter(F.col("place") < int(share * (1 << 30))).orderBy("place", "ids").limit(sample_rows).toPandas()
    model = first_model(_texts(sample["ids"]), size, shares, states, 12, seed)
    columns = [f"s{k}" for k in range(states)]

    for _ in range(rounds):
        current = model

        def run(batches: Iterator[pd.DataFrame], current: Model = current) -> Iterator[pd.DataFrame]:
            start, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, size))
            for b in gathered(batches):
                for g in in_segments(_texts(b["ids"])):
                    x, y, z = expected_counts(current, g)
                    start, moves, emitted = start + x, moves + y, emitted + z
            met = np.flatnonzero(emitted.sum(axis=0))
            ids = np.concatenate([[-1], np.arange(-1 - states, -1), met])
            yield pd.DataFrame(np.concatenate([start[None], moves, emitted[:, met].T]), columns=columns).assign(id=ids)[["id", *columns]]

        sums = rows.select("ids").mapInPandas(run, "id int, " + ", ".join(f"{c} double" for c in columns)).groupBy("id").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        if sums.empty:
            break
        sums = sums.set_index("id")
        emitted = np.zeros((states, size))
        met = sums.index[sums.index >= 0]
        emitted[:, met] = sums.loc[met].to_numpy().T
        model = updated(sums.loc[-1].to_numpy(), sums.loc[list(range(-1 - states, -1))].to_numpy(), emitted, shares)
    return model


def score_documents(docs: DataFrame, held_out: Column, states: int = 8, rounds: int = 3, sample_rows: int = 400, top_words: int | None = None, held_words: int | None = None, seed: int = 1) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, text) that are not ``held_out`` and score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with 0.1 added) and score, the log10
    probability of the text's tokens, end included, under the model. A state emits one of the ``top_words`` (``TOP``) most frequent words, the
    end, or one of ``CLASSES`` classes of other words; a word's share of its class is its count less a discount, and what the
    discounts leave is the share of any word that training did not have. Null texts are empty, which is the end
    alone; repeated rows are scored, and learnt from, each; an empty table gives no rows; with no training rows all
    words are unknown. Other columns are left out.

    Counts of all words and expected counts of all texts are summed over the whole training rows; training reads texts in segments
    with context (see ``expected_counts``), scoring goes through whole texts, whatever their length, and holds one row of states
    a text. Only the ``held_words`` (``KNOWN``) most frequent words go to the workers, which changes no result; the counts of all others are joined to the texts that hold
    them. Over all known words and one unknown word a class, a state's emissions sum to 1.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    counts = stored(word_counts(rows.filter("not held_out")))
    own = TOP if top_words is None else top_words
    if not 0 <= own <= (1 << 16) - CLASSES - 1:
        raise ValueError("top_words: emission ids have 16 bits")
    vocab, top, known = vocabulary(counts, own, KNOWN if held_words is None else held_words)
    other = (F.col("word") != F.lit(END)) & (F.col("c") < top)
    group = F.pmod(F.crc32(F.when(F.octet_length("word") > SUFFIX, F.substring("word", -SUFFIX, SUFFIX)).otherwise(F.col("word"))), F.lit(CLASSES)).cast("int")
    others = counts.filter(other)
    sums = others.groupBy(group.alias("g")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).toPandas().set_index("g")
    once, twice = int(sums["once"].sum()), int(sums["twice"].sum())
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    classes = sums[["n", "v"]].reindex(range(CLASSES), fill_value=0)
    # log10 of the share of an unknown word in its class; all of it in a class without words
    unknown = np.log10(np.where(classes["n"] > 0, discount * classes["v"] / np.maximum(classes["n"], 1), 1.0))

    table = stored(encoded(rows, vocab, classes, discount, ~F.col("held_out")).withColumn("key", F.monotonically_increasing_id()))
    first = len(vocab.ids)
    shares = np.full(first + CLASSES, 0.1)
    for w, k in vocab.ids.items():
        shares[k] += vocab.counts.get(w, 0)
    shares[first:] += classes["n"].to_numpy()
    shares /= shares.sum()
    model = train(table.filter("train"), vocab.size, shares, states, rounds, sample_rows, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in gathered(batches, 4 * TOGETHER):
            yield b.drop(columns="ids").assign(hidden=forward(model, _texts(b["ids"])) / np.log(10))

    kind = docs.schema["doc_id"].dataType.simpleString()
    hidden = table.drop("rest").mapInPandas(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base double, within double, key long, hidden double")
    # words beyond those that workers know, with their counts in training
    rest = table.select("key", F.explode("rest").alias("w")).select("key", "w.word", "w.n")
    bits = F.element_at(F.array(*(F.lit(float(x)) for x in unknown)), group + 1)
    n_of = F.element_at(F.array(*(F.lit(float(x)) for x in classes["n"])), group + 1)
    rest = rest.join(counts.filter(F.col("c") < known), "word", "left")
    share = F.when(F.col("c").isNull(), bits).otherwise(F.log10((F.col("c") - F.lit(discount)) / n_of))
    rest = rest.groupBy("key").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("rest_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rest_base"), F.sum(F.col("n") * share).alias("rest_within"))
    out = hidden.join(rest, "key", "left").fillna(0, ["rest_known", "rest_base", "rest_within"])
    floor = float(np.log10(vocab.total + 0.1 * (vocab.distinct + 1)))
    base = F.col("base") + F.col("rest_base") - F.col("n_tokens") * F.lit(floor)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("rest_known")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hidden") + F.col("within") + F.col("rest_within")).alias("score"))
