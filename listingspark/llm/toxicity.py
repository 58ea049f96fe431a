"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased and read as words; a word, with a space on either side, gives its character n-grams of 3 to 6
code points, hashed into ``BUCKETS`` rows of an embedding table. The vectors of a window of ``WINDOW`` words are
averaged and go through a linear softmax with two classes; table and softmax are trained together. A misspelling or
an inflection nobody has seen shares most n-grams with its stem, so it lands near it.

Labels hold for documents, a few words decide: training picks, in each toxic document of the sample, the window that
looks worst (first by document frequencies of n-grams, then by the model itself), and in clean documents the one that
looks worst and some at random. A document's score is that of its worst window.

Averaging is linear, so for scoring the table collapses into one number per bucket (the difference of the two
logits): tasks get ``BUCKETS`` floats and score whole texts in one pass over Arrow batches, whatever their length.

Training takes at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled texts of at most ``SAMPLE_CHARS`` code points,
those with the smallest hash of their id, so it is the same at every size of the corpus.

Defined cases: null and blank texts score as the softmax's bias does; rows of equal text get equal scores; a repeated
label counts once per row; with no labels, or labels of one class, every text gets a score near that class's share;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .grams import code_points, gram_hashes, room, text_groups
from .texts import own_columns

BITS = 18
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5, 6)
WINDOW = 2
#: Bounds of the labelled sample: documents of either class, and code points that a sampled text may have.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 3_000, 3_000, 8_000
THRESHOLD = 0.7
#: Gradient steps of a training round at least.
STEPS = 300


def _buckets(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for n, hashes in gram_hashes(points, GRAMS):
        yield n, hashes >> np.uint32(32 - BITS)


def _words(points: np.ndarray) -> np.ndarray:
    """Positions of the space before each word."""
    space = points == 32
    return np.flatnonzero(space[:-1] & ~space[1:])


@dataclass(frozen=True)
class Bags:
    """The n-grams of some texts, grouped by word, and the words of each text."""

    buckets: np.ndarray
    firsts: np.ndarray  # of the words, in `buckets`, and behind the last
    texts: np.ndarray  # first word of each text, and behind the last

    @classmethod
    def of(cls, texts: list[str]) -> Bags:
        points, begins = code_points(texts)
        starts, space = _words(points), room(points)
        owner = np.zeros(len(points), dtype=np.int32)
        owner[starts] = 1
        owner = np.cumsum(owner, dtype=np.int32) - 1
        found, owners = [], []
        for n, bucket in _buckets(points):
            at = np.flatnonzero((space[: len(bucket)] >= n) & (owner[: len(bucket)] >= 0))
            found.append(bucket[at])
            owners.append(owner[at])
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        order = np.argsort(owners, kind="stable")
        buckets = (np.concatenate(found) if found else np.zeros(0, np.uint32))[order]
        return cls(buckets, np.searchsorted(owners[order], np.arange(len(starts) + 1)), np.searchsorted(starts, begins))


@dataclass(frozen=True)
class ToxicityModel:
    """``weights`` has a logit difference per bucket, ``bias`` that of the softmax."""

    weights: np.ndarray
    bias: float

    def _windows(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Logit difference of the window that begins at each word, as far as there are words."""
        s, c = (np.concatenate(([0.0], np.cumsum(x, dtype=np.float64))) for x in (sums, counts))
        ends = np.minimum(np.arange(len(sums)) + WINDOW, len(sums))
        return (s[ends] - s[:-1]) / np.maximum(c[ends] - c[:-1], 1) + self.bias

    def windows(self, bags: Bags) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[bags.buckets], dtype=np.float64)))
        return self._windows(np.diff(sums[bags.firsts]), np.diff(bags.firsts))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Logit difference of each text's worst window; the bias for texts without words."""
        worst = np.full(len(texts), -np.inf)
        for parts, owners in text_groups(texts):
            points, begins = code_points(parts)
            starts = _words(points)
            if not len(starts):
                continue
            space = room(points)
            total = np.zeros(len(points), dtype=np.float32)
            for n, bucket in _buckets(points):
                total[: len(bucket)] += self.weights[bucket] * (space[: len(bucket)] >= n)
            length = room(points)[starts].astype(np.int64)  # of the padded word
            counts = sum(np.maximum(length - n + 1, 0) for n in GRAMS)
            found = self._windows(np.add.reduceat(total, starts, dtype=np.float64), counts)
            firsts = np.searchsorted(starts, begins)
            for i, a, b in zip(owners, firsts[:-1], firsts[1:], strict=True):
                if b > a:
                    whole = max(1, b - a - WINDOW + 1)  # windows that lie within the text
                    if b - a < WINDOW:
                        own = np.add.reduceat(total, starts[a:b])[: b - a].sum() if b == len(starts) else total[starts[a] : starts[b]].sum()
                        best = float(own) / max(int(counts[a:b].sum()), 1) + self.bias
                    else:
                        best = float(found[a : a + whole].max())
                    worst[i] = max(worst[i], best)
        return np.where(np.isfinite(worst), worst, self.bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -60, 60)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7, dim: int = 8, rounds: int = 5, epochs: int = 5, rate: float = 0.5) -> ToxicityModel:
    """Train on texts with labels 0 and 1."""
    labels = np.asarray(labels, dtype=np.int64)
    if len(np.unique(labels)) < 2:
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.01
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    bags = [Bags.of([t]) for t in texts]
    seen = np.zeros((2, BUCKETS))
    for bag, y in zip(bags, labels, strict=True):
        seen[y, np.unique(bag.buckets)] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    model = ToxicityModel(odds.astype(np.float32), 0.0)
    table = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    for _ in range(rounds):
        windows, classes = _instances(bags, labels, model, rng)
        table, soft, bias = _fit(windows, classes, table, soft, bias, rng, epochs, rate)
        model = ToxicityModel((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    return model


def _instances(bags: list[Bags], labels: np.ndarray, model: ToxicityModel, rng) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows to train on: the worst of each toxic text, the worst and some at random of each clean one."""
    windows, classes = [], []
    for bag, y in zip(bags, labels, strict=True):
        words = len(bag.firsts) - 1
        if not words:
            continue
        found = model.windows(bag)[: max(1, words - WINDOW + 1)]
        picks = {int(found.argmax())} | (set() if y else set(rng.integers(0, len(found), 3).tolist()))
        for w in sorted(picks):
            window = bag.buckets[bag.firsts[w] : bag.firsts[min(w + WINDOW, words)]]
            if len(window):
                windows.append(window)
                classes.append(y)
    return windows, np.array(classes)


def _fit(windows, classes, table, soft, bias, rng, epochs: int, rate: float, batch: int = 64):
    """Minibatch gradient steps on table and softmax at once, the classes weighted alike."""
    weight = len(classes) / (2 * np.maximum(np.bincount(classes, minlength=2), 1))
    sizes = np.array([len(w) for w in windows])
    dim = table.shape[1]
    epochs = max(epochs, -(-STEPS * batch // len(windows)))  # a small sample is passed over more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ids, size = np.concatenate([windows[r] for r in rows]), sizes[rows]
            firsts = np.concatenate(([0], np.cumsum(size)[:-1]))
            hidden = np.add.reduceat(table[ids], firsts, axis=0) / size[:, None]
            logits = hidden @ soft + bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(rows)), classes[rows]] -= 1
            prob *= weight[classes[rows]][:, None]
            back = np.repeat(-step * (prob @ soft.T) / size[:, None], size, axis=0)
            soft -= step * (hidden.T @ prob) / len(rows)
            bias -= step * prob.mean(axis=0)
            own, place = np.unique(ids, return_inverse=True)
            for d in range(dim):
                table[own, d] += np.bincount(place, back[:, d], len(own))
    return table, soft, bias


def sample(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[list[str], np.ndarray]:
    """The bounded training sample. ``labels``: ``doc_id, toxic``; ``usable``: which ids may be learnt from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & usable).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ordered = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = ordered(1, SAMPLE_TOXIC).union(ordered(0, SAMPLE_CLEAN))
    own = own_columns(docs, "doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = own.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_TOXIC + SAMPLE_CLEAN).collect()
    return [r.text for r in rows], np.array([r.toxic for r in rows], dtype=np.int64)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.record_batch([part.column(0), pa.array(own.scores(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """``doc_id, score, predicted`` of every row. ``held_out``: a condition on ``doc_id`` of labels that must not be learnt from."""
    usable = F.lit(True) if held_out is None else ~held_out
    model = train(*sample(docs, own_columns(labels, "doc_id", "toxic"), usable))
    return scored(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_rows(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all their columns as they were."""
    usable = F.lit(True) if held_out is None else ~held_out
    model = train(*sample(docs, own_columns(labels, "doc_id", "toxic"), usable))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(own.scores(part.column(place).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
