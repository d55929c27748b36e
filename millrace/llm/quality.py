"""A quality classifier learnt from positive and unlabelled documents.

The model minimises the non-negative unbiased risk: the loss of trusted positives as
positives, plus that of unlabelled text as negatives less the positives' part of it, where
that difference is kept from falling below zero. The positives' part is the class prior.
Inputs are figures of the text alone, each spread over hinges at quantiles of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, text_of
from millrace.llm.words import scramble, shingles, word_hashes

# About so many trusted positives, and as many unlabelled documents, are fetched to fit the model.
SAMPLE = 6000
THRESHOLD = 0.3
FOLDS = 5
KNOTS = 7

_KIND = np.full(256, 7)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b" \t\x0b\x0c\r")] = 3
_KIND[list(b"\n")] = 4
_KIND[list(b".,;:'\"()-?")] = 5
_KIND[128:] = 6
N_KINDS = 8
FIGURES = N_KINDS + 10


def figures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of figures per text: shares of kinds of bytes, and how words are spread and repeated."""
    n = len(offsets) - 1
    out = np.zeros((n, FIGURES))
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(text * N_KINDS + _KIND[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
    out[:, :N_KINDS] = kinds / np.maximum(sizes, 1)[:, None]
    hashes, words = word_hashes(data, offsets)
    for row in range(n):
        own = hashes[words[row] : words[row + 1]]
        count = len(own)
        if count:
            _, seen = np.unique(own, return_counts=True)
            pairs = shingles(own, 2)
            share = seen / count
            out[row, N_KINDS:] = [
                np.log1p(count),
                sizes[row] / count,
                len(seen) / count,
                share.max(),
                -(share * np.log(share)).sum(),
                np.mean(own[1:] == own[:-1]) if count > 1 else 0,
                len(np.unique(pairs)) / len(pairs),
                np.mean(seen == 1),
                np.mean(own[2:] == own[:-2]) if count > 2 else 0,
                (kinds[row, 5] + kinds[row, 7]) / count,
            ]
    return out


class Model:
    """Hinges at quantiles of each figure, and one weight per hinge."""

    def __init__(self, sample: np.ndarray):
        grid = np.linspace(0, 1, KNOTS + 2)[1:-1]
        self.mean, self.scale = sample.mean(axis=0), sample.std(axis=0) + 1e-9
        self.knots = np.quantile((sample - self.mean) / self.scale, [0, *grid, 1], axis=0)
        self.weights = np.zeros(sample.shape[1] * (len(self.knots) + 1) + 1)

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -20, 20)
        hinges = [np.minimum(np.maximum(x - knot, 0), 3) for knot in self.knots]
        return np.concatenate([np.clip(x, -3, 3), *hinges, np.ones((len(x), 1))], axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(rows) @ self.weights, -50, 50)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Adam on the whole sample; deterministic."""
        p, u = self.inputs(positive), self.inputs(unlabelled)
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        soft = lambda z: np.logaddexp(0, z)
        for step in range(1, steps + 1):
            zp, zu = p @ self.weights, u @ self.weights
            negative_risk = soft(zu).mean() - prior * soft(zp).mean()
            negative = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
            if negative_risk >= 0:
                gradient = prior * (p.T @ (sigmoid(zp) - 1)) / len(p) + negative
            else:
                gradient = -negative  # the risk has been fitted below zero: go back
            gradient = gradient + decay * self.weights
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            move = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.weights -= rate * (1 - step / (steps + 1)) * move


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from positives and unlabelled rows alone.

    One half of each is told apart by a model; on the other half, the share of unlabelled rows with a
    score above a cut, over that of positives, is the prior if no negative scores so high. The
    cut is the one with the least ratio, margins for the numbers of rows included.
    """
    model = Model(np.concatenate([positive[::2], unlabelled[::2]]))
    model.fit(positive[::2], unlabelled[::2], 0.5)
    ours, others = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    if not len(ours) or not len(others):
        return 1.0
    cuts = np.unique(ours)
    above = lambda x: 1 - np.searchsorted(x, cuts) / len(x)
    margin = sum(np.sqrt(np.log(40) / (2 * len(x))) for x in (ours, others))
    best = np.argmin((above(others) + margin) / above(ours))
    return float(np.clip(above(others)[best] / above(ours)[best], 0.01, 1))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: a fifth of the ids, and rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in byte_slices(batch.column("text")):
            part = batch.slice(first, end - first)
            yield pa.record_batch([part.column("doc_id"), pa.array(list(figures(data, offsets)))], names=["doc_id", "figures"])


def _sampled(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """About so many ids, drawn by hash; never more than twice as many."""
    share = min(1.0, rows / max(1, ids.count()))
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * rows)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 10) -> Model | None:
    """Fit on about ``sample`` trusted positives and as many other documents, all outside the held-out fold.

    The class prior is the share of positives among all labelled rows outside that fold; where
    these are all positive, it is estimated from them and the other documents (``estimated_prior``).
    Labels that are null or neither 0 nor 1 are left out; an id labelled twice is trusted if
    all its labels are 1. Without positives or texts there is no model.
    """
    labels = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    labels = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not counts[1]:
        return None
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    ids = rows.select("doc_id").where(~held_out(F.col("doc_id")))
    trusted = _sampled(labels.where("quality = 1").select("doc_id"), sample, seed)
    other = _sampled(ids, sample, seed + 1)

    def fetched(chosen: DataFrame) -> np.ndarray:
        # at most twice the sample's number of ids, whatever the corpus
        texts = rows.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")
        found = texts.mapInArrow(_figures, "doc_id BIGINT, figures ARRAY<DOUBLE>").limit(4 * sample).toPandas()
        found = sorted(zip(found["doc_id"], map(tuple, found["figures"]), strict=True))
        return np.array([x for _, x in found]).reshape(-1, FIGURES)

    positive, unlabelled = fetched(trusted), fetched(other)
    if not len(positive) or not len(unlabelled):
        return None
    model = Model(np.concatenate([positive, unlabelled]))
    model.fit(positive, unlabelled, counts[1] / counts[0] if counts[1] < counts[0] else estimated_prior(positive, unlabelled))
    return model


def _scores(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column("text")):
                part = batch.slice(first, end - first)
                scores = model.score(figures(data, offsets)) if model else np.full(end - first, 0.5)
                columns = [part.column(name) for name in part.schema.names if name != "text"]
                yield pa.record_batch([*columns, pa.array(scores)], names=[*(n for n in part.schema.names if n != "text"), "score"])

    return run


def quality_scores(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row; the score depends on the text alone.

    A null text counts as empty. Without a model every score is 0.5.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    scored = rows.mapInArrow(_scores(model), "doc_id BIGINT, score DOUBLE")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def _passed(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column("text")):
                part = batch.slice(first, end - first)
                yield part.filter(pa.array(model.score(figures(data, offsets)) >= threshold)) if model else part

    return run


def drop_rejected(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    return docs.mapInArrow(_passed(model, threshold), docs.schema)
