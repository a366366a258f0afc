"""Document quality by positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled texts, a bounded sample of each, become vectors: how often each
kind of byte follows another, and a few shares of repeated words and lines, length of words and
share of letters. Labels other than 1 are never looked at.

The share of good texts among the unlabelled is estimated first: a plain classifier of positives
against unlabelled orders both, and the share is the least ratio of the parts of both above any
threshold. The model then minimises

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

which stays unbiased while the second term is positive and cannot go below zero by overfitting.

Results for odd input: null and empty texts get the vector of an empty text, and so one score; with
no positives or no texts to learn from every score is 0.5; repeated rows count
once; labels without a document are ignored, and of labels that disagree on one document a 1 wins;
an empty table gives an empty result; other columns can be carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import Rolling, blocks, bounded_sample, documents, held_out, small_batches, text_bytes, words

SAMPLE = 5_000
STEPS = 400
_LETTERS = {**{c: 1 for c in range(97, 123)}, **{c: 2 for c in range(65, 91)}, **{c: 3 for c in range(48, 58)}}
_MARKS = {10: 4, 13: 4, 32: 5, 9: 5, 46: 6, 44: 7, 33: 8, 63: 8, 124: 9, 45: 10, 39: 10, 34: 10, 40: 11, 41: 11, 58: 12, 59: 12, 47: 12}
KINDS = np.array([13 if b >= 0xC0 else 14 if b >= 0x80 else {**_LETTERS, **_MARKS}.get(b, 15) for b in range(256)], np.int64)
KIND_COUNT, STATS = 16, 8
SIZE = KIND_COUNT * KIND_COUNT + STATS


def _distinct_share(hashes: np.ndarray, row: np.ndarray, rows: int, counts: np.ndarray) -> np.ndarray:
    order = np.lexsort((hashes, row))
    new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1]))) if len(order) else order
    return np.bincount(row[order][new], minlength=rows) / np.maximum(counts, 1) if len(order) else np.zeros(rows)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of SIZE numbers in about [0, 1] per text."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, SIZE), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(rows), sizes)
    kind = KINDS[data]
    inner = row[1:] == row[:-1]
    pairs = np.where(inner, row[:-1], rows) * KIND_COUNT**2 + kind[:-1] * KIND_COUNT + kind[1:]
    counts = np.bincount(pairs, minlength=(rows + 1) * KIND_COUNT**2)[: rows * KIND_COUNT**2].reshape(rows, -1)
    out[:, : KIND_COUNT**2] = np.sqrt(counts / np.maximum(sizes - 1, 1)[:, None])
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    rolling = Rolling(data)
    word_row = np.repeat(np.arange(rows), n)
    line_edge = (data == 10).astype(bool)
    line_start = np.flatnonzero(np.concatenate(([True], line_edge[:-1] | ~inner)))
    line_end = np.append(line_start[1:], len(data))
    line_row = row[line_start]
    lines = np.bincount(line_row, minlength=rows)
    stats = out[:, KIND_COUNT**2 :]
    stats[:, 0] = _distinct_share(rolling.spans(starts, ends), word_row, rows, n)
    stats[:, 1] = _distinct_share(rolling.spans(line_start, line_end), line_row, rows, lines)
    length = np.bincount(word_row, ends - starts, minlength=rows) / np.maximum(n, 1)
    stats[:, 2] = np.minimum(length / 20, 2)
    stats[:, 3] = np.log1p(n) / 10
    stats[:, 4] = np.log1p(n / np.maximum(lines, 1)) / 7
    alpha = np.isin(kind, (1, 2, 13, 14))
    stats[:, 5] = np.bincount(row, alpha, minlength=rows) / np.maximum(sizes, 1)
    stats[:, 6] = np.bincount(row, kind == 2, minlength=rows) / np.maximum(sizes, 1)
    stats[:, 7] = sizes > 0
    return out


def _embedded(docs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in blocks(offsets):
                own = vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("good").slice(a, b - a), pa.array([v.tobytes() for v in own], pa.binary())], names=["good", "vector"]
                )

    return docs.mapInArrow(read, "good boolean, vector binary")


class Model:
    """A linear score of standardised vectors, squashed to (0, 1)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(size: int, gradient, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam, with weights drawn towards zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w) + 1e-3 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of unlabelled to positive scores above a threshold that keeps half the positives.

    Each ratio is taken a standard error up, or the least of many would be too low by chance.
    """
    best = 0.99
    for cut in np.quantile(positive, np.linspace(0.01, 0.5, 50)):
        p, u = (positive > cut).mean(), (unlabelled > cut).mean()
        error = np.sqrt(u * (1 - u) / len(unlabelled) + u * u * (1 - p) / max(p, 1e-9) / len(positive))
        best = min(best, (u + error) / max(p, 1e-9))
    return float(max(best, 0.05))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS) -> tuple[Model, float]:
    """Model and estimated prior from vectors of positives and of unlabelled texts."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE + 1)), 0.5
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))

    # Scores for the prior come from a model that has not seen the text: fit on one half, score the other.
    sides = [[], []]
    for fold in (0, 1):
        fp, fu = p[fold::2], u[fold::2]

        def against(w: np.ndarray, fp: np.ndarray = fp, fu: np.ndarray = fu) -> np.ndarray:
            return fu.T @ _sigmoid(fu @ w) / max(len(fu), 1) - fp.T @ _sigmoid(-(fp @ w)) / max(len(fp), 1) + 0.01 * w

        first = _descend(SIZE + 1, against, steps // 2)
        for side, x in zip(sides, (p, u), strict=True):
            side.append(x[1 - fold :: 2] @ first)
    prior = estimate_prior(*(np.concatenate(side) for side in sides))

    def risk(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        plus = -prior * (p.T @ _sigmoid(-zp)) / len(p)
        minus = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() < 0
        return -minus if below else plus + minus

    return Model(mean, scale, _descend(SIZE + 1, risk, steps)), prior


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, float]:
    """Fit on about ``sample`` rows with quality 1 and as many of all rows, labels unseen."""
    small_batches(docs.sparkSession)
    positive = bounded_sample(docs, sample, "good", labels.filter("quality = 1").select("doc_id").distinct())
    unlabelled = bounded_sample(docs, sample, "any")
    both = positive.select(F.lit(True).alias("good"), "text").union(unlabelled.select(F.lit(False).alias("good"), "text"))
    got = _embedded(both).toPandas()
    x = np.frombuffer(b"".join(got["vector"]), np.float32).reshape(-1, SIZE)
    flag = got["good"].to_numpy(bool)
    return fit(x[flag], x[~flag])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` and ``predicted``; other columns, the text too, are carried."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + "score double, predicted int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            own = [model.score(vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(offsets)]
            scores = np.concatenate(own) if own else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"]
            )

    return docs.mapInArrow(read, schema)


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model for op5 and the pipeline: learned from rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return learn(docs.filter(~held_out("doc_id", 3, 1)).select("doc_id", "text"), labels)[0]


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = score(docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text"), trained(spark, sf_dir, docs))
    return scored.drop("text")
