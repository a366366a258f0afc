"""Toxicity by multiple-instance learning: sentences scored from labels of whole documents.

A document is a bag of sentences. A sentence's score is a squashed sum of weights of its words, and
the document's score is the noisy-or of its sentences: 1 - product of (1 - sentence score). Weights
are learned from document labels alone, through the noisy-or, so they single out the sentences that
explain the labels; these are then located.

Learning uses a bounded number of labelled documents. Only words seen in several toxic ones, and
clearly more often there than elsewhere, can carry weight: at most WORDS of them. A sentence is then
a short list of such words, mostly empty, and the model a table of bounded size.

Results for odd input: a text without words, null or empty, has one empty sentence and so the lowest
score; without toxic or other documents to learn from every score is the share of toxic labels;
repeated rows teach once; labels without a document are ignored, and of labels
that disagree on one document a 1 wins; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import LOWER_VALUES, Rolling, blocks, bounded_sample, documents, held_out, small_batches, text_bytes

SAMPLE = 12_000
WORDS = 4_096
# A word must be in so many of the toxic documents that are learned from.
LEAST_TOXIC_DOCS = 4
STEPS = 300
THRESHOLD = 0.3
# What a word is made of, and what ends a sentence.
IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
ENDS_SENTENCE = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash and sentence of every lower-cased word; then row, start and end of every sentence.

    Sentences are numbered through all rows; a row has at least one. An end mark belongs to the
    sentence before it, and marks in a row end one sentence only.
    """
    rows = len(offsets) - 1
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = Rolling(data, LOWER_VALUES).spans(starts, ends) if len(starts) else np.empty(0, np.uint64)
    mark = ENDS_SENTENCE[data]
    # A sentence begins where its row does, and behind the last of some end marks.
    begins = np.zeros(len(data) + 1, bool)
    begins[1:][mark] = True
    begins[:-1] &= ~mark
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(begins[: len(data)])
    sentence = np.cumsum(begins[: len(data)]) - 1
    row = np.searchsorted(offsets, begin, "right") - 1
    stop = np.append(begin[1:], len(data))
    empty = np.flatnonzero(np.diff(offsets) == 0)
    if len(empty):
        where = np.searchsorted(row, empty)
        shift = np.searchsorted(np.sort(where), np.arange(len(row)), "right")
        sentence = (np.arange(len(row)) + shift)[sentence] if len(row) else sentence
        row = np.insert(row, where, empty)
        begin, stop = np.insert(begin, where, offsets[empty]), np.insert(stop, where, offsets[empty])
    assert len(np.unique(row)) == rows
    return hashes, sentence[starts], row, begin, stop


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Bags:
    """Documents as counts of plain sentences plus lists of known words of the others."""

    def __init__(self, plain: np.ndarray, word: np.ndarray, sentence: np.ndarray, doc: np.ndarray):
        self.plain, self.word, self.sentence, self.doc = plain, word, sentence, doc

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Of the sentences that hold known words."""
        return weights[-1] + np.bincount(self.sentence, weights[self.word], minlength=len(self.doc))

    def clean(self, weights: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Log of the chance that no sentence of the document is toxic."""
        return -self.plain * np.logaddexp(0, weights[-1]) - np.bincount(self.doc, np.logaddexp(0, z), minlength=len(self.plain))


def fit(bags: Bags, toxic: np.ndarray, words: int, steps: int = STEPS) -> np.ndarray:
    """Weights of the words and, last, of every sentence, by Adam on the likelihood of the labels."""
    rate = np.clip(toxic.mean(), 1e-4, 1 - 1e-4)
    w = np.zeros(words + 1)
    w[-1] = np.log(rate / (1 - rate)) - np.log(1 + (bags.plain + np.bincount(bags.doc, minlength=len(bags.plain))).mean())
    m, v = np.zeros(words + 1), np.zeros(words + 1)
    for t in range(1, steps + 1):
        z = bags.logits(w)
        clean = np.minimum(bags.clean(w, z), -1e-9)
        # d(-log likelihood) / d(log chance of clean)
        slope = np.where(toxic, np.exp(clean) / -np.expm1(clean), -1.0) / len(toxic)
        per_sentence = -slope[bags.doc] * _sigmoid(z)
        g = np.append(
            np.bincount(bags.word, per_sentence[bags.sentence], minlength=words)[:words],
            per_sentence.sum() - (slope * bags.plain).sum() * _sigmoid(w[-1]),
        )
        g[:-1] += 2e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return w


class Model:
    """Sorted hashes of the known words, their weights, and the weight of every sentence."""

    def __init__(self, known: np.ndarray, weights: np.ndarray):
        self.known, self.weights = known, weights

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Score, row, start and end of every sentence."""
        hashes, sentence, row, begin, stop = sentence_words(data, offsets)
        z = np.full(len(row), self.weights[-1])
        if len(self.known) and len(hashes):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = np.flatnonzero(self.known[at] == hashes)
            # A word counts once per sentence, as in learning.
            pairs = np.unique(np.stack([sentence[hit], at[hit]], axis=1), axis=0) if len(hit) else np.empty((0, 2), np.int64)
            z += np.bincount(pairs[:, 0], self.weights[pairs[:, 1]], minlength=len(row))
        return _sigmoid(z), row, begin, stop


def _bag_words(docs: DataFrame) -> DataFrame:
    """Per document: its words' hashes and their sentences, and the number of sentences."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in blocks(offsets):
                hashes, sentence, row, _, _ = sentence_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of = row[sentence]
                first = np.searchsorted(row, np.arange(b - a))
                pairs = np.stack([sentence, hashes.view(np.int64)], axis=1)
                pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
                of = row[pairs[:, 0]]
                cuts = np.searchsorted(of, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("toxic").slice(a, b - a),
                        pa.array(np.bincount(row, minlength=b - a)),
                        pa.array([pairs[i:j, 1].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                        pa.array([(pairs[i:j, 0] - f).astype(np.int32).tobytes() for i, j, f in zip(cuts[:-1], cuts[1:], first, strict=True)], pa.binary()),
                    ],
                    names=["toxic", "sentences", "hashes", "places"],
                )

    return docs.mapInArrow(read, "toxic boolean, sentences long, hashes binary, places binary")


def _known_words(bagged: DataFrame, toxic_docs: int, all_docs: int) -> np.ndarray:
    """Hashes of the words that tell toxic documents best, at most WORDS, sorted."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(np.frombuffer(h, np.int64)) for h in batch.column("hashes").to_pylist()]
            flag = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64), [len(o) for o in own])
            words, at = np.unique(np.concatenate(own or [np.empty(0, np.int64)]), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words), pa.array(np.bincount(at, minlength=len(words))), pa.array(np.bincount(at, flag, minlength=len(words)).astype(np.int64))],
                names=["word", "docs", "toxic"],
            )

    counts = bagged.select("toxic", "hashes").mapInArrow(seen, "word long, docs long, toxic long").groupBy("word")
    rate = toxic_docs / max(all_docs, 1)
    tells = (F.col("toxic") - F.col("docs") * rate) / F.sqrt(F.col("docs") * rate + 1)
    top = (
        counts.agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        .filter((F.col("toxic") >= LEAST_TOXIC_DOCS) & (tells > 3))
        .orderBy(tells.desc(), "word")
        .limit(WORDS)
    )
    return np.sort(np.array([r["word"] for r in top.select("word").collect()], np.int64).view(np.uint64))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled documents (``doc_id, text``; ``doc_id, toxic``)."""
    small_batches(docs.sparkSession)
    marks = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    chosen = bounded_sample(docs.select("doc_id", "text"), sample, "toxic", marks)
    bagged = _bag_words(chosen.select("text", "toxic"))
    total, toxic_docs = bagged.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    if not toxic_docs or toxic_docs == total:
        share = min(max(toxic_docs / total if total else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.empty(0, np.uint64), np.array([np.log(share / (1 - share))]))
    known = _known_words(bagged, toxic_docs, total)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for hashes, places in zip(batch.column("hashes").to_pylist(), batch.column("places").to_pylist(), strict=True):
                hashes, places = np.frombuffer(hashes, np.uint64), np.frombuffer(places, np.int32)
                at = np.searchsorted(known, hashes)
                hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes) if len(known) else at[:0]
                kept.append((at[hit].astype(np.int32).tobytes(), places[hit].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("sentences"), *(pa.array([k[i] for k in kept], pa.binary()) for i in (0, 1))],
                names=["toxic", "sentences", "words", "places"],
            )

    got = bagged.mapInArrow(lean, "toxic boolean, sentences long, words binary, places binary").toPandas()
    sizes = [len(p) // 4 for p in got["places"]]
    word, place = (np.frombuffer(b"".join(got[c]), np.int32).astype(np.int64) for c in ("words", "places"))
    doc = np.repeat(np.arange(len(got)), sizes)
    sentence_key, sentence = np.unique(doc * (1 << 32) + place, return_inverse=True)
    sentence_doc = sentence_key >> 32
    plain = got["sentences"].to_numpy() - np.bincount(sentence_doc, minlength=len(got))
    return Model(known, fit(Bags(plain, word, sentence, sentence_doc), got["toxic"].to_numpy(bool), len(known)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score``, ``predicted`` and ``offending``: the sentences that reach the threshold alone,
    or else the highest of a document that reaches it, as byte spans. ``text`` is dropped, all else carried."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted", "offending")
    carried = [c for c in docs.columns if c != "text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    schema += "score double, predicted int, offending array<struct<start:bigint,stop:bigint,score:double>>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            scores: list[float] = []
            spans: list[list[dict]] = []
            for a, b in blocks(offsets):
                own = offsets[a : b + 1] - offsets[a]
                each, row, begin, stop = model.sentences(data[offsets[a] : offsets[b]], own)
                total = -np.expm1(np.bincount(row, np.log1p(-np.minimum(each, 1 - 1e-12)), minlength=b - a))
                high = np.zeros(b - a)
                np.maximum.at(high, row, each)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                shown = (total[row] >= threshold) & ((each >= threshold) | (each == high[row]))
                for k in np.flatnonzero(shown).tolist():
                    low = own[row[k]]
                    found[row[k]].append({"start": int(begin[k] - low), "stop": int(stop[k] - low), "score": float(each[k])})
                scores += np.clip(total, 0, 1).tolist()
                spans += found
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))),
                ],
                names=[*carried, "score", "predicted", "offending"],
            )

    return docs.mapInArrow(read, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    held = held_out("doc_id", 4, 2)
    model = learn(docs.filter(~held), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model)
