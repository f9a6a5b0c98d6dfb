"""Toxicity by multiple-instance learning: sentence scores under noisy-or, trained from document labels.

A document is a bag of sentences. A sentence has probability p of being toxic, a logistic function of the weights
of its words (each word whole, and its prefixes); a document is toxic unless no sentence is: 1 - prod(1 - p).
Only documents have labels. Training maximises their likelihood, which moves the blame to the sentences that
explain the label; scoring gives the document's probability and the sentences that carry it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import arrow_batches, fold, free, hand_back, map_rows, schema_with, strings, table

#: Labelled documents that the model is fitted on, at most: those with the smallest hashes of their identifiers.
TRAIN_ROWS = 4000
#: Bytes of their texts, at most.
TRAIN_BYTES = 64 << 20
#: Lengths of prefixes that are features beside the whole word, and buckets that features are hashed to.
PREFIXES, BUCKETS = (3, 4, 5), 1 << 20
#: Steps, rate and momentum of training; a feature must pull by more than SHRINK documents to leave zero, and moves
#: no faster than if RARE of the documents had it.
STEPS, RATE, MOMENTUM, SHRINK, RARE = 200, 0.3, 0.9, 0.5, 0.01
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3
#: Words whose weights a worker keeps.
MOST_WORDS = 300_000

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_BREAKS = frozenset(".!?\n")


def features(word: str) -> list[int]:
    """Buckets of a lower-case word: whole, and its prefixes if it is longer."""
    raw = [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in raw]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.weights[features(word)].sum())


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _bags(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Different words; word number and sentence number of each word in the texts; and each sentence's text number.
    Sentences without words have no number."""
    vocabulary: dict[str, int] = {}
    word, sentence, owner = array("q"), array("q"), array("q")  # a few bytes a word, however many words
    for k, text in enumerate(texts):
        fresh = True
        for token in _TOKEN.findall(text.lower()):
            if token[0] in _BREAKS:
                fresh = True
                continue
            if fresh:
                owner.append(k)
                fresh = False
            word.append(vocabulary.setdefault(token, len(vocabulary)))
            sentence.append(len(owner) - 1)
    return list(vocabulary), *(np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (word, sentence, owner))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fits the weights by proximal gradient steps with momentum on the noisy-or likelihood, at a pace set by how many
    documents have a feature. Without texts of both labels all weights are
    zero and the bias so low that every score is next to zero."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    words, word, sentence, owner = _bags(texts)
    lists = [features(w) for w in words]
    flat = np.array([i for x in lists for i in x], np.int64)
    of_word = np.repeat(np.arange(len(words)), [len(x) for x in lists])
    used, flat = np.unique(flat, return_inverse=True)
    met = np.unique(sentence * len(words) + word)  # each word of a sentence once
    word, sentence = met % len(words), met // len(words)
    n = len(y)
    in_docs = np.unique(owner[sentence] * len(words) + word)
    often = np.bincount(flat, np.bincount(in_docs % len(words), minlength=len(words))[of_word], len(used)) / n
    pace = RATE / np.maximum(often, RARE)
    w, speed, speed_b = np.zeros(len(used)), np.zeros(len(used)), 0.0
    bias = float(np.log(max(y.mean() * n / len(owner), 1e-9)))
    for _ in range(STEPS):
        by_word = np.bincount(of_word, w[flat], len(words))
        z = np.clip(bias + np.bincount(sentence, by_word[word], len(owner)), -60, 60)
        safe = np.bincount(owner, _softplus(z), n)  # -log of the chance that no sentence is toxic
        # d loss / d z: p for clean documents; -p (1 - toxic) / toxic for toxic ones
        pull = np.where(y > 0, -np.exp(-safe) / np.maximum(-np.expm1(-safe), 1e-12), 1.0) / n
        g_z = pull[owner] / (1 + np.exp(-z))
        g = np.bincount(flat, np.bincount(word, g_z[sentence], len(words))[of_word], len(w))
        speed = MOMENTUM * speed - pace * g
        speed_b = MOMENTUM * speed_b - RATE * float(g_z.sum())
        w = w + speed
        w = np.sign(w) * np.maximum(np.abs(w) - pace * SHRINK / n, 0)
        bias += speed_b
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


class Scorer:
    """Scores texts with a model; keeps the weights of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _weights(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        known, word = self.known, self.model.word
        for w in words:
            if w not in known:
                known[w] = 0.0 if w[0] in _BREAKS else word(w)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The document score of each text: 0 for texts without words."""
        tokens = [_TOKEN.findall(x.lower()) for x in texts]
        count = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = pa.array([t for x in tokens for t in x], pa.string()).dictionary_encode()
        if not len(flat):
            return np.zeros(len(texts))
        words = flat.dictionary.to_pylist()
        at = flat.indices.to_numpy()
        cut = np.fromiter((w[0] in _BREAKS for w in words), bool, len(words))[at]
        owner = np.repeat(np.arange(len(texts)), count)
        new = cut | np.concatenate(([True], owner[1:] != owner[:-1]))
        sentence = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        met = np.unique(sentence[~cut] * len(words) + at[~cut])  # each word of a sentence once
        sentence = met // len(words)
        full = np.bincount(sentence, minlength=len(first)) > 0
        z = self.model.bias + np.bincount(sentence, self._weights(words)[met % len(words)], len(first))
        safe = np.bincount(owner[first][full], _softplus(z[full]), len(texts))
        return -np.expm1(-safe)

    def sentences(self, text: str, least: float = THRESHOLD) -> list[dict]:
        """Sentences with words whose own score is `least` or more: start and end (code points) and score."""
        found = []
        for m in _SENTENCE.finditer(text):
            words = _WORD.findall(m[0].lower())
            z = self.model.bias + sum(map(self.model.word, set(words)))
            if words and (p := float(np.exp(-_softplus(-z)))) >= least:
                found.append({"start": m.start(), "end": m.end(), "score": p})
        return found


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> list[tuple[str, int]]:
    """Texts and labels to fit on: label rows outside the held-out fold, `most` of them at most, those with the
    smallest hashes of their identifiers, as far as their whole texts come to `most_bytes`. Null labels and identifiers
    are left out; identifiers that several rows bear don't make more than `most` rows."""
    doc, toxic, size, held = (free(docs.columns, name) for name in ("_doc", "_toxic", "_size", "_held"))
    chosen = labels.select(F.col("doc_id").alias(doc), F.col("toxic").alias(toxic)).where(F.col(doc).isNotNull() & F.col(toxic).isNotNull() & (fold(F.col(doc)) != 2))
    chosen = chosen.orderBy(F.xxhash64(doc), doc, toxic).limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col(doc))
    rows = rows.select("text", toxic, doc, F.coalesce(F.octet_length("text"), F.lit(0)).alias(size))
    order = [F.xxhash64(doc), F.col(doc), F.col(toxic), F.xxhash64("text")]
    rows = rows.orderBy(*order).limit(most)
    held_bytes = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of `most` rows at most
    rows = rows.withColumn(held, held_bytes).where(F.col(held) <= most_bytes).orderBy(doc, toxic, F.xxhash64("text"))
    return [(r[0] or "", int(r[1])) for r in rows.select("text", toxic).collect()]


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fits in the driver, which hands back what that took: the steps after this one run beside what it keeps."""
    rows = training_rows(docs, labels, most)
    try:
        return fit([t for t, _ in rows], [y for _, y in rows])
    finally:
        hand_back()


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", locate: bool = False) -> DataFrame:
    """docs with columns tox_score and, if `locate`, tox_sentences (start, end, score of offending sentences of
    documents at or over the threshold). A null text or one without words has score 0 and no sentences. Columns of docs
    under these names are replaced."""
    spark = docs.sparkSession
    arrow_batches(spark)
    schema = schema_with(docs, ("tox_score", T.DoubleType()), *[("tox_sentences", _SPANS)] * locate)
    kept = [k for k, f in enumerate(docs.schema.fields) if f in schema.fields[: len(schema) - 1 - locate]]
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = strings(batch.column(at))
            p = scorer.scores(texts)
            columns = [*(batch.column(k) for k in kept), pa.array(p)]
            if locate:
                columns.append(pa.array([scorer.sentences(t) if x >= THRESHOLD else [] for t, x in zip(texts, p.tolist(), strict=True)], spans))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_rows(docs, run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are predicted clean, columns as they are."""
    model = train(docs, labels, most)
    spark = docs.sparkSession
    arrow_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(strings(batch.column(at))) < THRESHOLD))

    return map_rows(docs, run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    # Identifiers go round the operator, not into it: scores are of texts alone.
    found = score(docs, model, locate=True).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "tox_score")).alias("score"), "tox_sentences")
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "tox_sentences")
