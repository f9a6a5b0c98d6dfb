"""Language identification of words in code-switched text by a linear-chain CRF.

Words have affix, character n-gram and lexicon (whole word) features, all hashed to BUCKETS weights a language,
and the languages of neighbours are tied by learned transitions. Training texts have one language each; so that
transitions can be learned, they are cut into runs of words which are shuffled across languages and joined to
code-switched sequences with known labels. A text's words get label probabilities by forward-backward; the text's
language is that with the highest mean probability.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm import crf
from skein.llm.common import arrow_batches, fold, map_rows, schema_with, strings, table

#: Documents that the field is fitted on, at most (those with the smallest hashes of their identifiers), whole.
TRAIN_ROWS = 600
#: Bytes of their texts, at most.
TRAIN_BYTES = 16 << 20
BUCKETS = 1 << 18
#: Words of a run and runs of a sequence in training; steps, rate and shrinkage.
RUN, RUNS, STEPS, RATE, DECAY, SEED = (8, 40), 12, 30, 0.15, 0.5, 11
#: The language of texts without letters.
UNDETERMINED = "und"
#: Bytes of text scored together.
SCORE_BYTES = 8 << 20

#: Odd constants of the features' hash.
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """For texts (strings without nulls): the different words, the word number of each word in the texts, and the
    words of each text. A word is the letters, lower-cased, of what stands between white space."""
    split = pc.utf8_split_whitespace(texts)
    pieces = split.flatten().dictionary_encode()
    letters = pc.utf8_lower(pc.replace_substring_regex(pieces.dictionary, r"[^\p{L}]+", "")).dictionary_encode()
    words = letters.dictionary.to_pylist()
    code = letters.indices.to_numpy()[pieces.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
    has = np.fromiter(map(bool, words), bool, len(words))[code] if len(code) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    return words, code[has], np.bincount(owner[has], minlength=len(texts))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words, and each one's word (ascending): the word itself, prefixes of 1 to 3
    letters, suffixes of 1 to 4, and bigrams and trigrams with the word's ends. All words are hashed at once."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    within = np.arange(len(c)) - start[owner]
    power = np.cumprod(np.full(int(size.max()), _Q))
    kinds = [(np.add.reduceat(c * power[within], start), np.arange(len(words)))]
    for n in (2, 3):
        at = np.flatnonzero(within < size[owner] - n + 1)
        kinds.append((sum(c[at + k] * power[k] for k in range(n)), owner[at]))
    for n in (1, 2, 3, 4):
        own = np.flatnonzero(size - 2 >= n)
        if n < 4:
            kinds.append((sum(c[start[own] + 1 + k] * power[k] for k in range(n)), own))
        kinds.append((sum(c[start[own] + size[own] - 1 - n + k] * power[k] for k in range(n)), own))
    bits = np.uint64(64 - (BUCKETS.bit_length() - 1))
    mixed = [(h ^ h >> np.uint64(29)) * _P + np.uint64(k * int(_Q) % 2**64) for k, (h, _) in enumerate(kinds)]
    bucket = np.concatenate([(h ^ h >> np.uint64(32)) * _P >> bits for h in mixed]).astype(np.int64)
    of_word = np.concatenate([w for _, w in kinds])
    order = np.argsort(of_word, kind="stable")
    return bucket[order], of_word[order]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray


def fit(texts: list[str], languages: list[str]) -> Model:
    """Fits the field. Without texts with letters there are no languages, and every text is undetermined."""
    known = sorted(set(languages))
    words, code, count = split_words(pa.array(texts, pa.string()))
    runs: list[tuple[np.ndarray, int]] = []
    draw = random.Random(SEED)
    for own, language in zip(np.split(code, np.cumsum(count)[:-1]) if texts else [], languages, strict=True):
        at = 0
        while at < len(own):
            n = draw.randint(*RUN)
            runs.append((own[at : at + n], known.index(language)))
            at += n
    if not runs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    draw.shuffle(runs)
    sequences = []
    for k in range(0, len(runs), RUNS):
        part = runs[k : k + RUNS]
        sequences.append((np.concatenate([w for w, _ in part]), np.repeat([y for _, y in part], [len(w) for w, _ in part])))
    return Model(known, *crf.fit(*word_features(words), len(words), sequences, len(known), BUCKETS, STEPS, RATE, DECAY))


class Identifier:
    """Labels words and texts with a model."""

    def __init__(self, model: Model):
        self.model = model

    def _scores(self, words: list[str]) -> np.ndarray:
        bucket, of_word = word_features(words)
        first = np.searchsorted(of_word, np.arange(len(words)))
        return np.add.reduceat(self.model.weights[bucket], first, axis=0)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """For texts (strings without nulls): the number of words of each, label probabilities of all words in order,
        the different words and the number of each word."""
        words, code, count = split_words(texts)
        if not len(code):
            return count, np.zeros((0, len(self.model.languages))), words, code
        chains = crf.Chains(self._scores(words)[code], count[count > 0], self.model.move, self.model.begin)
        return count, chains.marginals()[0], words, code

    def languages(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its mean probability over the words (0 for undetermined texts)."""
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        count, p, _, _ = self.words(texts)
        owner = np.repeat(np.arange(len(texts)), count)
        mean = np.stack([np.bincount(owner, p[:, k], len(texts)) for k in range(p.shape[1])], 1) / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        names = [self.model.languages[k] if n else UNDETERMINED for k, n in zip(best.tolist(), count.tolist(), strict=True)]
        return names, np.clip(mean[np.arange(len(texts)), best], 0, 1)


def train(docs: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fits on rows with a language outside the held-out fold, `most` of them at most (those with the smallest hashes of
    their identifiers), as far as their whole texts come to `most_bytes`."""
    order = [F.xxhash64("doc"), F.col("doc"), F.col("lang"), F.col("hash")]
    rows = docs.select(F.col("doc_id").alias("doc"), "lang", F.xxhash64("text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    rows = rows.where(F.col("doc").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc")) != 2)).orderBy(*order).limit(most)
    chosen = rows.withColumn("held", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("held") <= most_bytes)
    # Rows that repeat identifier, language and text count once.
    chosen = chosen.select("doc", F.col("lang").alias("known"), "hash").distinct()
    same = (F.col("doc_id") == F.col("doc")) & (F.col("lang") == F.col("known")) & (F.xxhash64("text") == F.col("hash"))
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), same, "left_semi").groupBy("doc_id", "lang", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"))
    rows = found.orderBy("doc_id", "lang", "hash").collect()
    return fit([r.text or "" for r in rows], [r.lang for r in rows])


_WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())]))


def identify(docs: DataFrame, model: Model, text: str = "text", words: bool = False) -> DataFrame:
    """docs with lang_pred and lang_score and, if `words`, word_langs (an array of structs word, lang, p).

    A null text counts as empty; texts without letters are `und` with score 0 and no words. Only the text is
    looked at. Columns of docs under these names are replaced."""
    spark = docs.sparkSession
    arrow_batches(spark)
    schema = schema_with(docs, ("lang_pred", T.StringType()), ("lang_score", T.DoubleType()), *[("word_langs", _WORDS)] * words)
    kept = [k for k, f in enumerate(docs.schema.fields) if f in schema.fields[: len(schema) - 2 - words]]
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text)
    labelled = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for batch in gathered(batches):
            texts = pa.array(strings(batch.column(at)), pa.string())
            found, p = identifier.languages(texts)
            columns = [*(batch.column(k) for k in kept), pa.array(found, pa.string()), pa.array(p)]
            if words:
                columns.append(pa.array(_labelled(identifier, texts), labelled))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_rows(docs, run, schema)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to SCORE_BYTES, so that a word is looked up once for many documents."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.nbytes for b in waiting) >= SCORE_BYTES:
            yield pa.concat_batches(waiting)
            waiting = []
    if waiting:
        yield pa.concat_batches(waiting)


def _labelled(identifier: Identifier, texts: pa.Array) -> list[list[dict]]:
    if not identifier.model.languages:
        return [[] for _ in texts]
    count, p, words, code = identifier.words(texts)
    best, out, at = p.argmax(1), [], 0
    names = [words[k] for k in code.tolist()]
    for n in count.tolist():
        out.append([{"word": names[k], "lang": identifier.model.languages[best[k]], "p": float(p[k, best[k]])} for k in range(at, at + n)])
        at += n
    return out


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
