"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct hashed words, and 0 if none of
them has a weight; a document's is the noisy-or of one leak, the same for every document, and of the scores of all its
sentences, 1 - (1 - leak) * prod(1 - p). So weak sentences add up, but those without a weighted word never do, however many a
long text has. Weights and leak are trained from document labels alone, by gradient steps on the log loss of just that
score, and so locate the offending sentences too (those of OFFENDING and more).

The model is fitted on a bounded sample: at most ``most_labelled`` labelled documents, those of the smallest hashes of
their ids, whole texts. Scoring passes over all rows without a shuffle.

Defined results: a null or empty text, or one without a word, has score 0 and no offending sentences; without labelled
rows every score is 0. Of several labels of a document the largest counts. Rows of equal ids are all scored, and one of them
is learnt from; columns other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.texts import IS_LEAD, Slice, slices, utf8

BITS = 18
MOST_LABELLED = 8_000
#: A word gets a weight if this many documents of the sample have it, and the lower bound of its share of labelled-toxic
#: ones (Wilson's, at BOUND_Z deviations) is above that of LIFT documents taken at random, one of them labelled toxic:
#: 1 - (1 - rate) ** LIFT. Labels are noisy, and rare words would learn the noise.
LEAST_DOCUMENTS, LIFT, BOUND_Z = 4, 3.5, 2.0
#: Gradient steps, their size, and how strongly a word is held to its own odds.
STEPS, RATE, HOLD = 250, 0.15, 0.5
#: A word of a lower score alone than this is left out: it would only add up in long texts.
LEAST_ALONE = 0.5
OFFENDING = 0.5
#: Log odds of a sentence whose words say nothing; fixed, so that no weak word is carried by a high bias.
BIAS = -5.0

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def sentence_words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each sentence that has a word, its first and last byte, and (sentence, word) pairs without repeats."""
    w = s.words(_APART)
    before = np.concatenate([[0], np.cumsum(_ENDS[s.data])])
    mark = before[w.starts] + w.rows
    sentence = np.cumsum(np.diff(mark, prepend=mark[:1]) > 0)
    n = int(sentence[-1]) + 1 if len(sentence) else 0
    first = np.searchsorted(sentence, np.arange(n))
    last = np.searchsorted(sentence, np.arange(n), "right") - 1
    pairs = np.unique(sentence.astype(np.int64) << BITS | (s.hashes(w) >> np.uint64(64 - BITS)).astype(np.int64))
    return w.rows[first], np.stack([w.starts[first], w.ends[last]]), pairs >> BITS, pairs & (1 << BITS) - 1


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    leak: float

    def sentences(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, extent in bytes and score of each sentence."""
        row, extent, sentence, word = sentence_words(s)
        weight = self.weights[word]
        z = self.bias + np.bincount(sentence, weight, len(row))
        return row, extent, np.where(np.bincount(sentence, weight != 0, len(row)) > 0, 1 / (1 + np.exp(-z)), 0.0)

    def documents(self, row: np.ndarray, p: np.ndarray, n_rows: int) -> np.ndarray:
        """Score of each row; one without a sentence has no leak."""
        clean = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n_rows) + np.where(np.bincount(row, minlength=n_rows) > 0, np.log1p(-self.leak), 0.0)
        return np.abs(np.expm1(clean))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        labels = batch.column(1).to_pylist()
        for a, b in slices(offsets):
            row, _, sentence, word = sentence_words(Slice(_LOWER[data], offsets, a, b))
            own = row[sentence]
            ends = np.searchsorted(own, np.arange(b - a + 1))
            start = np.searchsorted(row, np.arange(b - a))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(labels[a:b], pa.int32()), lists(sentence - start[own]), lists(word)], names=["label", "sentence", "word"])


def fit_toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    learn: Column | None = None, most_labelled: int = MOST_LABELLED,
) -> ToxicityModel:
    """Train on the rows of labels for which ``learn`` (over the column "id") holds."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    named = named.where(learn) if learn is not None else named
    named = named.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # The broadcast has at most most_labelled rows of two numbers; of rows with one id, that of the least hash is learnt from.
    sample = rows.join(F.broadcast(named), "id").groupBy("id").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("text", "label")
    return train(sample.mapInArrow(_bags, "label int, sentence array<int>, word array<int>").toArrow().combine_chunks())


def train(bags: pa.Table) -> ToxicityModel:
    """Of documents with a label, and the sentence and hash of each of their words."""
    y = bags.column("label").to_numpy() > 0
    model = ToxicityModel(np.zeros(1 << BITS, np.float32), BIAS, 0.0)
    if not y.any():
        return model
    sizes = bags.column("word").combine_chunks().value_lengths().to_numpy()
    sentence = bags.column("sentence").combine_chunks().flatten().to_numpy()
    word = bags.column("word").combine_chunks().flatten().to_numpy()
    doc, rate = np.repeat(np.arange(len(y)), sizes), float(y.mean())
    pairs = np.unique(doc.astype(np.int64) << BITS | word)
    of, marked = pairs & (1 << BITS) - 1, y[pairs >> BITS]
    n, k, z = np.bincount(of, minlength=1 << BITS), np.bincount(of, marked, 1 << BITS), BOUND_Z
    share = k / np.maximum(n, 1)
    spread = z * np.sqrt(share * (1 - share) / np.maximum(n, 1) + z * z / (4 * np.maximum(n, 1) ** 2))
    bound = (share + z * z / (2 * np.maximum(n, 1)) - spread) / (1 + z * z / np.maximum(n, 1))
    kept = np.flatnonzero((n >= LEAST_DOCUMENTS) & (bound > 1 - (1 - rate) ** LIFT))
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    known = number[word] >= 0
    owner, place = np.unique(doc[known].astype(np.int64) << 32 | sentence[known], return_inverse=True)
    owner, feature = owner >> 32, number[word[known]]
    # Adam on the mean log loss of documents. A word sets out from its own odds and is held to them, so that words that come together share
    # the credit.
    c, own = BIAS, np.log(bound[kept] / (1 - bound[kept])) - BIAS
    w = own.copy()
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, STEPS + 1):
        z = BIAS + np.bincount(place, w[feature], len(owner))
        p, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-c))
        clean = np.exp(-np.bincount(owner, np.logaddexp(0, z), len(y)) - np.logaddexp(0, c))  # (1 - leak) * prod(1 - p)
        pull = np.where(y, -clean / np.maximum(1 - clean, 1e-9), 1.0) / len(y)
        g = np.concatenate([np.bincount(feature, (p * pull[owner])[place], len(kept)) + HOLD / len(y) * (w - own), [leak * pull.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, c = w - step[:-1], c - step[-1]
    live = 1 / (1 + np.exp(-BIAS - w)) > LEAST_ALONE
    model.weights[kept[live]] = w[live]
    model.leak = float(min(1 / (1 + np.exp(-c)), 1 - 1e-12))
    return model


def _scored(model: ToxicityModel) -> Callable:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                s = Slice(_LOWER[data], offsets, a, b)
                row, extent, p = model.sentences(s)
                score = model.documents(row, p, b - a)
                bad = np.flatnonzero(p >= OFFENDING)
                points = np.concatenate([[0], np.cumsum(IS_LEAD[s.data], dtype=np.int64)])
                places = points[extent[:, bad]] - points[s.bounds[row[bad]]]
                spans = pa.StructArray.from_arrays([pa.array(places[0]), pa.array(places[1]), pa.array(p[bad])], ["start", "stop", "score"])
                ends = pa.array(np.searchsorted(row[bad], np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.clip(score, 0.0, 1.0)), pa.ListArray.from_arrays(ends, spans).cast(kind)], names=["id", "score", "offending"]
                )

    return run


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and offending sentences (start and stop in code points, score) of every row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, score double, offending array<struct<start:long,stop:long,score:double>>"
    return rows.mapInArrow(_scored(model), schema).withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df, whole, whose score is below the threshold."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            keep = []
            for a, b in slices(offsets):
                row, _, p = model.sentences(Slice(_LOWER[data], offsets, a, b))
                keep.append(model.documents(row, p, b - a) < threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return df.mapInArrow(run, df.schema)
