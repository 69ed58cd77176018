"""Language identification by the nearest of several centroids per language.

A text is a vector of its character 1- to 3-grams (letters in lower case, any run of other characters as one space),
hashed to DIMENSIONS, weighted by log(1 + tf) * idf and normalised. Each language has up to ``centroids`` centroids from
spherical k-means. The prediction is the language of the most similar centroid by cosine; a text farther from it than
REJECT_DEVIATIONS deviations of the centroid's own members is marked as rejected.

Document frequencies cover every labelled row that may be learned from. The centroids are fitted on a bounded sample of
about ``sample`` rows of each language, chosen by a hash of the id, one task for each language.

Defined results: a null text and one without a letter get "und", score 0, not rejected; so does every text if there is
nothing to learn from. Ties go to the language first in order. Rows of equal ids are all predicted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.texts import mix, slices, utf8
from quillspark.session import materialize

DIMENSIONS = 4096
CENTROIDS, SAMPLE, ROUNDS = 4, 1000, 12
#: Languages up to which their counts are broadcast.
FEW_LANGUAGES = 10_000
REJECT_DEVIATIONS = 4.0
#: Rows whose dense vectors a task holds at once.
MOST_ROWS = 1000
UNDETERMINED = "und"
_U = np.uint64


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: is it a letter, and its lower case."""
    is_letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    low = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(is_letter).tolist():
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
    return is_letter, low


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, [text, dimension], and which texts have a letter."""
    is_letter, low = _letters()
    points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    letter = is_letter[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    chars = np.where(letter[at], low[points[at]], 32).astype(_U)
    row = np.searchsorted(ends, at)
    counts = np.zeros(len(texts) * DIMENSIONS)
    code = np.zeros(len(chars), _U)
    for n in (1, 2, 3):
        if len(chars) < n:
            break
        code = code[: len(chars) - n + 1] * _U(0x110000) + chars[n - 1 :]
        whole = row[: len(code)] == row[n - 1 :]
        bucket = (mix(code + _U(n)) >> _U(52)).astype(np.int64)
        counts += np.bincount(row[: len(code)][whole] * DIMENSIONS + bucket[whole], minlength=len(counts))
    return counts.reshape(len(texts), DIMENSIONS), np.bincount(row, letter[at], len(texts)) > 0


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts, out=np.zeros_like(counts), where=counts > 0) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    data, offsets = utf8(column)
    for a, b in slices(offsets, most_rows=MOST_ROWS):
        yield a, b, [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, b)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, texts with it) over the task's rows; dimension -1 counts the texts."""
    total = np.zeros(DIMENSIONS + 1, np.int64)
    for batch in batches:
        for _, _, texts in _texts(batch.column(0)):
            counts, lettered = gram_counts(texts)
            total[1:] += (counts > 0).sum(axis=0)
            total[0] += lettered.sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(total)], names=["dimension", "n"])


def _cluster(idf: np.ndarray, k: int) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values(["order", "text"]).text.tolist()
        x = np.concatenate([vectors(gram_counts(texts[i : i + MOST_ROWS])[0], idf) for i in range(0, len(texts), MOST_ROWS)])
        centers, nearest = x[:1], x @ x[0]
        while len(centers) < min(k, len(x)):  # farthest first
            centers = np.vstack([centers, x[int(np.argmin(nearest))]])
            nearest = np.maximum(nearest, x @ centers[-1])
        for _ in range(ROUNDS):
            own = (x @ centers.T).argmax(axis=1)
            sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        similarity = x @ centers.T
        own, best = similarity.argmax(axis=1), similarity.max(axis=1)
        out = []
        for j in range(len(centers)):
            member = best[own == j] if (own == j).any() else best
            out.append((key[0], j, centers[j].astype(np.float32), float(max(0.0, member.mean() - REJECT_DEVIATIONS * member.std()))))
        return pd.DataFrame(out, columns=["lang", "j", "center", "least"])

    return run


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    centers: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts, lettered = gram_counts(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        similarity = vectors(counts, self.idf) @ self.centers.T
        best = similarity.argmax(axis=1)
        score = np.where(lettered, np.clip(similarity[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
        names = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)]
        return names, score, lettered & (score < self.least[best])


def fit_languages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None,
    centroids: int = CENTROIDS, sample: int = SAMPLE,
) -> LanguageModel:
    """Learn from the rows with a language for which ``learn`` (over the column "id") holds."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    rows = rows.where(learn) if learn is not None else rows
    counted = rows.select("text").mapInArrow(_frequencies, "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    n = {r.dimension: r.n for r in counted}
    idf = np.log((1 + n.get(-1, 0)) / (1 + np.array([n.get(d, 0) for d in range(DIMENSIONS)]))) + 1
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # a row for each language, as the model has
    # So few that no text need be shuffled by its language; any more are joined by it.
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_LANGUAGES else sizes
    order = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 31))
    chosen = rows.join(sizes, "lang").withColumn("order", order).where(F.col("order") * F.col("n") < F.lit(float(sample) * (1 << 31)))
    fitted = chosen.select("lang", "text", "order").groupBy("lang").applyInPandas(_cluster(idf, centroids), "lang string, j int, center array<float>, least double")
    found = sorted(fitted.collect(), key=lambda r: (r.lang, r.j))
    centers = np.array([r.center for r in found]).reshape(len(found), DIMENSIONS)
    return LanguageModel(idf, [r.lang for r in found], centers, np.array([r.least for r in found]))


def _predicted(model: LanguageModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _texts(batch.column(1)):
                names, score, rejected = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"]
                )

    return run


def identify_language(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (cosine) and rejected of every row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predicted(model), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
