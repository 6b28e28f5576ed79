"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed letter n-grams, weighted by TF-IDF and of length 1. The
vectors of each language's sample are clustered, and a text gets the language of
the centroid of the largest cosine. A text that is farther from it than its cluster's
own texts, by a margin, is rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.texts import least_hashed, quoted, with_fields
from brindle.operators.ordered import broadcast_if_small, written

SIZE = 1 << 13
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of letter n-grams (1 to 3, a space standing for all else); None without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    # one space before, between and after words
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]
    c = np.where(letter, points, 32)[kept].astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(0x85EBCA77) + c[1:] * np.uint32(0xC2B2AE3D)
    three = two[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
    return np.bincount(np.concatenate([one, two, three]) >> np.uint32(19), minlength=SIZE)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    return (weighted / np.linalg.norm(weighted)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Centroids, each with its language and the least cosine that it accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is too far from the centroid."""
        counts = ngram_counts(text or "")
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ vector(counts, self.idf)
        best = int(cosines.argmax())
        cosine = float(np.clip(cosines[best], 0, 1))
        return self.languages[best], cosine, bool(cosine < self.least[best])


def clustered(vectors: np.ndarray, clusters: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 and each vector's cluster; starts from vectors far apart."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == k].sum(axis=0) if (own == k).any() else centroids[k]
                         for k in range(len(centroids))])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(SIZE + 1, np.int64)  # the last one counts texts
    for batch in batches:
        for text in batch.column(0):
            counts = ngram_counts(text.as_py())
            if counts is not None:
                found[:-1] += counts > 0
                found[-1] += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())],
                                     names=["bucket", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """IDF of each n-gram, over all texts of a one-column table; SIZE + 1 sums reach the driver."""
    sums = texts.mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).collect()
    found = np.zeros(SIZE + 1)
    for bucket, n in sums:
        found[bucket] = n
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 1


def train(docs: DataFrame, doc_id: str, text: str, lang: str, learnable: Column,
          per_language: int = 300, clusters: int = 3, slack: float = 0.5,
          languages: int = 500) -> Model:
    """Learn from rows that are ``learnable`` and have a language and a text.

    Document frequencies are counted over all of these. Centroids come from a
    sample of at most ``per_language`` texts of each language, those whose ids have
    the least hash, clustered in one task per language. A cluster rejects texts below
    ``slack`` times the cosine that all but a hundredth of its own texts reach.

    The model, which goes to the driver and to each task, has at most ``languages`` languages:
    those with the most texts to learn from, the first by name where as many have them. Other
    labels are never predicted. Rows without an id, a text or a language teach nothing, repeated
    ones are one, and of an empty table nothing is learned.
    """
    rows = docs.where(learnable).select(
        F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text"),
        F.col(quoted(lang)).alias("lang")).dropna(subset=["text", "lang"])
    idf = inverse_frequencies(rows.select("text"))
    known = rows.dropna(subset=["id"]).select("lang", "id").distinct()
    # at most `languages` rows; a language is counted in the map tasks
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(
        languages)
    known = known.join(F.broadcast(most.select("lang")), "lang", "left_semi")
    # broadcast if there are as few languages as there should be
    chosen = broadcast_if_small(written(least_hashed(known, "lang", "id", per_language)))
    # one text of each chosen id, however often it comes
    sample = rows.join(chosen, ["lang", "id"]).groupBy("lang", "id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        counts = [ngram_counts(t) for t in group.sort_values("id")["text"]]
        vectors = np.array([vector(c, idf) for c in counts if c is not None])
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        found, own = clustered(vectors, clusters)
        cosines = (vectors * found[own]).sum(axis=1)
        least = [slack * np.quantile(cosines[own == k], 0.01) if (own == k).any() else 0.0
                 for k in range(len(found))]
        return pd.DataFrame({"lang": group["lang"].iloc[0],
                             "centroid": [c.astype("<f4").tobytes() for c in found],
                             "least": least})

    made = sorted(sample.groupBy("lang").applyInPandas(
        centroids, "lang string, centroid binary, least double").collect())
    return Model(idf, np.array([np.frombuffer(c, "<f4") for _, c, _ in made]).reshape(-1, SIZE),
                 [name for name, _, _ in made], np.array([x for _, _, x in made]))


FIELDS = "lang_nearest string, score double, rejected boolean, lang_pred string"


def identify(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with lang_nearest, score (the cosine, 0 to 1), rejected and lang_pred.

    ``lang_pred`` is the nearest language, or ``und`` where the text is rejected. A null
    text and one without a letter have no nearest language: ``und`` and 0, rejected; so has
    any text if nothing was learned. Of equally near centroids the first language by
    name is taken. Whole texts are read, row by row: repeated rows get the same each, an empty
    table gives no rows. Columns named like a result are replaced by it.
    """
    def rows(texts: Iterable[str | None]) -> Iterator[tuple]:
        for t in texts:
            nearest, cosine, far = model.nearest(t)
            yield nearest, cosine, far, UNKNOWN if far else nearest

    return with_fields(df, text, FIELDS, rows)
