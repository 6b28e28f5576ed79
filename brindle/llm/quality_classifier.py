"""Quality classifier: naive Bayes features for a linear support vector machine.

A text is the set of its character n-grams, hashed, and of runs of one word. Each n-gram's
indicator is scaled by the log of the ratio of its shares in the two classes; a
linear hinge-loss model is fitted to that by dual coordinate descent, and
its margins are turned into scores by a logistic curve fitted on texts left out.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.texts import least_hashed, quoted, with_fields

HASHED = 1 << 16
SIZE = HASHED + 2


def features(text: str) -> np.ndarray:
    """Indices of the n-grams of two and three characters, and of three and four equal words."""
    marked = np.zeros(SIZE, dtype=bool)
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(
        0xC2B2AE3D)
    marked[two >> np.uint32(16)] = True
    marked[three >> np.uint32(16)] = True
    words = text.split()
    h = np.fromiter(map(hash, words), np.int64, len(words))
    pairs = h[1:] == h[:-1]
    triples = pairs[1:] & pairs[:-1]
    marked[HASHED] = triples.any()
    marked[HASHED + 1] = (triples[1:] & triples[:-1]).any()
    return np.flatnonzero(marked).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """``scale``: log-count ratios; ``weights``: of the scaled indicators; a, b: the curve."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, found: np.ndarray) -> float:
        scaled = self.scale[found]
        length = np.sqrt(scaled @ scaled) or 1.0
        return float(self.weights[found] @ scaled / length + self.bias)

    def score(self, text: str | None) -> float:
        z = self.a * self.margin(features(text or "")) + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, scale=self.scale, weights=self.weights,
                 rest=np.array([self.bias, self.a, self.b]))
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as found:
            return cls(found["scale"], found["weights"], *found["rest"].tolist())


def constant(score: float) -> Model:
    zeros = np.zeros(SIZE, dtype=np.float32)
    return Model(zeros, zeros, 0.0, 0.0, float(np.log(score / (1 - score))))


def descend(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, costs: np.ndarray,
            rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model, by dual coordinate descent."""
    values = [scale[r] for r in rows]
    values = [v / (np.sqrt(v @ v) or 1.0) for v in values]
    squares = np.array([v @ v + 1.0 for v in values])  # 1: the bias is one more feature
    weights, bias = np.zeros(SIZE), 0.0
    dual = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            slope = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - slope / squares[i], 0.0), costs[i])
            if new != dual[i]:
                step = (new - dual[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    return weights, bias


def curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve, with targets a little inside 0 and 1."""
    n1, n0 = good.sum(), (~good).sum()
    if not n1 or not n0:
        return 2.0, 0.0
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good, 0.5 / n1, 0.5 / n0) * len(good)
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    found = np.array([2.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-3 * found
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        found = found - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(max(found[0], 0.0)), float(found[1])


def fit(rows: list[np.ndarray], good: np.ndarray, cost: float = 1.0) -> Model:
    """A model of rows of feature indices. Every fifth is left for the curve."""
    if not len(rows) or good.all() or not good.any():
        return constant(0.5 if not len(rows) else 0.999 if good[0] else 0.001)
    apart = np.arange(len(rows)) % 5 == 4
    if good[~apart].all() or not good[~apart].any():
        apart[:] = False
    learn = np.flatnonzero(~apart)
    counts = np.ones((2, SIZE))
    for i in learn:
        counts[int(good[i]), rows[i]] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    scale = np.log(shares[1] / shares[0]).astype(np.float32)
    signs = np.where(good[learn], 1.0, -1.0)
    weigh = np.where(signs > 0, 0.5 / max((signs > 0).sum(), 1), 0.5 / max((signs < 0).sum(), 1))
    weights, bias = descend([rows[i] for i in learn], signs, scale.astype(float),
                            cost * weigh * len(learn))
    model = Model(scale, weights.astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(apart)
    a, b = curve(np.array([model.margin(rows[i]) for i in rest]), good[rest])
    return Model(scale, model.weights, bias, a, b)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str,
                    learnable: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` texts of each label, as ``id``, ``text``, ``good``: those of least hash.

    An id with several labels takes the least, one with several texts the one of least
    hash. Labels other than 0 and 1, and null ids, are left out.
    """
    known = (labels.where(learnable & F.col(quoted(doc_id)).isNotNull()
                          & F.col(quoted(label)).isin(0, 1))
             .groupBy(F.col(quoted(doc_id)).alias("id"))
             .agg(F.min(quoted(label)).alias("good")))
    chosen = least_hashed(known, "good", "id", per_class)
    texts = docs.select(F.col(quoted(doc_id)).alias("id"),
                        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    # at most 2 * per_class rows of an id and a label
    return (texts.join(F.broadcast(chosen), "id").groupBy("id", "good")
            .agg(F.min_by("text", F.xxhash64("text")).alias("text")))


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str,
          learnable: Column, per_class: int = 3000, cost: float = 1.0) -> Model:
    """Fit on a sample of at most ``per_class`` texts of each label, in one task."""
    sample = labelled_sample(docs, labels, doc_id, text, label, learnable, per_class)

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int32()))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, good = [], []
        for batch in batches:
            good += batch.column(0).to_pylist()
            rows += [r.values.to_numpy() for r in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([fit(rows, np.array(good, dtype=bool), cost).dump()], pa.binary())],
            names=["model"])

    made = (sample.select(F.xxhash64("id").alias("h"), "id", "good", found("text").alias("found"))
            .repartition(1).sortWithinPartitions("h", "id").select("good", "found")
            .mapInArrow(fitted, "model binary"))
    row = made.first()
    return Model.load(row.model) if row else constant(0.5)


def score_texts(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with ``score``, 0 to 1: the likelihood of label 1.

    Whole texts are scored, row by row. A null text is an empty one, which has the
    score of a text without n-grams. Repeated rows get the same score each, an empty table gives
    no rows. A column named score is replaced.
    """
    def rows(texts: Iterable[str | None]) -> Iterator[tuple]:
        return ((model.score(t),) for t in texts)

    return with_fields(df, text, "score double", rows)
