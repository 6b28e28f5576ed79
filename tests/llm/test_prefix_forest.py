"""Neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import prefix_forest
from brindle.llm.prefix_forest import Forest, search
from brindle.llm.queries import QUERIES
from brindle.sources import Tables


def brute(vectors, queries, k):
    """vectors: id -> rows. The k best other ids of each query."""
    ids = sorted(vectors)
    found = {}
    for q in queries:
        scores = {i: max((x * y).sum() for x in vectors[q] for y in vectors[i])
                  for i in ids if i != q}
        found[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return found


def rows_of(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def recall(found, wanted):
    hits = [len({i for i, _ in found[q]} & {i for i, _ in w}) / len(w) for q, w in wanted.items()]
    return np.mean(hits)


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors of different lengths in clusters; a third of them nearly the same."""
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((30, 24)) * 3
    x = centers[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 24)) * 0.4
    x[::3] = centers[0] + rng.standard_normal((1000, 24)) * 0.01
    x[3:60:3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), x


def test_recall_and_order_on_clusters(clustered):
    df, x = clustered
    queries = range(0, 3000, 100)
    wanted = brute({i: [v] for i, v in enumerate(x)}, queries, 10)
    forest = Forest(trees=12, rows_per_block=200)
    found = rows_of(search(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10, forest))
    assert set(found) == set(wanted)
    assert recall(found, wanted) > 0.9
    for q, got in found.items():
        assert got == sorted(got, key=lambda s: (-s[1], s[0])) and len(got) == 10
        for i, score in got:
            assert score == pytest.approx((x[q] * x[i]).sum(), abs=1e-12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [0.1, 0.9]),
            (3, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1.0, None]),
            (120, []), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumns({"code": F.lit("own"), "vector": F.lit(1), "rank": F.lit(2)})
    found = rows_of(search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20))
    vectors = {}
    for i, v in rows[:5]:
        vectors.setdefault(i, []).append(np.array(v))
    wanted = brute(vectors, [0, 20], 20)
    assert found == {q: [(i, pytest.approx(s)) for i, s in w] for q, w in wanted.items()}
    assert search(df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0, 20).count() == 0
    assert search(df, "vec_id", "embedding", F.lit(None).cast("boolean"), 20).count() == 0


def test_recall_of_the_query(spark, medium):
    found = rows_of(QUERIES["op7_prefix_forest_search"](spark, medium))
    vectors = {r.vec_id: [np.array(r.embedding)] for r in Tables(spark, medium).embeddings.collect()}
    wanted = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert set(found) == set(wanted) and all(len(v) == 20 for v in found.values())
    assert recall(found, wanted) >= 0.9


def test_queries_are_dealt_in_parts(spark, monkeypatch):
    """All vectors ask; half are copies that share each string, the others go to the root."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1600, 24))
    x[::2] = x[0] + rng.standard_normal((800, 24)) * 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>")
    searcher = prefix_forest._searcher

    def bounded(*args):
        run = searcher(*args)

        def checked(index, queries):
            assert len(index) <= 200 and len(queries) <= 200, (len(index), len(queries))
            return run(index, queries)
        return checked

    monkeypatch.setattr(prefix_forest, "_searcher", bounded)
    found = rows_of(search(df, "vec_id", "embedding", F.lit(True), 5,
                           Forest(trees=4, rows_per_block=100)))
    wanted = brute({i: [v] for i, v in enumerate(x)}, range(1, 1600, 50), 5)
    assert len(found) == 1600
    assert recall({q: found[q] for q in wanted}, wanted) == 1


def test_strings(spark):
    """Axes and sides against plain ones; a longest prefix against a plain count."""
    rng = np.random.default_rng(2)
    x, forest = rng.standard_normal((50, 9)), Forest(trees=3)
    found, axes = prefix_forest.codes(x, forest, 3)
    seen = (x.astype(np.float32) @ prefix_forest._frames(forest.seed, 3, 9)).reshape(50, 3, -1)
    for i in range(50):
        for tree in range(3):
            along, across = seen[i, tree, :64], seen[i, tree, 64:]
            order = np.argsort(-np.abs(along))[:3]
            assert axes[i, tree].tolist() == [2 * a + (along[a] > 0) for a in order]
            string = f"{axes[i, tree, 0]:07b}" + "".join("01"[int(s > 0)] for s in across)
            assert found[i, tree] == int(string, 2)
    code = np.sort(np.concatenate([found[:, 0], found[:20, 0], [found[0, 0]] * 6]))
    begin, end, depth = prefix_forest._ranges(code, found[:, 0], 63, 7, 4)
    for string, b, e, d in zip(found[:, 0], begin, end, depth):
        same = [int(c >> (63 - d)) == int(string >> (63 - d)) for c in code]
        assert np.flatnonzero(same).tolist() == list(range(b, e))
        assert e - b >= 4 or d == 7
        if d < 63:
            assert sum(int(c >> (61 - d)) == int(string >> (61 - d)) for c in code) < 4


def test_recall_at_each_ending(spark):
    """Queries with more candidates than k whose cosine has just passed a bound, or any other."""
    rng = np.random.default_rng(6)
    forest, size = Forest(), 128
    bounds = [prefix_forest.least_cosine(forest, w) for w in forest.widths]
    rows, queries = [], {c: [] for c in [*bounds, 0.6, 0.8, 0.9, 0.95, 0.99]}
    for cosine in queries:
        for _ in range(20):
            q = rng.standard_normal(size)
            q /= np.linalg.norm(q)
            queries[cosine].append(len(rows))
            rows.append(q)
            for c in cosine + rng.uniform(0.001, 0.004, 60):
                v = rng.standard_normal(size)
                v -= (v @ q) * q
                rows.append(c * q + np.sqrt(1 - c ** 2) * v / np.linalg.norm(v))
    x = np.array(rows)
    asks = F.col("vec_id").isin([q for found in queries.values() for q in found])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>")
    made = search(df, "vec_id", "embedding", asks, 20, forest).checkpoint()
    ended = {r.query_id: r.ended for r in made.select("query_id", "ended").distinct().collect()}
    found = rows_of(made)
    for cosine, at in queries.items():
        near = x[at] @ x.T
        near[np.arange(len(at)), at] = -2
        wanted = {q: [(int(i), 0) for i in np.argsort(-row)[:20]] for q, row in zip(at, near)}
        print("cosine", cosine, "recall", recall(found, wanted), [ended[q] for q in at])
        assert recall(found, wanted) >= 0.9, cosine
    assert set(ended.values()) >= {0, *forest.widths}
    compared = made.groupBy("ended").agg(F.avg("compared")).collect()
    print(compared)
    assert dict(map(tuple, compared))[0] < len(x) / 2
