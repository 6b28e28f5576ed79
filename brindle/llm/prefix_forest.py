"""Approximate nearest neighbours by a forest of hash prefixes.

In each tree a vector has a string of 63 bits: first a symbol of seven, the axis of a random
frame that is nearest to the vector, then the sides of 56 random planes on which it lies. A
tree is the strings in sorted order, cut into blocks: contiguous ranges of strings, the large
ones dealt out in parts.

A query first descends, by binary search, to the longest prefix of its own string that enough
rows share, in each tree to another depth. Then all trees go up together: to the first symbol
alone, and for it also to the next nearest axes of the query. Each time, the cosine of the
k-th best of what all trees found says how likely one like it was missed by all of them; where
that is rare, the search ends. At last all vectors are looked at, in blocks. So how far a query
goes depends on how near its neighbours are, and not on the size of the table.

Inner products are searched as cosines: a vector gets one more component that
brings it to the largest length in the table, a query gets 0 there.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.llm.texts import quoted
from brindle.operators.ordered import broadcast_if_small
from brindle.session import checkpoint_folder

#: A string is a symbol, one of 2 * AXES and so of SYMBOL bits, and PLANES bits.
AXES, SYMBOL, PLANES = 64, 7, 56
STRING = SYMBOL + PLANES
#: Prefixes grow by so many bits on the way down.
STEP = 2
#: Queries that are compared with a part of a block at once.
SLICE = 256
#: Steps of the cosine for which chances are known.
GRID = 100


@dataclass(frozen=True)
class Forest:
    """``missed``: how likely the k-th neighbour may be overlooked when a search ends.

    Nearer neighbours are overlooked less often, so the recall is ``1 - missed`` at least, also
    where many stand just above a bound. Fewer missed with as many trees as before raises the
    bounds: more queries go on to the root. ``enough`` is how many rows a tree's longest prefix
    has at least, for each neighbour wanted; ``widths`` are the numbers of a query's nearest
    axes that it sees on the way up, rising and less than AXES.
    """

    trees: int = 26
    missed: float = 0.08
    enough: int = 4
    widths: tuple[int, ...] = (2, 3)
    rows_per_block: int = 8192
    seed: int = 7


@functools.cache
def _frames(seed: int, trees: int, size: int) -> np.ndarray:
    made = np.random.default_rng(seed).standard_normal((size, trees * (AXES + PLANES)))
    return made.astype(np.float32)


def codes(vectors: np.ndarray, forest: Forest, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's string in each tree, as a number, and its nearest axes, nearest first."""
    frames = _frames(forest.seed, forest.trees, vectors.shape[1])
    seen = (vectors.astype(np.float32) @ frames).reshape(-1, forest.trees, AXES + PLANES)
    along, across = seen[..., :AXES], seen[..., AXES:]
    size = np.abs(along)
    if width == 1:
        axes = size.argmax(axis=2)[..., None]
    else:
        axes = np.argpartition(-size, range(width), axis=2)[..., :width]
    symbols = axes * 2 + (np.take_along_axis(along, axes, axis=2) > 0)
    # a string's bytes, greatest first
    raw = np.concatenate([symbols[..., :1].astype(np.uint8),
                          np.packbits(across > 0, axis=2)], axis=2)
    return np.ascontiguousarray(raw).view(">i8")[..., 0].astype(np.int64), symbols


@functools.cache
def _shares(width: int) -> tuple[float, ...]:
    """How often one's symbol is among the other's ``width`` nearest axes, by their cosine.

    Found by trial, for each step of the cosine from 0 to 1.
    """
    rng = np.random.default_rng(1)
    u, v = rng.standard_normal((2, 20_000, AXES)).astype(np.float32)
    rows, sizes = np.arange(len(u)), np.abs(u)
    coarse = np.linspace(0, 1, 41)
    found = []
    for c in coarse:
        w = c * u + math.sqrt(1 - c * c) * v
        axis = np.abs(w).argmax(axis=1)
        along = (u[rows, axis] * np.sign(w[rows, axis]))[:, None]
        nearer = (sizes > along).sum(axis=1) + (-sizes > along).sum(axis=1)
        found.append((nearer < width).mean())
    share = np.maximum.accumulate(found)
    return tuple(np.interp(np.linspace(0, 1, GRID + 1), coarse, share).tolist())


@functools.cache
def least_cosine(forest: Forest, width: int) -> float:
    """The cosine whose neighbours are rarely missed by all trees at the first symbol."""
    needed = 1 - forest.missed ** (1 / forest.trees)
    enough = np.array(_shares(width)) >= needed
    return float(enough.argmax() / GRID) if enough.any() else math.inf


def _log_missed(cosine: Column, depth: Column) -> Column:
    """The logarithm of the chance that a tree misses a neighbour by a prefix of so many bits."""
    shares = F.array(*[F.lit(x) for x in _shares(1)])
    symbol = F.element_at(shares, (F.floor(cosine * GRID) + 1).cast("int"))
    plane = 1 - F.acos(cosine) / math.pi
    # a copy has every symbol and side
    found = F.when(cosine >= 1, 1.0).otherwise(symbol * F.pow(plane, depth - SYMBOL))
    return F.log1p(-F.least(found, F.lit(1 - 1e-12)))


def _usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vector.isNotNull() & ~F.coalesce(bad, F.lit(True))
            & F.exists(vector, lambda x: x != 0))


def _squared(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


def _hashed(forest: Forest, longest: float, as_query: bool, dtype: str):
    """Rows of tree, code, nearest axes, id, vector and its length, for each vector and tree."""
    width = max(forest.widths) if as_query else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                ids, vectors = batch.slice(begin, 256).columns
                x = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(ids), -1)
                lengths = np.linalg.norm(x, axis=1)
                more = np.zeros(len(x)) if as_query else np.sqrt(
                    np.maximum(longest ** 2 - lengths ** 2, 0))
                found, axes = codes(np.column_stack([x, more]), forest, width)
                raw = pa.array([v.tobytes() for v in x.astype(dtype)], pa.binary())
                rows = np.repeat(np.arange(len(x)), forest.trees)
                made = [pa.array(np.tile(np.arange(forest.trees), len(x)), pa.int32()),
                        pa.array(found.ravel(), pa.int64()),
                        ids.take(pa.array(rows)), raw.take(pa.array(rows))]
                names = ["tree", "code", "id", "vector"]
                if as_query:
                    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
                    made += [pa.array(lengths[rows], pa.float64()), pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(axes.ravel().astype(np.int32)))]
                    names += ["length", "axes"]
                yield pa.RecordBatch.from_arrays(made, names=names)
    return run


def best_of(query: np.ndarray, query_id, vectors: np.ndarray, ids: np.ndarray,
            near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best, ties to smaller ids; ``near`` are rough ones.

    The products given out are summed in the same way wherever a vector stands.
    """
    usable = ids != query_id
    if usable.sum() > k:
        bound = np.partition(near[usable], -k)[-k]
        usable &= near >= bound - 1e-9 * max(abs(bound), 1.0)
    at = np.flatnonzero(usable)
    exact = (vectors[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def _ranges(code: np.ndarray, strings: np.ndarray, longest: int, least: int,
            enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each string's longest prefix that ``enough`` codes share begins and ends, its bits.

    ``code`` is sorted. The prefix has ``least`` bits where fewer codes share that.
    """
    begin, end, depth = (np.zeros(len(strings), np.int64) for _ in range(3))
    left = np.arange(len(strings))
    for bits in [*range(longest, least, -STEP), least]:
        rest = (1 << (STRING - bits)) - 1
        low = strings[left] & ~rest
        first = np.searchsorted(code, low)
        last = np.searchsorted(code, low | rest, side="right")
        ends = (last - first >= enough) | (bits == least)
        at = left[ends]
        begin[at], end[at], depth[at] = first[ends], last[ends], bits
        left = left[~ends]
    return begin, end, depth


def _searcher(longest: int, least: int, enough: int, k: int, dtype: str):
    """Searches a part of a block for a part of its queries, which all get a row."""
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries):
            index = index.sort_values("code", kind="stable")
            code, ids = index["code"].to_numpy(np.int64), index["id"].to_numpy()
            asking, tree = queries["id"].to_numpy(), queries["tree"].to_numpy()
            q = np.frombuffer(b"".join(queries["vector"]), dtype).reshape(len(queries), -1)
            q = q.astype(np.float64)
            x = np.frombuffer(b"".join(index["vector"]), dtype).reshape(-1, q.shape[1])
            x = x.astype(np.float64)
            begins, ends, depths = _ranges(code, queries["code"].to_numpy(np.int64), longest,
                                           least, enough)
            order = np.lexsort((ends, begins))
            cuts = np.flatnonzero(np.diff(begins[order]) | np.diff(ends[order])) + 1
            for at in np.split(order, cuts):
                begin, end = begins[at[0]], ends[at[0]]
                for some in np.split(at, range(SLICE, len(at), SLICE)):
                    near = q[some] @ x[begin:end].T
                    for row, i in zip(near, some):
                        got, scores = best_of(q[i], asking[i], x[begin:end], ids[begin:end],
                                              row, k)
                        found.append((asking[i], tree[i], depths[i], end - begin, got, scores))
        return pd.DataFrame(found, columns=["query_id", "tree", "depth", "compared", "ids",
                                            "scores"])
    return search


def search(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int,
           forest: Forest = Forest()) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query row.

    Returns query_id, rank (from 1), vec_id and score, nearest first, ties to the smaller
    id; all other vectors where there are k or fewer. ``ended`` says how the query's search
    ended: 0 by longest prefixes, a number of axes, or -1 at the root, and ``compared`` how many
    rows it met, each as often as it did. Every row is indexed. Null, zero and
    non-finite vectors, vectors of another size than most, and rows without an id take no
    part. An id that comes twice is one candidate, by its nearer vector; as a query it
    keeps the best of both, and is never its own neighbour. An empty table gives no rows.

    Index rows hold a vector each and are moved once for each step of the way up, and for
    each part of their block's queries. A group of a task is a part of a block and a part of
    its queries, of about ``rows_per_block`` rows each, whatever share has the same string.
    Blocks of the longest prefixes get more with the table, so there a block is met by the
    queries of its own range only; what few rows share a prefix stays few.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    own = df.select(F.col(quoted(vec_id)).alias("id"), F.col(quoted(vector)).alias("vector"),
                    F.coalesce(is_query, F.lit(False)).alias("asks"))
    id_type = own.schema["id"].dataType.simpleString()
    wide = isinstance(own.schema["vector"].dataType.elementType, DoubleType)
    dtype = "<f8" if wide else "<f4"
    v = F.col("vector")
    own = own.where(F.col("id").isNotNull() & _usable(v))
    sizes = own.groupBy(F.size(v).alias("size")).agg(
        F.count("*").alias("n"), F.sqrt(F.max(_squared(v.cast("array<double>")))).alias("longest"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    if most is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, "
                                         "score double, ended int, compared long")
    own = own.where(F.size(v) == most.size).select("id", "vector", "asks")
    columns = f"tree int, code long, id {id_type}, vector binary"
    index = own.select("id", "vector").mapInArrow(
        _hashed(forest, most.longest, False, dtype), columns)
    open_queries = own.where("asks").select("id", "vector").mapInArrow(
        _hashed(forest, most.longest, True, dtype),
        columns + ", length double, axes array<int>").checkpoint()
    hit = (f"query_id {id_type}, tree int, depth int, compared long, ids array<{id_type}>, "
           "scores array<double>")

    # A block is so many leading bits that it has about rows_per_block rows if strings are even.
    bits = max(0, math.ceil(math.log2(most.n / forest.rows_per_block)))

    @functools.cache
    def hot_blocks(bits: int) -> DataFrame:
        return _hot(index.select("tree", _block(bits)), "parts", forest.rows_per_block)

    def met(asking: DataFrame, bits: int, longest: int, least: int, enough: int) -> DataFrame:
        """What the queries find in their blocks of so many leading bits."""
        at = ["tree", "block"]
        rows, asking = index.select("*", _block(bits)), asking.select("*", _block(bits))
        hot = hot_blocks(bits)
        pressed = _hot(asking, "askings", forest.rows_per_block)
        if bits <= SYMBOL:
            # at most trees * 2 ** SYMBOL rows
            rows = rows.join(F.broadcast(asking.select(*at).distinct()), at, "left_semi")
        rows, asking = (d.join(hot, at, "left").join(pressed, at, "left")
                        .withColumns({n: F.coalesce(n, F.lit(1)) for n in ("parts", "askings")})
                        for d in (rows, asking))
        rows = rows.select(*at, "code", "id", "vector", _part("parts").alias("part"),
                           _each("askings").alias("asking"))
        asking = asking.select(*at, "code", "id", "vector", "parts",
                               _part("askings").alias("asking"))
        asking = asking.withColumn("part", _each("parts")).drop("parts")
        by = [*at, "part", "asking"]
        return rows.groupBy(*by).cogroup(asking.groupBy(*by)).applyInPandas(
            _searcher(longest, least, enough, k, dtype), hit).checkpoint()

    norms = open_queries.where("tree = 0").groupBy(F.col("id").alias("query_id")).agg(
        F.max("length").alias("norm"))
    wanted = min(k, most.n - 1)
    best, ways, costs = None, None, None
    for step, width in enumerate((0, *forest.widths)):
        if width == 0:
            deep = min(bits, STRING)
            hits = met(open_queries, deep, STRING, max(SYMBOL, deep), forest.enough * k)
        else:
            # axes that were not seen before
            seen = (0, *forest.widths)[step - 1]
            axes = F.slice("axes", seen + 1, width - seen)
            asking = open_queries.withColumn("axis", F.explode(axes)).withColumn(
                "code", F.shiftleft(F.col("axis").cast("long"), PLANES))
            hits = met(asking, min(bits, SYMBOL), SYMBOL, SYMBOL, 0)
        best = _merged(hits, k, best).checkpoint()
        # cosine of the k-th best with the query: its score over both lengths
        ends = (best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
                .where(F.col("n") >= wanted).join(norms, "query_id")
                .withColumn("cosine", F.greatest(F.lit(0.0), F.least(F.lit(1.0),
                            F.col("worst") / (F.col("norm") * most.longest)))))
        if width == 0:
            depths = hits.groupBy("query_id", "tree").agg(F.max("depth").alias("depth"))
            over = (depths.join(ends, "query_id").groupBy("query_id")
                    .agg(F.sum(_log_missed(F.col("cosine"), F.col("depth"))).alias("log"))
                    .where(F.col("log") <= math.log(forest.missed)))
        else:
            over = ends.where(F.col("cosine") >= least_cosine(forest, width))
        asked = open_queries.select(F.col("id").alias("query_id"))
        over = over.join(asked, "query_id", "left_semi").select(
            "query_id", F.lit(width).alias("ended")).checkpoint()
        cost = hits.groupBy("query_id").agg(F.sum("compared").alias("compared"))
        ways = over if ways is None else ways.unionByName(over)
        costs = cost if costs is None else costs.unionByName(cost)
        open_queries = open_queries.join(
            over.select(F.col("query_id").alias("id")), "id", "left_anti").checkpoint()
        if open_queries.isEmpty():
            break
    else:
        # Prefixes of length 0: all vectors, in blocks, for the queries that are left, in parts.
        left = open_queries.where("tree = 0").select("id", "vector")
        blocks = F.lit(math.ceil(most.n / forest.rows_per_block))
        askings = F.lit(math.ceil(left.count() / forest.rows_per_block))
        whole = [F.lit(0).alias("tree"), F.lit(0).cast("bigint").alias("code")]
        everything = own.select("id", "vector").mapInArrow(
            _plain(dtype), f"id {id_type}, vector binary").select(
            "id", "vector", *whole, F.pmod(F.xxhash64("id"), blocks).cast("int").alias("part"),
            _each(askings).alias("asking"))
        asked = left.select("id", "vector", *whole, _part(askings).alias("asking"),
                            _each(blocks).alias("part"))
        hits = everything.groupBy("part", "asking").cogroup(
            asked.groupBy("part", "asking")).applyInPandas(
            _searcher(0, 0, 0, k, dtype), hit).checkpoint()
        best = _merged(hits, k, best)
        ways = ways.unionByName(left.select(F.col("id").alias("query_id"),
                                            F.lit(-1).alias("ended")).distinct())
        costs = costs.unionByName(
            hits.groupBy("query_id").agg(F.sum("compared").alias("compared")))
    costs = costs.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    return best.join(ways, "query_id").join(costs, "query_id").select(
        "query_id", "rank", "vec_id", "score", "ended", "compared")


def _block(bits: int) -> Column:
    return F.shiftright("code", STRING - bits).alias("block")


def _hot(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Into how many parts of about ``size`` rows the blocks go that have more."""
    found = rows.groupBy("tree", "block").agg(F.count("*").alias("n")).where(F.col("n") > size)
    return broadcast_if_small(found.select(
        "tree", "block", F.ceil(F.col("n") / size).cast("int").alias(name)).checkpoint())


def _each(parts: Column | str) -> Column:
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _part(parts: Column | str) -> Column:
    """Which of so many parts a query is dealt to: an id that comes often is spread out."""
    return F.pmod(F.xxhash64("id", "vector"), parts).cast("int")


def _plain(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.columns
            raw = [np.asarray(v.values, dtype=np.float64).astype(dtype).tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary())],
                                             names=["id", "vector"])
    return run


def _merged(hits: DataFrame, k: int, before: DataFrame | None) -> DataFrame:
    """The k best of each query, with those of earlier steps: trees and parts found k each."""
    pairs = hits.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select(
        "query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    if before is not None:
        pairs = pairs.unionByName(before.drop("rank"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
