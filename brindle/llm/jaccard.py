"""Near-duplicate join on word n-grams: chosen paths, then exact Jaccard similarity.

A document is its set of n-grams (shingles). Documents with equal sets are one
class. A class has a signature of min-hashes, its tokens: two classes share about as
many of them as their sets are similar. In each run, classes are split recursively: at
a node a class follows those of its tokens whose hash, which depends on run and
path, is small, so it goes to a few children, and similar classes go to the same ones.
A node that holds few classes is a bucket: all pairs in it are compared. Runs are
repeated until a pair at the threshold is found with the wanted probability.

In a bucket, signatures are compared first, and classes that look alike stand together as
a group. Groups of the same classes, found over and over by the runs, are one. Only for
groups are texts fetched, and their sets compared, one range of hashes after another. A pair
that meets in several groups is counted in the first of them: each class knows its groups. So
no pair is ever written out: a group gives the number of links of each of its classes, and who
is connected.

Splitting does not take apart many texts that are nearly the same. These are families: by the
triangle inequality, all that is within half the linked distance of a pivot is linked with
each other, without a comparison.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from brindle.llm.components import components
from brindle.llm.texts import lean, least_hashed, quoted
from brindle.operators.ordered import broadcast_if_small, written
from brindle.session import checkpoint_folder

_U = np.uint64
_KNOWN_WORDS = 50_000
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 1024
#: Min-hashes of a band and bands of a signature, by which families are looked for; classes of a
#: band that are looked at for pivots, pivots of a band, members that a pivot's text comes to.
BAND, BANDS, SAMPLE, PIVOTS, SALT = 4, 4, 64, 8, 4096


@dataclass(frozen=True)
class Join:
    """What is linked, and how it is found.

    ``recall`` is the probability with which a pair of just the threshold's similarity is to
    be found; ``bucket`` is how many classes are compared at once; ``depth`` how long a path
    may get before a larger bucket is compared in parts; ``slice_bytes`` how much of the sets
    of a group a task holds; ``family`` how many classes share a band where families are
    looked for; ``dense`` how many classes that hardly can be split are compared at once.
    """

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.99
    tokens: int = 64
    bucket: int = 400
    depth: int = 8
    slice_bytes: int = 1 << 22
    family: int = 400
    dense: int = 2048

    @property
    def chosen(self) -> float:
        """Share of its tokens that a class follows: similar ones share one on average."""
        return 1 / (self.similarity * self.tokens)

    @property
    def runs(self) -> int:
        """Runs until ``recall`` where all buckets are reached in three steps."""
        return self.runs_to(3)

    def runs_to(self, depth: int) -> int:
        """Runs until ``recall`` for pairs that are met at a path of ``depth`` steps.

        A pair shares at each step a Poisson number of children. Its mean is 1 for a pair at the
        threshold whose signatures share as many tokens as is expected; how many they do
        share is binomial, and the same in all runs.
        """
        n, s = self.tokens, self.similarity
        weights = [math.comb(n, k) * s ** k * (1 - s) ** (n - k) for k in range(n + 1)]
        ends = [0.0] * (n + 1)
        for _ in range(depth):
            ends = [math.exp(k * self.chosen * (e - 1)) for k, e in enumerate(ends)]
        runs = 1
        while sum(w * e ** runs for w, e in zip(weights, ends)) > 1 - self.recall:
            runs += 1
            if runs > 1000:
                raise ValueError("too few tokens for the wanted recall")
        return runs

    @property
    def alike(self) -> int:
        """Tokens that two signatures share at least, if their sets are similar: 4 deviations."""
        s = self.similarity
        return max(1, math.floor(self.tokens * s - 4 * math.sqrt(self.tokens * s * (1 - s))))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KNOWN_WORDS:
            self[word] = found
        return found


_word_hashes = _WordHashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the runs of ``n`` lower-case words; of all words, if there are fewer."""
    words = (text or "").lower().split()
    h = np.fromiter(map(_word_hashes.__getitem__, words), _U, len(words))
    n = min(n, len(words))
    if not n:
        return h
    total = np.full(len(h) - n + 1, n, dtype=_U)
    for i in range(n):
        total = total * _U(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i]
    return np.unique(mixed(total))


def class_key(found: np.ndarray) -> bytes | None:
    """128 bits of a set; None for the empty one."""
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


@functools.cache
def _multipliers(tokens: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2 ** 63, tokens, dtype=_U) * _U(2) + _U(1)


def signature(found: np.ndarray, tokens: int) -> np.ndarray:
    """Min-hashes of a set, 32 bits each."""
    factors, least = _multipliers(tokens), np.full(tokens, 2 ** 32 - 1, dtype=np.uint32)
    for begin in range(0, len(found), 4096):
        products = found[begin:begin + 4096, None] * factors
        least = np.minimum(least, (products >> _U(32)).astype(np.uint32).min(axis=0))
    return least


def _named(signatures: np.ndarray) -> np.ndarray:
    """Min-hashes with their places, as tokens."""
    places = np.arange(signatures.shape[1], dtype=_U) << _U(32)
    return mixed(signatures.astype(_U) | places)


def _sets(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, signatures, sizes = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), join.words)
                keys.append(class_key(found))
                sizes.append(len(found))
                signatures.append(signature(found, join.tokens).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()),
                 pa.array(sizes, pa.int64())], names=["id", "class", "signature", "size"])
    return run


def _keyed(join: Join):
    """Rows of id and text with the class of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [class_key(shingles(text.as_py(), join.words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())],
                                             names=["id", "text", "class"])
    return run


def _children(join: Join):
    """From (class, family, signature, path, held) the paths of the children that the class follows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = _U(int(join.chosen * 2 ** 64))
        for batch in batches:
            classes, families, signatures, paths, held = batch.columns
            tokens = _named(np.frombuffer(b"".join(signatures.to_pylist()), np.uint32)
                            .reshape(len(classes), -1))
            at = np.asarray(paths).astype(np.int64).view(_U)
            steps = mixed(tokens ^ at[:, None])
            row, which = np.nonzero(steps < limit)
            # the child is named by path and token, not by the hash that chose it
            child = mixed(at[row] * _U(0xD1342543DE82EF95) + tokens[row, which])
            yield pa.RecordBatch.from_arrays(
                [classes.take(pa.array(row)), families.take(pa.array(row)),
                 pa.array(child.view(np.int64)), held.take(pa.array(row))],
                names=["class", "family", "path", "held"])
    return run


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one: of a batch with large values few stand beside each other as objects."""
    for batch in batches:
        for begin in range(0, len(batch), 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(begin, 64).columns))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of rows with the same first column."""
    at, rows = None, []
    for batch in batches:
        for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at and rows:
                yield at, rows
                rows = []
            at = key
            rows.append(tuple(rest))
    if rows:
        yield at, rows


def _roots(n: int, links: np.ndarray) -> np.ndarray:
    """The least node connected with each of n nodes; links is a symmetric matrix."""
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(links[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def _look_alike(join: Join):
    """Groups of classes of a bucket whose signatures are alike, directly or by others.

    Links inside a family are known: only others make a group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, classes = [], []
        for path, rows in _grouped(batches):
            rows = sorted(set(rows), key=lambda row: row[0])
            s = np.frombuffer(b"".join(r[1] for r in rows), np.uint32).reshape(len(rows), -1)
            alike = np.stack([np.count_nonzero(s == own, axis=1) >= join.alike for own in s])
            alike &= ~_same_family([r[2] for r in rows])
            root = _roots(len(rows), alike)
            for i in np.flatnonzero(alike.any(axis=1)):
                groups.append(xxhash.xxh3_64_intdigest(
                    rows[root[i]][0] + path.to_bytes(8, "little", signed=True)) - 2 ** 63)
                classes.append(rows[i][0])
            if len(groups) > 10_000:
                yield _pairs(groups, classes)
                groups, classes = [], []
        yield _pairs(groups, classes)
    return run


def _same_family(families: list[bytes | None]) -> np.ndarray:
    """Which of these are of one family; each is with itself."""
    numbers = {}
    own = np.array([-1 - i if f is None else numbers.setdefault(f, len(numbers))
                    for i, f in enumerate(families)])
    return own[:, None] == own


def _pairs(groups: list[int], classes: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(classes, pa.binary())],
                                      names=["group", "class"])


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share; on the diagonal the sets' sizes."""
    sizes = np.array([len(s) for s in sets])
    found = np.diag(sizes).astype(np.int32)
    tokens, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # what only one set has is shared with none
    column = np.cumsum(held > 1) - 1
    often = held[place] > 1
    row, column = row[often], column[place[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        some = slice(*np.searchsorted(column, [begin, begin + COLUMNS]))
        matrix = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        matrix[row[some], column[some] - begin] = 1
        product = (matrix @ matrix.T).astype(np.int32)
        np.fill_diagonal(product, 0)
        found += product
    return found


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets have a Jaccard similarity of ``least`` or more, as a symmetric matrix."""
    return _similar(shared(sets), least)


def _similar(found: np.ndarray, least: float) -> np.ndarray:
    sizes = np.diag(found)
    near = np.stack([own >= least * (size + sizes - own) - 1e-9 for size, own in zip(sizes, found)])
    np.fill_diagonal(near, False)
    return near


def _sliced(join: Join):
    """Each class's set for each of its groups, in as many slices as the group is cut in.

    Slices are ranges of the hashes, so a slice of one set meets the same slice of another.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, family, copies, own, text in _rows_of([batch]):
                found, groups = shingles(text, join.words), [g["group"] for g in own]
                for g in own:
                    # 2 ** 64 / slices, rounded up
                    width = -(-2 ** 64 // g["slices"])
                    cuts = np.searchsorted(found, np.array(
                        [i * width for i in range(1, g["slices"])], dtype=_U))
                    parts = [p.tobytes() for p in np.split(found, cuts)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([g["group"]] * len(parts), pa.int64()),
                        pa.array(range(len(parts)), pa.int32()),
                        pa.array([key] * len(parts), pa.binary()),
                        pa.array([family] * len(parts), pa.binary()),
                        pa.array([copies] * len(parts), pa.int64()),
                        pa.array([groups] * len(parts), pa.list_(pa.int64())),
                        pa.array(parts, pa.binary())],
                        names=["group", "slice", "class", "family", "copies", "groups", "part"])
    return run


def _linked(join: Join):
    """Links of each class of a group that are counted here, and whom it is connected with.

    One slice of the group's sets is held at a time, and what each two share is added up.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, slices in itertools.groupby(_rows_of(batches), lambda row: row[0]):
            members, keys, total = {}, [], 0
            for _, rows in itertools.groupby(slices, lambda row: row[1]):
                parts = {}
                for group, _, key, family, copies, groups, part in rows:
                    members[key] = copies, groups, family
                    parts[key] = np.frombuffer(part, _U)
                keys = sorted(members)
                total = total + shared([parts[k] for k in keys])
            if len(keys) > 1:
                out += _counted(group, keys, members, _similar(total, join.similarity))
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    def _counted(group: int, keys: list[bytes], members: dict, near: np.ndarray) -> Iterator[tuple]:
        root = _roots(len(keys), near)
        copies = np.array([members[k][0] for k in keys])
        # pairs that have met in an earlier group are counted there
        earlier = {g: at for at, g in enumerate(
            {g for k in keys for g in members[k][1] if g < group})}
        held = np.zeros((len(keys), len(earlier)), dtype=np.float32)
        for i, key in enumerate(keys):
            held[i, [earlier[g] for g in members[key][1] if g < group]] = 1
        # and those of a family with it
        same = _same_family([members[k][2] for k in keys])
        links = (near & ~same & (held @ held.T == 0)) @ copies
        for i in np.flatnonzero(near.any(axis=1)):
            yield keys[i], int(links[i]), keys[root[i]]

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.binary()))],
            names=["class", "links", "root"])
    return run


def _buckets(classes: DataFrame, join: Join) -> DataFrame:
    """Rows of path and class: the buckets of all runs that hold two classes or more.

    The longer a path, the less likely a pair has followed all of it: there are as many runs
    as the depth that was really reached asks for.
    """
    slim, n = classes.select("class", "family", "signature"), classes.count()
    found, done, reached = None, 0, 3
    while done < (wanted := join.runs_to(reached)):
        more, depth = _split(slim, n, range(done + 1, wanted + 1), join)
        found = more if found is None else found.unionByName(more)
        done, reached = wanted, max(reached, depth)
    return found


def _split(slim: DataFrame, n: int, runs: range, join: Join) -> tuple[DataFrame, int]:
    """The buckets of these runs, and the steps of the longest path among them.

    Two classes below the threshold share less than one child on average, so what only common
    wording holds together falls apart along the path. What is alike does so slowly, over paths
    that take many runs: a node of ``dense`` classes or fewer that has kept half of its parent's
    is a bucket. Families stay together: a large node in which few are of another family than
    most is finished where it is met.
    """
    roots = mixed(np.array(runs, dtype=_U)).view(np.int64).tolist()
    nodes = (slim.withColumn("path", F.explode(F.array(*[F.lit(r) for r in roots])))
             .withColumn("held", F.lit(n).cast("bigint")))
    found = None
    for depth in range(1, join.depth + 1):
        # a class follows each path once; hot paths are summed up in the map tasks
        records = nodes.mapInArrow(
            lean(_children(join)), "class binary, family binary, path long, held long").checkpoint()
        held = (records.groupBy("path", "family").agg(F.count("*").alias("n")).groupBy("path")
                .agg(F.sum("n").alias("n"),
                     F.max(F.when(F.col("family").isNotNull(), F.struct("n", "family")))
                     .alias("most")).where("n > 1")
                .select("path", "n", F.coalesce("most.n", F.lit(0)).alias("kin"), "most.family"))
        held = held.withColumnRenamed("family", "main")
        records = records.join(held, "path").checkpoint()
        whole = (F.col("n") <= join.bucket) | (
            (F.col("n") <= join.dense) & (2 * F.col("n") >= F.col("held")))
        small = records.where(whole).select("path", "class")
        found = small if found is None else found.unionByName(small)
        large = records.where(~whole)
        if large.isEmpty():
            return found, depth
        kept = F.col("n") - F.col("kin") <= join.bucket
        found = found.unionByName(_beside_family(large.where(kept), join))
        rest = large.where(~kept)
        if depth == join.depth:
            found = found.unionByName(_in_parts(rest, join))
        if depth == join.depth or rest.isEmpty():
            return found, depth
        nodes = rest.select("class", "path", F.col("n").alias("held")).join(slim, "class").select(
            "class", "family", "signature", "path", "held")


def _beside_family(large: DataFrame, join: Join) -> DataFrame:
    """Buckets of a family's parts, each with all classes of the node that are not of it."""
    parts = F.ceil(F.col("kin") / join.bucket)
    of_it = F.col("family").eqNullSafe(F.col("main"))
    part = F.when(of_it, F.array(F.pmod(F.xxhash64("class"), parts))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), parts - 1))
    return (large.where(F.col("n") > F.col("kin")).select(
        "path", "class", F.explode(part).alias("part"))
        .select(F.xxhash64("path", "part").alias("path"), "class"))


def _in_parts(large: DataFrame, join: Join) -> DataFrame:
    """Buckets that stay large: cut in parts, and each two parts are a bucket."""
    parts = F.ceil(2 * F.col("n") / join.dense)
    part = F.pmod(F.xxhash64("class"), parts)
    return (large.select("path", "class", part.alias("own"), parts.alias("parts"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                      F.col("parts") - 1)))
            .select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
                    .alias("path"), "class"))


# ---- families ----

def _bands(join: Join):
    """From (class, signature) keys that classes of a family are likely to share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, signatures = batch.columns
            s = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(len(classes), -1)
            width = join.tokens // BANDS
            keys = np.zeros((len(classes), BANDS), dtype=_U)
            for band in range(BANDS):
                keys[:, band] = band
                for token in _named(s)[:, band * width:band * width + BAND].T:
                    keys[:, band] = mixed(keys[:, band] * _U(0x9E3779B97F4A7C15) + token)
            rows = np.repeat(np.arange(len(classes)), BANDS)
            yield pa.RecordBatch.from_arrays(
                [classes.take(pa.array(rows)), pa.array(keys.ravel().view(np.int64))],
                names=["class", "key"])
    return run


def _pivots(join: Join):
    """From a sample of a key's classes those beside which most of it stand close."""
    close = math.floor(join.tokens * (1 + join.similarity) / 2)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("class")
        s = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(len(rows), -1)
        near = (s[:, None] == s).sum(axis=2) >= close
        left, chosen = np.ones(len(s), dtype=bool), []
        while len(chosen) < PIVOTS and (covers := (near & left).sum(axis=1)).max() > 1:
            chosen.append(int(covers.argmax()))
            left &= ~near[chosen[-1]]
        return rows.take(pa.array(chosen, pa.int64())).select(["key", "class", "signature"])
    return run


def _nearest(join: Join):
    """From (class, signature, pivots, their signatures) the pivot that looks nearest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, pivots = [], []
            for i, (_, own, names, theirs) in enumerate(_rows_of([batch])):
                own = np.frombuffer(own, np.uint32)
                alike = [int((own == np.frombuffer(t, np.uint32)).sum()) for t in theirs]
                best = max(range(len(names)), key=lambda j: (alike[j], names[j]))
                if alike[best] >= join.alike:
                    kept.append(i)
                    pivots.append(names[best])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(pivots, pa.binary())],
                names=["class", "pivot"])
    return run


def _kin(join: Join):
    """From (class, text, pivot, its text) those within half the linked distance of the pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, around = None, None
        for batch in batches:
            classes, pivots = [], []
            for key, text, other, other_text in _rows_of([batch]):
                if other != pivot:
                    pivot, around = other, shingles(other_text, join.words)
                found = shingles(text, join.words)
                both = len(np.intersect1d(found, around, assume_unique=True))
                if both >= (1 + join.similarity) / 2 * (len(found) + len(around) - both) + 1e-9:
                    classes.append(key)
                    pivots.append(other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array(pivots, pa.binary())],
                names=["class", "family"])
    return run


def _families(classes: DataFrame, own: DataFrame, join: Join) -> DataFrame:
    """Rows of class and family, for classes that stand close around a pivot with many others.

    The Jaccard distance is a metric: what is within half of the linked distance of the same
    class is linked with each other. Pivots come from samples of the classes that share many
    min-hashes; who belongs to one is decided on whole texts.
    """
    slim = classes.select("class", "signature")
    keyed = slim.mapInArrow(lean(_bands(join)), "class binary, key long")
    dense = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > join.family)
    dense = dense.checkpoint()
    if dense.isEmpty():
        return written(classes.select("class", F.col("class").alias("family")).limit(0))
    at = (keyed.join(broadcast_if_small(dense), "key").groupBy("class")
          .agg(F.max(F.struct("n", "key")).alias("at")).select("class", F.col("at.key").alias("key")))
    dense_classes = slim.join(broadcast_if_small(written(at)), "class").checkpoint()
    some = least_hashed(dense_classes, "key", "class", SAMPLE)
    pivots = some.groupBy("key").applyInArrow(
        _pivots(join), "key long, class binary, signature binary")
    around = pivots.groupBy("key").agg(
        F.collect_list("class").alias("names"), F.collect_list("signature").alias("theirs"))
    likely = dense_classes.join(around, "key").select("class", "signature", "names", "theirs").mapInArrow(
        lean(_nearest(join)), "class binary, pivot binary").checkpoint()
    named = written(likely.select("class").unionByName(
        likely.select(F.col("pivot").alias("class"))).distinct())
    texts = _texts(own, classes.join(broadcast_if_small(named), "class", "left_semi").select(
        "class", F.col("least").alias("id")), join).checkpoint()
    # a pivot's text goes to as many groups as its family takes
    sizes = likely.groupBy("pivot").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    members = (likely.join(sizes, "pivot").join(texts.select("class", "text"), "class")
               .withColumn("salt", F.pmod(F.xxhash64("class"), "salts")).drop("salts"))
    central = (sizes.join(texts.select(F.col("class").alias("pivot"), F.col("text").alias("around")),
                          "pivot")
               .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                        F.col("salts") - 1))).drop("salts"))
    return members.join(central, ["pivot", "salt"]).select("class", "text", "pivot", "around").mapInArrow(
        lean(_kin(join)), "class binary, family binary").checkpoint()


def _texts(own: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """One text for each ``class`` of ``wanted``, which stands in a row of its ``id``.

    Rows that repeat an id have the same text, or one of another class.
    """
    # few as a rule: then texts that aren't wanted stay where they are
    ids = broadcast_if_small(written(wanted.select(F.col("id").alias("id_")).distinct()))
    fields = [own.schema["id"], *_parse_datatype_string("text string, class binary").fields]
    known = (own.join(ids, F.col("id").eqNullSafe(F.col("id_")), "left_semi").select("id", "text")
             .mapInArrow(lean(_keyed(join)), StructType(fields)).where(F.col("class").isNotNull())
             .groupBy("id", "class").agg(F.min("text").alias("text")))
    named = wanted.select(F.col("id").alias("id_"), F.col("class").alias("class_"))
    return known.join(named, (F.col("class") == F.col("class_"))
                      & F.col("id").eqNullSafe(F.col("id_"))).select("class", "text")


def _groups(buckets: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Rows of group and class, each group of the same classes once."""
    met = (buckets.join(classes.select("class", "signature", "family"), "class")
           .select("path", "class", "signature", "family")
           .repartition("path").sortWithinPartitions("path"))
    alike = met.mapInArrow(lean(_look_alike(join)), "group long, class binary").distinct().checkpoint()
    same = alike.groupBy("group").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("h"),
        F.sum(F.shiftright(F.xxhash64(F.lit(1), "class"), 24)).alias("s"))
    kept = same.groupBy("n", "h", "s").agg(F.min("group").alias("group")).select("group")
    return alike.join(kept, "group", "left_semi").checkpoint()


def jaccard_join(df: DataFrame, doc_id: str, text: str, join: Join = Join()) -> DataFrame:
    """Each row's ``doc_id``, ``class_id`` and ``n_links``.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is at
    least the threshold; ``n_links`` counts a document's links, copies included, and
    ``class_id`` is the least id among the documents that links connect it with. Words are
    what stands between white space, in lower case; a text of fewer words than an n-gram
    is one n-gram. Pairs are found with the wanted recall or better; those found are
    compared exactly, on whole texts.

    A null text and one without words is linked with nothing and is its own class. Rows
    that repeat an id are linked if their texts are, and so are rows without an id; ``class_id``
    is null where no row of a class has one. An empty table gives no rows.

    Copies are reduced to one class by a sum in the map tasks. Whatever is shared by many
    documents is a hot path, which is only counted, and is split further until it is small.
    Families, in which many texts stand close around one, are known before: their links follow
    from their size, and only what else is near one of them is compared with it. Texts are moved
    once to be met by the ids of classes that look alike; their sets are moved once for each
    group, in slices, of which a task holds one of each class.
    """
    checkpoint_folder(df.sparkSession)
    own = df.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text"))
    id_field = own.schema["id"]
    sets = own.mapInArrow(lean(_sets(join)), StructType(
        [id_field, *_parse_datatype_string("class binary, signature binary, size long").fields])).checkpoint()
    classes = (sets.where(F.col("class").isNotNull()).groupBy("class")
               .agg(F.min("id").alias("least"), F.count("*").alias("copies"),
                    F.min("signature").alias("signature"), F.min("size").alias("size"))
               .checkpoint())

    families = _families(classes, own, join)
    classes = classes.join(broadcast_if_small(families), "class", "left").checkpoint()
    groups = _groups(_buckets(classes, join), classes, join)
    # a group's sets come in so many slices that one slice of all fits in a task
    bytes_ = groups.join(classes.select("class", "size"), "class").groupBy("group").agg(
        F.ceil(8 * F.sum("size") / join.slice_bytes).cast("int").alias("slices"))
    # a class is in a few groups of each run at most
    member = groups.join(bytes_, "group").groupBy("class").agg(
        F.collect_set(F.struct("group", "slices")).alias("groups"))
    wanted = member.join(classes.select("class", "family", "least", "copies"), "class").checkpoint()
    texts = _texts(own, wanted.select("class", F.col("least").alias("id")), join)
    slices = texts.join(wanted, "class").select("class", "family", "copies", "groups", "text").mapInArrow(
        lean(_sliced(join)), "group long, slice int, class binary, family binary, copies long, "
                       "groups array<long>, part binary")
    links = (slices.repartition("group").sortWithinPartitions("group", "slice")
             .mapInArrow(lean(_linked(join)), "class binary, links long, root binary").checkpoint())

    near = links.groupBy("class").agg(F.sum("links").alias("links"))
    kin = classes.where(F.col("family").isNotNull())
    edges = links.select(F.col("class").alias("a"), F.col("root").alias("b")).unionByName(
        kin.select(F.col("class").alias("a"), F.col("family").alias("b")))
    reached = components(edges).select(F.col("node").alias("class"), "component")
    weights = kin.groupBy("family").agg(F.sum("copies").alias("weight"))
    near = (kin.join(weights, "family").select(
        "class", (F.col("weight") - F.col("copies")).alias("links"))
        .unionByName(near).groupBy("class").agg(F.sum("links").alias("links")))
    placed = (classes.select("class", "least", "copies").join(near, "class", "left")
              .join(reached, "class", "left")
              .withColumn("component", F.coalesce("component", "class")))
    firsts = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    done = placed.join(firsts, "component").select(
        "class", "class_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).checkpoint()
    return sets.select("id", "class").join(done, "class", "left").select(
        F.col("id").alias(doc_id),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
