"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints sorted by their rank in the Gray code have neighbours that agree in most bits.
The sorted list is cut in blocks, and each block is a tree: a node stands for a run of codes and
holds a mask of the bits in which all of them agree and that no node above it holds yet, with
the pattern of these bits. On the way down to a code every bit is held once, so the differences
that a search adds up from node to node are a lower bound for all codes below, and at a code
they are its distance: a whole group goes as soon as they exceed the limit.

Blocks are the uppermost nodes. Two blocks whose patterns differ in too many shared bits never
meet; of any others, one is searched with the other's codes. Links inside a block come first
and name its groups, so that of links between two blocks only those that join groups that
were apart leave the task: the table of links grows with the fingerprints, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from brindle.llm.components import components
from brindle.llm.texts import quoted
from brindle.session import checkpoint_folder

_U = np.uint64
#: Shingles that are hashed before their bits are added up.
SHINGLES = 1 << 15
#: Children of a node.
FAN = 4
#: Codes that search a tree at once.
QUERIES = 128
#: Pairs of code and node that a search holds at once.
FRONTIER = 1 << 21


@dataclass(frozen=True)
class SimHash:
    """What a fingerprint is made of, and how many bits linked ones differ in at most.

    There are at most ``blocks`` blocks. The table of their patterns, which all tasks get, is thus
    bounded; a block has as many codes as it then takes, but ``least`` where there are enough.
    """

    words: int = 4
    seed: int = 42
    differences: int = 4
    blocks: int = 1024
    least: int = 4096


def fingerprint(text: str | None, how: SimHash = SimHash()) -> int:
    """Bits that are set in over half of the shingles' hashes; 0 for a text without words."""
    # of bytes, lower() and split() know A-Z and U+0020, U+0009 to U+000D only
    words = (text or "").encode().lower().split()
    n, total = min(how.words, len(words)), np.zeros(64, dtype=np.int64)
    count = len(words) - n + 1 if words else 0
    digest, seed = xxhash.xxh64_intdigest, how.seed
    for begin in range(0, count, SHINGLES):
        end = min(count, begin + SHINGLES)
        runs = zip(*(words[begin + i:end + i] for i in range(n)))
        hashes = np.fromiter((digest(s, seed) for s in map(b" ".join, runs)), "<u8", end - begin)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > count, bitorder="little")
    return int(bits.view("<u8")[0])


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray code's order, as a signed number that sorts alike."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-2 ** 63))


class Tree:
    """Codes in Gray order under nodes that hold the bits their codes share.

    ``levels[0]`` are the codes; each level has the patterns of its nodes and the masks of the
    bits that they hold, without those that nodes above them hold.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        both, any_ = [codes], [codes]
        while len(both[-1]) > FAN:
            begins = np.arange(0, len(both[-1]), FAN)
            both.append(np.bitwise_and.reduceat(both[-1], begins))
            any_.append(np.bitwise_or.reduceat(any_[-1], begins))
        shared = [~(b ^ a) for b, a in zip(both, any_)]
        self.levels = []
        for level, (pattern, mask) in enumerate(zip(both, shared)):
            if level + 1 < len(shared):
                mask = mask & ~np.repeat(shared[level + 1], FAN)[:len(mask)]
            self.levels.append(tuple(np.pad(x, (0, -len(x) % FAN)).reshape(-1, FAN)
                                     for x in (pattern, mask)))

    def search(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query's and a code's position that differ in ``most`` bits or fewer."""
        for begin in range(0, len(queries), QUERIES):
            own = queries[begin:begin + QUERIES]
            which = np.arange(len(own), dtype=np.int32)
            for q, c in self._below(own, len(self.levels) - 1, which, np.zeros_like(which),
                                    np.zeros(len(own), np.uint8), most):
                yield q + begin, c

    def _below(self, own, level, which, node, apart, most):
        """Children, at ``level``, of nodes to which a query has ``apart`` differences so far."""
        pattern, mask = self.levels[level]
        step = FRONTIER // FAN
        for begin in range(0, len(which), step):
            query, above = which[begin:begin + step], node[begin:begin + step]
            sums = np.bitwise_count((own[query, None] ^ pattern[above]) & mask[above])
            sums += apart[begin:begin + step, None]
            hit = np.flatnonzero(sums <= most)
            at = hit // FAN
            child = above[at] * FAN + (hit % FAN).astype(np.int32)
            if level:
                there = child < len(self.levels[level - 1][0])
            else:
                there = child < len(self.codes)
            hit, at, child = hit[there], at[there], child[there]
            if level:
                yield from self._below(own, level - 1, query[at], child, sums.ravel()[hit], most)
            elif len(at):
                yield query[at], child


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i]; ``root`` names each node's group by its least node."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _blocks(how: SimHash):
    """One row of a partition's codes, the groups of those that are linked inside, and bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column(0)).astype(np.int64).view(_U) for b in batches]
        codes = np.concatenate(parts) if parts else np.empty(0, _U)
        if not len(codes):
            return
        root = np.arange(len(codes), dtype=np.int32)
        for q, c in Tree(codes).search(codes, how.differences):
            unite(root, q, c)
        every = np.array([np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)], _U)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), *(
                pa.array([x.tobytes()], pa.binary()) for x in (codes, root, every))],
            names=["block", "codes", "root", "bits"])
    return run


def _meetings(blocks: np.ndarray, bits: np.ndarray, how: SimHash):
    """From a block's row the blocks, not after it, whose codes may be near its own."""
    both, any_ = bits[:, 0], bits[:, 1]
    shared = ~(both ^ any_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = []
            for block in batch.column(0).to_pylist():
                at = int(np.flatnonzero(blocks == block)[0])
                apart = np.bitwise_count((both ^ both[at]) & shared & shared[at])
                met.append(blocks[(apart <= how.differences) & (blocks < block)].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(met, pa.list_(pa.int32()))], names=["block", "met"])
    return run


def _across(how: SimHash):
    """Links that join groups of a block (its row comes first) and of those that meet it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tree, own = None, None, None
        for batch in batches:
            for at, block, codes, root in zip(*(c.to_pylist() for c in batch.columns)):
                codes, root = np.frombuffer(codes, _U), np.frombuffer(root, np.int32)
                if block is None:
                    index, tree, own = at, Tree(codes), root
                    continue
                if index != at:
                    raise ValueError("a block's own row has to come first")
                # nodes: the groups of both blocks; a link is told when it joins two of them
                joined = np.arange(len(own) + len(root), dtype=np.int32)
                for q, c in tree.search(codes, how.differences):
                    unite(joined, own[c].astype(np.int64), root[q].astype(np.int64) + len(own))
                told = np.flatnonzero(joined != np.arange(len(joined)))
                every = np.concatenate([tree.codes, codes])
                yield _links(every[told], every[joined[told]])
    return run


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                      names=["a", "b"])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each linked code of a block with the first of its group."""
    for batch in batches:
        for codes, root in zip(*(c.to_pylist() for c in batch.columns)):
            codes, root = np.frombuffer(codes, _U), np.frombuffer(root, np.int32)
            told = np.flatnonzero(root != np.arange(len(root)))
            for begin in range(0, len(told), 1 << 16):
                some = told[begin:begin + (1 << 16)]
                yield _links(codes[some], codes[root[some]])


def near_links(codes: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """Rows of ``a`` and ``b`` that connect what the distinct numbers of ``code`` link.

    Not every link is told, but all that are near each other are connected, and none else.
    """
    wanted = max(1, min(how.blocks, -(-codes.count() // how.least)))
    ranged = (codes.withColumn("rank", gray_rank(F.col("code")))
              .repartitionByRange(wanted, "rank").sortWithinPartitions("rank").select("code"))
    # written once: a block's number is that of the task that made it
    blocks = ranged.mapInArrow(
        _blocks(how), "block int, codes binary, root binary, bits binary").checkpoint()
    # at most `how.blocks` rows of 20 bytes
    top = blocks.select("block", "bits").orderBy("block").collect()
    numbers = np.array([r["block"] for r in top], dtype=np.int32)
    bits = np.frombuffer(b"".join(r["bits"] for r in top), _U).reshape(-1, 2)
    meets = blocks.select("block").mapInArrow(
        _meetings(numbers, bits, how), "block int, met array<int>")
    searching = (meets.select("block", F.explode("met").alias("at"))
                 .join(blocks.select("block", "codes", "root"), "block")
                 .select("at", "block", "codes", "root"))
    own = blocks.select(F.col("block").alias("at"), F.lit(None).cast("int").alias("block"),
                        "codes", "root")
    met = own.unionByName(searching).repartition("at").sortWithinPartitions(
        "at", F.col("block").asc_nulls_first())
    return blocks.select("codes", "root").mapInArrow(_inside, "a long, b long").unionByName(
        met.mapInArrow(_across(how), "a long, b long"))


def _fingerprinted(how: SimHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), how) for t in batch.column(1)], _U)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["id", "code"])
    return run


def simhash_join(df: DataFrame, doc_id: str, text: str, how: SimHash = SimHash()) -> DataFrame:
    """Each row's ``doc_id``, its ``fingerprint`` and the least id it is connected with.

    Texts are lower-cased in A-Z, and words are what stands between U+0020 and U+0009 to U+000D.
    A text of fewer words than a shingle is one shingle; a null text and one without words have
    fingerprint zero, which is linked like any other. Two rows are linked if their fingerprints
    differ in ``how.differences`` bits or fewer; ``component_id`` is the least id that links
    lead to, the row's own included, and null where all ids there are null. Repeated rows and
    ids are linked like others; further columns are left out; an empty table gives no rows.

    Rows of the same fingerprint are one code, by a minimum in the map tasks.
    """
    checkpoint_folder(df.sparkSession)
    id_field = df.select(F.col(quoted(doc_id)).alias("id")).schema["id"]
    found = df.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text))).mapInArrow(
        _fingerprinted(how),
        StructType([id_field, *_parse_datatype_string("code long").fields])).checkpoint()
    codes = found.groupBy("code").agg(F.min("id").alias("least")).checkpoint()
    reached = components(near_links(codes.select("code"), how)).select(
        F.col("node").alias("code"), "component")
    placed = codes.join(reached, "code", "left").withColumn(
        "component", F.coalesce("component", "code"))
    firsts = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    done = placed.join(firsts, "component").select("code", "component_id")
    return found.join(done, "code").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        "component_id")
