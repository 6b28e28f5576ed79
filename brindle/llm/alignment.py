"""Alignment of two tokenizers by products of sparse incidence matrices.

Each tokenizer gives a matrix with a row for each of its tokens and a column for each byte of
the texts, A and B. The row products of A and B transposed (Gustavson: a row of the result is the
sum of the rows of the second matrix that the first one's row names) tell which tokens
overlap, by how many bytes. Two neighbours that overlap with no common token are cut apart
there: both tokenizers end a token at that byte. What lies between two cuts is a group.
Matrices of groups and the ids in them, how often each, give by another such product how often
a pair of ids is linked by standing in the same group.

Texts are aligned many at a time, as one matrix over all their bytes. A bundle of texts names its
different pairs of ids once. Only these go to be counted, and only their counts come back.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from brindle.llm.texts import quoted
from brindle.session import checkpoint_folder

#: Bytes of text that are aligned as one matrix, pairs of ids that end a bundle, and texts in one.
TOGETHER, BUNDLE, TEXTS = 1 << 20, 1 << 20, 1 << 14
#: Blanks in a row that are too many for ``tiktoken``.
RUN = 4096
_RUN = re.compile(rf"\s{{{RUN}}}")
#: Entries of a product that are held before they are added up.
ENTRIES = 1 << 22


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: row i has the columns ``at[begin[i]:begin[i + 1]]``."""

    begin: np.ndarray
    at: np.ndarray
    value: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, value: np.ndarray, height: int,
           width: int) -> Csr:
        """From entries in any order; those of the same place are added up."""
        key = rows.astype(np.int64) * width + columns
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, rows, columns, value = key[order], rows[order], columns[order], value[order]
        again = key[1:] == key[:-1]
        if again.any():
            starts = np.flatnonzero(np.concatenate([[True], ~again]))
            value = np.add.reduceat(value, starts)
            rows, columns = rows[starts], columns[starts]
        begin = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=height))])
        return cls(begin, columns, value, width)

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Csr:
        """Tokens by bytes, where tokens of these lengths stand one after another."""
        begin = np.concatenate([[0], np.cumsum(lengths)])
        size = int(begin[-1])
        return cls(begin, np.arange(size), np.ones(size, dtype=np.int64), size)

    def transposed(self) -> Csr:
        return Csr.of(self.at, self.rows, self.value, self.width, len(self.begin) - 1)

    def times(self, other: Csr, entries: int = ENTRIES) -> Csr:
        """The product, some rows at a time: each entry names a row of ``other``."""
        size = np.diff(other.begin)[self.at]
        upto = np.concatenate([[0], np.cumsum(size)])
        row_upto = upto[self.begin]
        parts, row, height = [], 0, len(self.begin) - 1
        while row < height:
            end = max(row + 1, int(np.searchsorted(row_upto, row_upto[row] + entries, "right")) - 1)
            some = slice(self.begin[row], self.begin[end])
            n = size[some]
            # the entries of the named rows, one after another
            inner = np.arange(int(n.sum())) - np.repeat(upto[some] - upto[some.start], n)
            which = np.repeat(other.begin[self.at[some]], n) + inner
            rows = np.repeat(np.repeat(np.arange(end - row), np.diff(self.begin[row:end + 1])), n)
            parts.append(Csr.of(rows, other.at[which],
                                np.repeat(self.value[some], n) * other.value[which],
                                end - row, other.width))
            row = end
        if len(parts) == 1:
            return parts[0]
        sizes = np.concatenate([[0], *(np.diff(p.begin) for p in parts)])
        return Csr(np.cumsum(sizes), *(
            np.concatenate([np.empty(0, np.int64), *(getattr(p, name) for p in parts)])
            for name in ("at", "value")), other.width)


def groups(overlap: Csr) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row's and of each column's token, from what they overlap.

    Tokens of both sides stand in order and cover the same bytes.
    """
    first, last = overlap.at[overlap.begin[:-1]], overlap.at[overlap.begin[1:] - 1]
    own = np.concatenate([[0], np.cumsum(first[1:] != last[:-1])]) if len(first) else first
    other = np.empty(overlap.width, dtype=np.int64)
    other[overlap.at] = own[overlap.rows]
    return own, other


def align(a: np.ndarray, b: np.ndarray) -> tuple[Csr, np.ndarray, np.ndarray]:
    """Overlaps in bytes of tokens of these lengths, and both sides' groups."""
    overlap = Csr.of_lengths(a).times(Csr.of_lengths(b).transposed())
    return overlap, *groups(overlap)


def grouped_ids(group: np.ndarray, ids: np.ndarray, n_groups: int, n_ids: int) -> Csr:
    """Groups by ids: how often an id stands in a group."""
    return Csr.of(group, ids, np.ones(len(ids), dtype=np.int64), n_groups, n_ids)


# ---- the tokenizers ----

def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts and the bytes of an id."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.lengths = np.array([len(s) for s in spelled], dtype=np.int64)

    def text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


class ByteSide(Side):
    """A byte-level vocabulary in a file of the ``tokenizers`` library.

    Where ids are in the order of the merges, they are ranks, and ``tiktoken`` gives the same ids
    in a fifth of the time.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        special = {t["id"]: t["content"] for t in told["added_tokens"]}
        meant, known = byte_level(), told["model"]["vocab"]
        spelled = [b""] * (max([*known.values(), *special]) + 1)
        for token, i in known.items():
            spelled[i] = bytes(map(meant.__getitem__, token)) if i not in special else b""
        for i, token in special.items():
            spelled[i] = token.encode()
        super().__init__(spelled)
        self._ranks = self._ranked(told, special)
        self._merges = functools.cache(lambda: self._merged(path))

    def _ranked(self, told: dict, special: dict) -> tiktoken.Encoding | None:
        model, meant = told["model"], told["pre_tokenizer"]
        plain = (told["normalizer"] is None and meant["type"] == "ByteLevel"
                 and meant["use_regex"] and not meant["add_prefix_space"]
                 and not model.get("ignore_merges") and not model.get("dropout"))
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"].get(token) for token in made]
        if not plain or ids != list(range(256, 256 + len(made))):
            return None
        ranks = {s: i for i, s in enumerate(self.spelled) if i not in special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _merged(path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def _one(self, text: str) -> list[int]:
        # the pattern's look-ahead takes stack for each blank of a run
        if self._ranks is None or (len(text) >= RUN and _RUN.search(text)):
            return self._merges().encode(text, add_special_tokens=False).ids
        return self._ranks.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(map(self._one, texts))


class PieceSide(Side):
    """A piece vocabulary of the ``sentencepiece`` library."""

    def __init__(self, path: str):
        import sentencepiece

        self._pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__([
            bytes([int(piece[3:-1], 16)]) if self._pieces.IsByte(i)
            else piece.replace("▁", " ").encode()
            for i in range(len(self._pieces)) for piece in [self._pieces.IdToPiece(i)]])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._pieces.encode(texts, num_threads=1)


@functools.cache
def _sides(a: str, b: str) -> tuple[Side, Side]:
    return ByteSide(a), PieceSide(b)


@dataclass
class Aligned:
    """Tokens of some texts and their alignment; ``doc`` is the text's number."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    spelled: list[str]
    #: pairs of ids (A's in the upper half) with their text and number of links, by text and pair
    pair: np.ndarray
    doc: np.ndarray
    links: np.ndarray


def align_texts(texts: list[str | None], a: Side, b: Side) -> Aligned:
    """Both sides' tokens of each text, aligned; texts that a side doesn't give back have none."""
    n = len(texts)
    wanted = [i for i, t in enumerate(texts) if t]
    both = [(i, x, y) for i, x, y in zip(
        wanted, a.encode([" " + texts[i] for i in wanted]), b.encode([texts[i] for i in wanted]))
        if a.text(x) == b.text(y) == b" " + texts[i].encode()]
    kept = np.array([i for i, _, _ in both], dtype=np.int64)
    counts = [np.zeros(n, dtype=np.int64) for _ in range(4)]
    for at, side in ((0, 1), (1, 2)):
        counts[at][kept] = [len(t[side]) for t in both]
    ids_a, ids_b = (np.fromiter(chain.from_iterable(t[side] for t in both), np.int64,
                                counts[side - 1].sum()) for side in (1, 2))
    # each text ends a token of both sides, so groups never reach over two texts
    _, group_a, group_b = align(a.lengths[ids_a], b.lengths[ids_b])
    doc_a, doc_b = (np.repeat(np.arange(n), c) for c in counts[:2])
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    group_doc = np.zeros(n_groups, dtype=np.int64)
    group_doc[group_a] = doc_a
    counts[2] = np.bincount(group_doc, minlength=n)
    links = (np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups))
    np.add.at(counts[3], group_doc, links)
    return Aligned(*counts, _spelled(a, b, ids_a, ids_b, group_a, group_b, doc_a, doc_b, n),
                   *_pairs(a, b, ids_a, ids_b, group_a, group_b, group_doc, n))


def _pairs(a: Side, b: Side, ids_a, ids_b, group_a, group_b, group_doc, n: int):
    """Pairs of ids linked in a text, with the text and how often."""
    n_groups, width_a, width_b = len(group_doc), len(a.spelled), len(b.spelled)
    by_a = grouped_ids(group_a, ids_a, n_groups, width_a)
    by_b = grouped_ids(group_b, ids_b, n_groups, width_b)
    # rows are an id of A in a text: the groups in which it stands there
    own = group_doc[by_a.rows] * width_a + by_a.at
    names, row = np.unique(own, return_inverse=True)
    shared = Csr.of(row, by_a.rows, by_a.value, len(names), n_groups).times(by_b)
    which = names[shared.rows]
    doc, pair = which // width_a, (which % width_a) << 32 | shared.at
    return pair, doc, shared.value


def _spelled(a: Side, b: Side, ids_a, ids_b, group_a, group_b, doc_a, doc_b, n: int) -> list[str]:
    """The groups of each text: both sides' ids, commas between; `|` and `;` end a side's."""
    def marks(group: np.ndarray, end: int) -> np.ndarray:
        found = np.zeros(len(group), dtype=np.int64)
        found[:-1][group[1:] != group[:-1]] = end
        found[-1:] = end
        return found

    # a group's tokens of A, then those of B: each behind what stands before its group
    size_a, size_b = (np.bincount(g, minlength=1) for g in (group_a, group_b))
    place = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    place[np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a]] = (
        3 * ids_a + marks(group_a, 1))
    place[np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]] = (
        3 * (ids_b + len(a.spelled)) + marks(group_b, 2))
    told = list(map(_told_ids(a, b).__getitem__, place.tolist()))
    ends = np.cumsum(np.bincount(np.concatenate([doc_a, doc_b]), minlength=n)).tolist()
    begin, found = 0, []
    for end in ends:
        found.append("".join(told[begin:end])[:-1])
        begin = end
    return found


@functools.cache
def _told_ids(a: Side, b: Side) -> list[str]:
    """The digits of both sides' ids, each before a comma, a bar and a semicolon."""
    return [f"{i}{mark}" for side in (a, b) for i in range(len(side.spelled)) for mark in ",|;"]


# ---- over a table ----

_FIELDS = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
_BUNDLED = "bundle long, kind int, " + _FIELDS + ", pairs binary, counts binary"


def _bundled(a: str, b: str, pairs: int, most: int):
    """Texts with their pairs as numbers of the bundle's, and a row of all pairs of the bundle.

    Kind 0: the bundle's different pairs and how many of its texts have each. Kind 1: a text,
    the numbers of its pairs and their links.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, at, seq = _sides(a, b), TaskContext.get().partitionId(), 0
        ids, aligned, size = [], [], 0
        for some_ids, some in _slices(batches, min(TOGETHER, 64 * pairs)):
            ids.append(some_ids)
            aligned.append(align_texts(some, *sides))
            size += len(aligned[-1].pair)
            if size >= pairs or sum(map(len, ids)) >= most:
                yield _bundle((at << 32) + seq, ids, aligned)
                ids, aligned, size, seq = [], [], 0, seq + 1
        if ids:
            yield _bundle((at << 32) + seq, ids, aligned)
    return run


def _slices(batches: Iterator[pa.RecordBatch],
            most: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, about ``most`` characters at a time."""
    for batch in batches:
        begin, held, texts = 0, 0, []
        for end, value in enumerate(batch.column(1), 1):
            texts.append(value.as_py())
            held += len(texts[-1] or "")
            if held >= most or end == len(batch):
                yield batch.column(0).slice(begin, end - begin), texts
                begin, held, texts = end, 0, []


def _bundle(bundle: int, ids: list[pa.Array], aligned: list[Aligned]) -> pa.RecordBatch:
    n = sum(map(len, ids))
    pairs, number = np.unique(np.concatenate([x.pair for x in aligned]), return_inverse=True)
    # a text has a pair once, with the number of its links
    texts = np.bincount(number, minlength=len(pairs))
    number = number.astype(np.int32)
    rows_numbers, rows_links, begin = [], [], 0
    for x, own in zip(aligned, ids):
        cuts = np.searchsorted(x.doc, np.arange(len(own) + 1))
        links = x.links.astype(np.int32) if x.links.max(initial=0) < 2 ** 31 else x.links
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows_numbers.append(number[begin + i:begin + j].tobytes())
            rows_links.append(links[i:j].astype(np.int64).tobytes() if links.itemsize == 8
                              else _narrow(links[i:j]))
        begin += len(x.pair)
    digests = [hashlib.sha256(s.encode()).hexdigest() if s else ""
               for x in aligned for s in x.spelled]
    counts = [np.concatenate([getattr(x, c) for x in aligned])
              for c in ("n_a", "n_b", "n_groups", "n_links")]
    none = pa.nulls(1, ids[0].type)
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([none, *ids]), pa.array([bundle] * (n + 1), pa.int64()),
        pa.array([0] + [1] * n, pa.int32()),
        *(pa.array([None, *c.tolist()], pa.int64()) for c in counts),
        pa.array([None, *digests], pa.string()),
        pa.array([pairs.tobytes(), *rows_numbers], pa.binary()),
        pa.array([texts.astype(np.int64).tobytes(), *rows_links], pa.binary())],
        names=["id", "bundle", "kind", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
               "pairs", "counts"])


def _narrow(links: np.ndarray) -> bytes:
    """Numbers of links in as few bytes as they take; their width follows from the length."""
    most = links.max(initial=0)
    return links.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int32).tobytes()


def _wide(found: bytes, n: int) -> np.ndarray:
    width = len(found) // max(n, 1)
    return np.frombuffer(found, {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.int32,
                                 8: np.int64}[width]).astype(np.int64)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a bundle's pairs."""
    for batch in batches:
        for bundle, pairs, texts in zip(*(c.to_pylist() for c in batch.columns)):
            pairs, texts = np.frombuffer(pairs, np.int64), np.frombuffer(texts, np.int64)
            for begin in range(0, len(pairs), 1 << 16):
                some = slice(begin, begin + (1 << 16))
                size = len(pairs[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, bundle)), pa.array(pairs[some]), pa.array(texts[some])],
                    names=["bundle", "pair", "n"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over each text's links, from the counts of its bundle's pairs, which come first."""
    at, parts, counts, best = None, [], None, None
    for batch in batches:
        bundles = np.asarray(batch.column(1))
        kinds = np.asarray(batch.column(2))
        cuts = np.flatnonzero((np.diff(bundles) != 0) | (np.diff(kinds) != 0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)]):
            if not len(kinds):
                continue
            if bundles[begin] != at:
                at, parts, counts = int(bundles[begin]), [], None
            some = batch.slice(begin, end - begin)
            if kinds[begin] == 0:
                # pairs come in their order, which is the order of their numbers
                parts.append((np.asarray(some.column(11)), np.asarray(some.column(12))))
                continue
            if counts is None:
                counts, best = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)])
                                for i in (0, 1))
            sums = []
            for numbers, links in zip(some.column(8).to_pylist(), some.column(9).to_pylist()):
                numbers = np.frombuffer(numbers, np.int32)
                links = _wide(links, len(numbers))
                sums.append((int(links @ best[numbers].astype(np.int64)),
                             int(links @ counts[numbers])))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), *(some.column(i) for i in range(3, 8)),
                 *(pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1))],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best",
                       "count_sum"])


def align_documents(df: DataFrame, doc_id: str, text: str, a: str, b: str,
                    pairs: int = BUNDLE, texts: int = TEXTS) -> DataFrame:
    """Each row's ``doc_id`` with its tokens' alignment and what its links count for.

    ``a`` is the path of a byte-level vocabulary, which reads a space and the text, ``b`` that of
    a piece vocabulary, which adds the space. ``n_a`` and ``n_b`` are the tokens, ``n_groups``
    the groups between bytes at which tokens of both end, ``n_links`` the pairs of tokens in the
    same group. A pair of ids counts the texts in which it is linked, over the whole table:
    ``count_sum`` adds that up over a text's links, ``n_best`` counts the links whose pair has
    the largest count of its id of ``a``, ties included. ``groups_sha256`` is the digest of
    the groups' ids.

    A text that is null, empty or not given back by both tokenizers has no tokens: zeros, and an
    empty string. Repeated rows count like others, null ids stay, further columns are left out,
    an empty table gives no rows.

    Texts are encoded once. They stay in bundles that end with ``pairs`` pairs or ``texts`` texts,
    which a task holds; the different pairs of each are summed up, and their counts go back to
    the bundle.
    """
    checkpoint_folder(df.sparkSession)
    id_field = df.select(F.col(quoted(doc_id)).alias("id")).schema["id"]
    bundled = df.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text))).mapInArrow(
        _bundled(a, b, pairs, texts), StructType([id_field, *_parse_datatype_string(_BUNDLED).fields])).checkpoint()
    named = bundled.where("kind = 0").select("bundle", "pairs", "counts").mapInArrow(
        _named, "bundle long, pair long, n long")
    upper = F.shiftright("pair", 32)
    counted = named.groupBy("pair").agg(F.sum("n").alias("count")).checkpoint()
    # one row for each id of the vocabulary at most
    most = counted.groupBy(upper.alias("a")).agg(F.max("count").alias("most"))
    ranked = counted.join(F.broadcast(most), upper == F.col("a")).select(
        "pair", "count", (F.col("count") == F.col("most")).cast("byte").alias("best"))
    aligned = bundled.where("kind = 1")
    back = named.select("bundle", "pair").join(ranked, "pair")
    met = aligned.withColumns({c: F.lit(None).cast(k) for c, k in
                             (("pair", "long"), ("count", "long"), ("best", "byte"))}).unionByName(
        back.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return (met.repartition("bundle").sortWithinPartitions("bundle", "kind", "pair")
            .mapInArrow(_told, StructType([id_field, *_parse_datatype_string(
                _FIELDS + ", n_best long, count_sum long").fields]))
            .withColumnRenamed("id", doc_id))
