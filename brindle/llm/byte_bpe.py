"""Byte-level BPE by a rank file, encoded in overlapping chunks, and decoded.

A long text is cut into chunks that overlap. Each is split into pre-tokens
alone and in parallel. A pre-token's end depends on nothing before its start, so
as soon as two neighbours both have a boundary at the same place of their
overlap, the right one's pre-tokens are those of the whole text from there on.
The chunks are stitched at the first such place, and the pieces between these
places are encoded, pre-token by pre-token; a document's ids are its pieces' ids
in order. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from brindle.llm.texts import quoted, with_fields

CHUNK = 32_768
OVERLAP = 512
#: A chunk's last characters might go on in a way that it does not see.
BLIND = 8


class Codec:
    """Encodes texts by ranks, each match of the pattern alone, and decodes ids."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as file:
            merges = {base64.b64decode(token): int(rank)
                      for token, rank in map(bytes.split, file)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges,
                                           special_tokens={})
        self._pattern = regex.compile(pattern)
        size = max(merges.values()) + 1
        self._bytes = [b""] * size
        for token, rank in merges.items():
            self._bytes[rank] = token
        self._decimal = [str(i) for i in range(size)]

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pattern's matches, which cover the text."""
        return list(accumulate(map(len, self._pattern.findall(text))))

    def encode(self, pieces: Iterable[str]) -> list[int]:
        return list(chain.from_iterable(map(self._encoding.encode_ordinary, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        written = ",".join(map(self._decimal.__getitem__, ids))
        return (len(ids), hashlib.sha256(written.encode()).hexdigest(),
                hashlib.sha256(self.decode(ids)).hexdigest())


@functools.cache
def codec(ranks: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(ranks, pattern)


def chunks_of(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Start and text of each chunk; the last one reaches the end."""
    if len(text) <= size:
        return [(0, text)]
    step = size - overlap
    return [(at, text[at:at + size]) for at in range(0, len(text) - overlap, step)]


def stitch(parts: list[tuple[int, str, list[int]]],
           boundaries: Callable[[str], list[int]]) -> Iterator[str]:
    """Pieces of the whole text from chunks (start, text, boundaries near its ends).

    A piece ends at a boundary of the whole text and not after white space, whose
    matches look ahead; so it is split alone as in the whole. Where two neighbours
    share no such place (say, a word longer than the overlap), both go into one piece.
    """
    at, text, ends = parts[0]
    for start, following, its_ends in parts[1:]:
        its_sure = [e for e in its_ends if e <= len(following) - BLIND]
        if ends is None and its_sure:
            ends = boundaries(text)
        sure = {e + at for e in ends or ()
                if e <= len(text) - BLIND and not text[e - 1].isspace()}
        cut = min(sure & {start, *(e + start for e in its_sure)}, default=None)
        if cut is None:
            text, ends = text[:start - at] + following, None
        else:
            yield text[:cut - at]
            at, text, ends = cut, following[cut - start:], [
                e - (cut - start) for e in its_ends if e > cut - start]
    yield text


FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(df: DataFrame, text: str, ranks: str, pattern: str,
                 chunk: int = CHUNK, overlap: int = OVERLAP,
                 with_ids: bool = False) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (of decimal ids, joined by commas), decoded_sha256.

    ``decoded_sha256`` is that of the bytes decoded from the ids; ``with_ids`` adds
    the ids themselves (array of int). Texts of up to ``chunk`` characters are
    encoded where they are read. Longer ones are dealt out chunk by chunk for the
    boundaries, then met by document; a task holds one document at a time. Any
    text's ids are the same as if it were encoded in one piece. A null text is
    an empty one: no ids. Repeated rows stay repeated. Columns named like a result
    are replaced by it.
    """
    if not BLIND < overlap <= chunk // 2:
        raise ValueError("the overlap must be longer than BLIND and at most half a chunk")
    schema = FIELDS + (", ids array<int>" if with_ids else "")

    def digest(known: Codec, ids: list[int]) -> tuple:
        return known.digests(ids) + ((ids,) if with_ids else ())

    def whole(texts: Iterable[str | None]) -> Iterator[tuple]:
        known = codec(ranks, pattern)
        for t in texts:
            yield digest(known, known.encode([t or ""]))

    is_long = F.coalesce(F.char_length(F.col(quoted(text))), F.lit(0)) > chunk
    short = with_fields(df.where(~is_long), text, schema, whole)

    # Long ones: a row for each chunk; the first has the row's other columns, in one struct.
    names = _names(schema)
    kept = [c for c in df.columns if c not in names]
    boxed = df.where(is_long).select(
        F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)]).alias("kept"),
        F.col(quoted(text)).alias("part"), F.monotonically_increasing_id().alias("row"))
    box = StructField("kept", boxed.schema["kept"].dataType)
    cut = boxed.mapInArrow(_cutter(chunk, overlap), StructType(
        [box, *_fields("row long, number int, start long, part string")]))

    @F.arrow_udf("array<int>")
    def boundaries(texts: pa.Array) -> pa.Array:
        known = codec(ranks, pattern)
        found = []
        for t in (t.as_py() for t in texts):
            # only those that a neighbour sees too
            found.append([e for e in known.boundaries(t)
                          if e <= overlap or e >= len(t) - overlap])
        return pa.array(found, pa.list_(pa.int32()))

    split = (cut.repartition("row", "number").withColumn("ends", boundaries("part"))
             .repartition("row").sortWithinPartitions("row", "number"))
    met = split.mapInArrow(_stitcher(ranks, pattern, digest),
                           StructType([box, *_fields(schema)]))
    long = met.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(kept)], *names)
    return short.unionByName(long)


def _fields(schema: str) -> list[StructField]:
    return _parse_datatype_string(schema).fields


def _names(schema: str) -> list[str]:
    return [f.name for f in _fields(schema)]


def _cutter(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts, rows = batch.columns
            for i, (t, r) in enumerate(zip(texts, rows)):
                found = chunks_of(t.as_py(), chunk, overlap)
                boxes = kept.take(pa.array([i] + [None] * (len(found) - 1), pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    boxes,
                    pa.array([r.as_py()] * len(found), pa.int64()),
                    pa.array(range(len(found)), pa.int32()),
                    pa.array([s for s, _ in found], pa.int64()),
                    pa.array([p for _, p in found], pa.string())],
                    names=["kept", "row", "number", "start", "part"])
    return cut


def _stitcher(ranks: str, pattern: str, digest):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(ranks, pattern)

        def done(kept: pa.Array, parts: list) -> pa.RecordBatch:
            found = digest(known, known.encode(stitch(parts, known.boundaries)))
            return pa.RecordBatch.from_arrays(
                [kept, *[pa.array([v], k) for v, k in zip(found, kinds)]],
                names=["kept", "n", "ids", "decoded", "list"][:len(found) + 1])

        at, kept, parts = None, None, []
        for batch in batches:
            for i, (_, row, _, start, part, ends) in enumerate(zip(*batch.columns)):
                if (row := row.as_py()) != at:
                    if parts:
                        yield done(kept, parts)
                    at, kept, parts = row, batch.column(0).slice(i, 1), []
                parts.append((start.as_py(), part.as_py(), ends.as_py()))
        if parts:
            yield done(kept, parts)
    return meet
