"""Vector bin packing of examples into sequences, by the dot-product heuristic.

A sequence has three limits at once: tokens, segments, and tokens that bear
loss. Each example is a vector of what it takes of them. A sequence is filled by
taking, again and again, the example that fits and whose vector has the largest
dot product with what is left of the limits (both in shares of the limits). Equal
vectors are counted together, so a choice costs the number of different vectors.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from brindle.llm.texts import give_back, lean, quoted, with_fields

#: Examples that a task packs together, and the share below which a sequence waits for more.
BLOCK = 50_000
FULL = 0.98
#: White space for Arrow but not for the tokenizer, and the mark between words.
_APART = "[\x00\x1c-\x1f]"
#: A point or comma that closes a word of letters, after A-Z are lowered.
_TAIL = r"([a-z])([.,])([ \t\n\r]|$)"
#: Characters whose words are encoded together; words that a Python worker keeps, up to so many bytes each.
TOGETHER, KEPT_WORDS, LONGEST_KEPT = 4_000_000, 300_000, 40


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int
    segments: int
    loss: int


def pack_vectors(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Positions of the examples in each sequence, in the order in which they are placed."""
    waiting: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, vector in enumerate(zip(tokens.tolist(), loss.tolist())):
        waiting[vector].append(i)
    vectors = sorted(waiting, reverse=True)
    left = np.array([len(waiting[v]) for v in vectors])
    t, l = (np.array(x, dtype=np.int64).reshape(-1) for x in (list(zip(*vectors)) or ([], [])))
    # shares of the limits, with a limit of 0 never being drawn on
    ts, ls = t / max(limits.tokens, 1), l / max(limits.loss, 1)
    for v in vectors:
        waiting[v].reverse()

    sequences, remaining = [], int(left.sum())
    while remaining:
        here, free_t, free_s, free_l = [], limits.tokens, limits.segments, limits.loss
        while free_s and remaining:
            fits = (left > 0) & (t <= free_t) & (l <= free_l)
            gain = np.where(fits, ts * (free_t / max(limits.tokens, 1))
                            + ls * (free_l / max(limits.loss, 1)), -1.0)
            best = int(gain.argmax())
            if gain[best] < 0:
                break
            # the segments' part of the product is the same for all
            here.append(waiting[vectors[best]].pop())
            left[best] -= 1
            remaining -= 1
            free_t, free_s, free_l = free_t - t[best], free_s - 1, free_l - l[best]
        if not here:
            raise ValueError("an example is larger than a sequence; cut it first")
        sequences.append(here)
        if remaining and not left[left.size // 2:].any() and left.size > 64:
            keep = np.flatnonzero(left)
            vectors, left = [vectors[i] for i in keep], left[keep]
            t, l, ts, ls = t[keep], l[keep], ts[keep], ls[keep]
    return sequences


def pack(df: DataFrame, tokens: str, loss: str, limits: Limits, block: int = BLOCK) -> DataFrame:
    """``df`` with sequence_id and offset (tokens before the example in its sequence).

    Each partition is packed alone and in blocks of up to ``block`` examples,
    so nothing is shuffled and memory does not grow; sequences that are not full wait for
    the next block, and each partition leaves a few part-filled ones. Ids are unique
    in the table, and the same if a task is run again on the same rows.

    Null counts are 0. An example beyond a limit is an error, so cut it first.
    Repeated rows are packed as often as they come. Columns of ``df`` that are
    named like a result are replaced. An empty table gives no sequences.
    """
    kept = df.drop("sequence_id", "offset")
    run = _packer(kept.columns.index(tokens), kept.columns.index(loss), limits, block)
    return kept.mapInArrow(lean(run), StructType([*kept.schema.fields, *PLACES]))


PLACES = [StructField(n, LongType()) for n in ("sequence_id", "offset")]


def _packer(t_at: int, l_at: int, limits: Limits, block: int):
    """Packs batches whose columns at these places are tokens and loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        rows: pa.Table | None = None

        def packed(table: pa.Table, last: bool):
            nonlocal number
            t, l = (np.asarray(table.column(c).fill_null(0)).astype(np.int64)
                    for c in (t_at, l_at))
            order, ids, offsets, waits = [], [], [], []
            for members in pack_vectors(t, l, limits):
                sizes = t[members]
                if not last and sizes.sum() < FULL * limits.tokens:
                    waits += members
                    continue
                order += members
                ids += [number] * len(members)
                offsets += (np.cumsum(sizes) - sizes).tolist()
                number += 1
            if len(waits) > table.num_rows // 2 and not last:
                # little is gained by waiting
                yield from packed(table, True)
                return
            done = table.take(pa.array(order, pa.int64()))
            done = done.append_column("sequence_id", pa.array(ids, pa.int64()))
            done = done.append_column("offset", pa.array(offsets, pa.int64()))
            yield from done.combine_chunks().to_batches(max_chunksize=10_000)
            nonlocal rows
            rows = table.take(pa.array(waits, pa.int64())) if waits else None

        for batch in batches:
            new = pa.Table.from_batches([batch])
            rows = new if rows is None else pa.concat_tables([rows, new])
            if rows.num_rows >= block:
                whole, rows = rows, None
                yield from packed(whole, False)
        if rows is not None and rows.num_rows:
            yield from packed(rows, True)

    return run


class Words:
    """Encodes texts word by word.

    The tokenizer lowers case, drops white space and treats what stands between it
    alone, so a text's ids are its words' ids joined. The different words of some
    texts are found by Arrow, which also looks up those that are known from before, with their
    ids, in columns: only new words are Python's. A-Z are lowered and points and commas that
    close a word of letters set apart before, so that fewer words are different.
    """

    _MARK = "\0"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # strings of special tokens are their ids, as the library has it: texts with them are
        # encoded as they are, like those whose blanks mean something else to Arrow
        special = (re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self._apart = "|".join([_APART, *(f"(?i:{s})" for s in special)])
        # words that are known, all their ids in a row and where each word's end
        self._known = pa.array([], pa.large_string())
        self._ids, self._ends = np.array([], dtype="<u4"), np.array([0])
        [self._mark_id] = self._numbers(self._MARK)
        # letters that are one pre-token and their own normal form; as the model writes them
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {ord(c): spelled.pre_tokenize_str(c)[0][0]
                         for c in map(chr, range(0x180)) if c.isalpha() and c == c.lower()}
        self._plain = re.compile(f"[{''.join(map(chr, self._letters))}]+").fullmatch

    def _numbers(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, one word after the other, and how many each has."""
        letters, tokenize, plain = self._letters, self.tokenizer.model.tokenize, self._plain
        made: list[list[int]] = []
        others = []
        for at, word in enumerate(words):
            # what lowering leaves plain is lowered alike here and in the tokenizer
            if word.isascii() and word.isalpha():
                made.append([t.id for t in tokenize(word)])
            elif plain(low := word.lower()):
                made.append([t.id for t in tokenize(low.translate(letters))])
            else:
                made.append([])
                others.append(at)
        for begin in range(0, len(others), 1000):
            some = others[begin:begin + 1000]
            numbers = self._numbers(f" {self._MARK} ".join([words[at] for at in some]))
            ids, start = numbers.tolist(), 0
            bounds = [*np.flatnonzero(numbers == self._mark_id).tolist(), len(ids)]
            for at, end in zip(some, bounds, strict=True):
                made[at] = ids[start:end]
                start = end + 1
        return (np.fromiter(chain.from_iterable(made), "<u4"),
                np.fromiter(map(len, made), np.int64, len(made)))

    def _learned(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_of_words``; short words are kept, until there are ``KEPT_WORDS``."""
        ids, sizes = self._of_words(words.to_pylist())
        short = np.asarray(pc.binary_length(words)) <= LONGEST_KEPT
        kept = short & (np.cumsum(short) <= KEPT_WORDS - len(self._known))
        if kept.any():
            self._known = pa.concat_arrays([self._known, words.filter(pa.array(kept))])
            self._ids = np.concatenate([self._ids, ids[np.repeat(kept, sizes)]])
            self._ends = np.concatenate(
                [self._ends, self._ends[-1] + np.cumsum(sizes[kept])])
        return ids, sizes

    def _encoded(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Lists of ids, and for each of some different words the place of its list."""
        words = words.cast(pa.large_string())
        place = pc.index_in(words, value_set=self._known)
        ids, ends = self._ids, self._ends
        new = np.asarray(place.is_null())
        at = np.asarray(place.fill_null(0)).astype(np.int64)
        if new.any():
            at[new] = np.arange(len(ends) - 1, len(ends) - 1 + new.sum())
            more, sizes = self._learned(words.filter(pa.array(new)))
            ids = np.concatenate([ids, more])
            ends = np.concatenate([ends, ends[-1] + np.cumsum(sizes)])
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids)), at

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, one text after the other, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring_regex(texts, self._apart)
        apart = {i: self._numbers(texts[i].as_py())
                 for i in np.flatnonzero(special).tolist()}
        if apart:
            texts = pc.replace_with_mask(texts, special, pa.scalar("", texts.type))
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), _TAIL, r"\1 \2\3")
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        numbers, at = self._encoded(coded.dictionary)
        taken = numbers.take(pa.array(at[coded.indices.to_numpy()]))
        found = taken.flatten().to_numpy()
        bounds = taken.offsets.to_numpy()[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if apart:
            parts = [apart.get(i, found[b:e])
                     for i, (b, e) in enumerate(zip(bounds[:-1], bounds[1:]))]
            found, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return found, bounds


@functools.cache
def words(path: str) -> Words:
    """One for each Python worker."""
    return Words(path)


def turn_vectors(df: DataFrame, formatted: str, begin: str, end: str, tokenizer: str) -> DataFrame:
    """``df`` with ``tokens`` and ``loss`` of each formatted turn: what it takes of the limits.

    ``loss`` counts the tokens that stand wholly in the span from ``begin`` to ``end`` (code
    points of the formatted text), the loss mask; none where it is null. A null or empty text
    has no tokens. Columns of these names are replaced.
    """
    def rows(turns: Iterable[tuple[str | None, int | None, int | None]]) -> Iterator[tuple]:
        encode = functools.partial(words(tokenizer).tokenizer.encode, add_special_tokens=False)
        for written, first, last in turns:
            spans = encode(written or "").offsets
            yield len(spans), 0 if first is None else sum(
                first <= a and b <= last and a < b for a, b in spans)

    return with_fields(df, [formatted, begin, end], "tokens long, loss long", rows)


PIECES = "start long, length long, loss long, ids_crc32 long, doc_tokens long"


def token_pieces(df: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int,
                 longest: int, with_ids: bool = False) -> DataFrame:
    """Each text's token ids and ``end_id``, cut in pieces of up to ``longest`` ids.

    Returns ``doc_id``, start, length, loss, ids_crc32 (of little-endian unsigned
    32-bit ids) and doc_tokens; ``with_ids`` adds the piece's ids as such bytes.
    ``loss`` counts the ids that are predicted from others of the piece: all but the
    first. A null text is empty: its one id is ``end_id``. Whole texts are encoded,
    row by row; nothing is shuffled.
    """
    source = df.select(quoted(doc_id), quoted(text))
    schema = PIECES + (", ids binary" if with_ids else "")
    return source.mapInArrow(lean(_cutter(tokenizer, end_id, longest, with_ids)), StructType(
        [source.schema[0], *_parse_datatype_string(schema).fields]))


def pack_texts(df: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int,
               limits: Limits, block: int = BLOCK) -> DataFrame:
    """``pack`` of the ``token_pieces`` of texts, in one pass by one worker for each task.

    A null text and an empty one are one piece of ``end_id``; repeated rows are packed as often as
    they come, null ids stay; an empty table gives no sequences. Only ``doc_id`` is kept of a
    row, so no other column can clash. Each task's last sequences may be filled in part.
    """
    source = df.select(quoted(doc_id), quoted(text))
    cut = _cutter(tokenizer, end_id, limits.tokens, False)
    place = _packer(2, 3, limits, block)  # length and loss
    return source.mapInArrow(lean(lambda batches: place(cut(batches))), StructType(
        [source.schema[0], *_parse_datatype_string(PIECES).fields, *PLACES]))


def _cutter(tokenizer: str, end_id: int, longest: int, with_ids: bool):
    """Makes pieces of batches of ids and texts."""
    closing = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(tokenizer)
        for batch in _sliced(batches):
            found, bounds = known.ids(batch.column(1))
            raw = memoryview(found.astype("<u4").tobytes())
            at, rows, parts = [], [], []
            for i, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                n = end - begin + 1
                for start in range(0, n, longest):
                    length = min(longest, n - start)
                    part = raw[4 * (begin + start):4 * min(begin + start + length, end)]
                    crc = zlib.crc32(part)
                    if start + length == n:
                        crc = zlib.crc32(closing, crc)
                    at.append(i)
                    rows.append((start, length, length - 1, crc, n))
                    if with_ids:
                        parts.append(bytes(part) + closing * (start + length == n))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [
                pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *columns,
                 *([pa.array(parts, pa.binary())] if with_ids else [])],
                names=[str(i) for i in range(6 + with_ids)])

    return run


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``TOGETHER`` bytes of text at most, or one row."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + TOGETHER, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
            give_back()
