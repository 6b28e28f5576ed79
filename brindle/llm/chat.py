"""Chat formatting that is read back before it is given out.

A turn is written between marks of its role. A deterministic parser reads what
was written; if it does not get back the turn as it was, because the text holds
marks or what looks like an escape, the text is escaped more and the turn written
anew, until both are the same. The parser is at rest between turns and never looks
beyond a turn's closing mark, so turns that are read back one by one are also read
back when they stand one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from brindle.llm.texts import quoted, with_fields

#: Marks that open and close a turn; any other role is written out between ANY_ROLE marks.
ROLES = {
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
    "system": ("<<SYS>>", "<</SYS>>"),
}
ANY_ROLE = ("[ROLE]", "[TEXT]", "[/ROLE]")
LEARNED = "assistant"

_MARK = "|".join(re.escape(m) for marks in [*ROLES.values(), ANY_ROLE] for m in marks)
#: What the parser stops at inside a text: an escaped character or a mark.
_STOP = re.compile(rf"\\([\\\[<])|( ?(?:{_MARK}))")
#: How texts are written: as they are; with a backslash before marks and before what reads
#: as an escape; with one before every character that can begin either.
_ESCAPES = (
    lambda text: text,
    lambda text: re.sub(rf"(?=\\[\\\[<]|{_MARK})", r"\\", text),
    lambda text: re.sub(r"(?=[\\\[<])", r"\\", text),
)


def unescaped(text: str) -> str:
    """A part of what was written, as it was said."""
    return re.sub(r"\\([\\\[<])", r"\1", text)


def write_turn(role: str, text: str, level: int) -> str:
    escape = _ESCAPES[level]
    if role in ROLES:
        opening, closing = ROLES[role]
        return f"{opening} {escape(text)} {closing}"
    opening, middle, closing = ANY_ROLE
    return f"{opening} {escape(role)} {middle} {escape(text)} {closing}"


def _content(written: str, at: int, closing: str) -> tuple[str, int, int]:
    """Unescaped text from ``at`` to the closing mark, where that begins, where it ends."""
    parts = []
    for stop in _STOP.finditer(written, at):
        parts.append(written[at:stop.start()])
        at = stop.end()
        if stop[1]:
            parts.append(stop[1])
        elif stop[2] == f" {closing}":
            return "".join(parts), stop.start(), at
        else:
            raise ValueError(f"{stop[2]!r} inside a text")
    raise ValueError(f"no {closing}")


def read_turns(written: str) -> Iterator[tuple[str, str, int, int]]:
    """Role and text of each turn, and where its text stands in ``written``."""
    at = 0
    while at < len(written):
        for role, (opening, closing) in ROLES.items():
            if written.startswith(f"{opening} ", at):
                break
        else:
            opening, middle, closing = ANY_ROLE
            if not written.startswith(f"{opening} ", at):
                raise ValueError("no turn begins here")
            role, _, at = _content(written, at + len(opening) + 1, middle)
            if role in ROLES or not written.startswith(" ", at):
                raise ValueError("a role that has marks of its own, or no text")
            opening = ""
        begin = at + len(opening) + 1
        text, end, at = _content(written, begin, closing)
        yield role, text, begin, end


def format_turn(role: str | None, text: str | None) -> tuple:
    """The turn as it is written, the escape level, and where the loss begins and ends."""
    role, text = role or "", text or ""
    for level in range(len(_ESCAPES)):
        written = write_turn(role, text, level)
        try:
            found = list(read_turns(written))
        except ValueError:
            continue
        if [f[:2] for f in found] == [(role, text)]:
            loss = found[0][2:] if role == LEARNED else (None, None)
            return (written, level, *loss)
    raise AssertionError("a fully escaped turn is always read back")


FIELDS = "formatted string, escape_level int, loss_start int, loss_end int"


def format_turns(df: DataFrame, role: str, text: str) -> DataFrame:
    """``df`` with formatted, escape_level, loss_start and loss_end for each turn.

    A conversation's text is its turns' ``formatted`` in order; the loss span (code points
    in ``formatted``, as escaped) is an assistant's text, null for other roles. Each row is
    formatted and read back alone, in parallel, however many turns a conversation has.
    A null role or text is an empty one. Columns named like a result are replaced.
    """
    def rows(turns: Iterable[tuple[str | None, str | None]]) -> Iterator[tuple]:
        return (format_turn(r, t) for r, t in turns)

    return with_fields(df, [role, text], FIELDS, rows)


SPANS = ("formatted", "loss_start", "loss_end")
DIGESTS = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, written: str, begin: int | None, end: int | None) -> None:
        self.chars += len(written)
        for role, text, _, _ in read_turns(written):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if begin is not None:
            # what the mask covers, whosever turn it is
            learned = unescaped(written[begin:end])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> tuple:
        return (self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation, made from what the parser reads in its formatted turns.

    The loss columns are of the text between ``loss_start`` and ``loss_end``, unescaped.
    Turns are taken in order of ``turn`` (nulls first), then role and text, so rows that
    repeat a turn have a place too. A conversation's digest is one chain, so its turns pass
    one task; they do so one at a time, sorted by Spark, and none is kept. Rows without an
    id are one conversation. An empty table has none.
    """
    order = ["id", "turn", "role", "text"]
    rows = formatted.select(*[F.col(quoted(c)).alias(n) for c, n in zip(
        (conv_id, turn, role, text, *SPANS), [*order, *SPANS])])
    ordered = rows.repartition("id").sortWithinPartitions(*order).select("id", *SPANS)
    id_field = ordered.schema["id"]
    fields = _parse_datatype_string(DIGESTS).fields

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids, found, current = None, [], [], None

        def done() -> pa.RecordBatch:
            columns = [pa.array(c) for c in zip(*[d.row() for d in found])]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *columns], names=["id", *[f.name for f in fields]])

        for batch in batches:
            kind = batch.column(0).type
            ids_, written_, *loss = batch.columns
            for i, written, *span in zip(ids_.to_pylist(), written_,
                                         *(c.to_pylist() for c in loss)):
                if current is None or i != ids[-1]:
                    if len(ids) >= 5000:
                        yield done()
                        ids, found = [], []
                    current = _Digest()
                    ids.append(i)
                    found.append(current)
                current.add(written.as_py(), *span)
        if ids:
            yield done()

    return ordered.mapInArrow(
        read, StructType([StructField(conv_id, id_field.dataType), *fields]))
