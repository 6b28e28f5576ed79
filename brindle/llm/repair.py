"""Conversation structure repair: the cheapest edits, found by a persistent audit DP.

A conversation is to read system (or none), then user and assistant by turns. Each turn is kept,
given another role or deleted, and empty turns may be put in; the cheapest edits win, and of
equally cheap ones those whose initials (D, I, K, R) are least as text. The DP goes over the
turns with four states: nothing yet, after the system's turn, after the user's, after the
assistant's. Each state holds its cost and a node of a tree in which edits share their
prefixes. A node knows its ancestors at distances of powers of two and a rolling hash of the
letters that lead to it, so two audits of equal cost are compared by a search for their longest
common prefix, which takes logarithmic time; the prefix itself is then verified.

Which turn follows which is known once turns are in order; no conversation has to stand in one
task for that. Turns are ranged by conversation and place, each task cuts its range into segments,
and a segment gives the cheapest edits from each state to each. Segments are put together like
turns, with the letters of a segment where a turn has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from brindle.llm.texts import quoted
from brindle.session import checkpoint_folder

#: U+0020 and U+0009 to U+000D, as blank as a text can be.
BLANK = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
#: Turns whose audits a task holds at once.
SEGMENT = 4096
#: Rows that a task hands on at once.
ROWS = 2000

START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state by a role's initial.
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER,
           (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that an inserted turn, or one with a new role, leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}


@dataclass(frozen=True)
class Costs:
    """What an edit costs; keeping costs nothing."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Audits:
    """Edit sequences as nodes that share their prefixes.

    A node is one step (a turn's letters, or a segment's) behind its parent. The steps of two
    nodes of the same depth never are proper prefixes of each other, so the first that
    differ decide between them.
    """

    def __init__(self, base: int = 1_000_003, modulus: int = 2 ** 61 - 1):
        self._base, self._modulus = base, modulus
        self._steps, self._hashes = [""], [0]
        #: Of each node its ancestors 1, 2, 4, ... steps up.
        self._up: list[tuple[int, ...]] = [()]

    def add(self, node: int, step: str) -> int:
        """The node that follows ``node`` by the letters of ``step``."""
        found = self._hashes[node]
        for letter in step:
            found = (found * self._base + ord(letter)) % self._modulus
        ancestors = [node]
        while len(above := self._up[ancestors[-1]]) >= len(ancestors):
            ancestors.append(above[len(ancestors) - 1])
        self._steps.append(step)
        self._hashes.append(found)
        self._up.append(tuple(ancestors))
        return len(self._steps) - 1

    def compare(self, x: int, y: int) -> int:
        """Below, equal to or above 0, as the letters of ``x`` compare with those of ``y``.

        Both nodes have the same depth.
        """
        if x != y and self._hashes[x] != self._hashes[y]:
            for j in reversed(range(len(self._up[x]))):
                if j < len(self._up[x]):
                    a, b = self._up[x][j], self._up[y][j]
                    if self._hashes[a] != self._hashes[b]:
                        x, y = a, b
        # hashes say that all above is equal: verified up to a node that both share
        first, a, b = (x, y), x, y
        while a != b:
            if self._steps[a] != self._steps[b]:
                first = a, b
            a, b = self._up[a][0], self._up[b][0]
        x, y = (self._steps[i] for i in first)
        return (x > y) - (x < y)

    def letters(self, node: int) -> str:
        steps = []
        while self._up[node]:
            steps.append(self._steps[node])
            node = self._up[node][0]
        return "".join(reversed(steps))


#: Cost, node, and the letters that follow it.
Way = tuple[int, int, str]


class Edits:
    """The cheapest edits from one state to each, as turns or segments come in."""

    def __init__(self, start: int, costs: Costs):
        self._audits, self._costs = Audits(), costs
        self.ways: list[Way | None] = [None] * 4
        self.ways[start] = (0, 0, "")

    def _better(self, x: Way, y: Way | None) -> bool:
        if y is None or x[0] != y[0]:
            return y is None or x[0] < y[0]
        return (self._audits.compare(x[1], y[1]) or (x[2] > y[2]) - (x[2] < y[2])) < 0

    def _take(self, ways: list[Way | None], state: int, way: Way) -> None:
        if self._better(way, ways[state]):
            ways[state] = way

    def _inserted(self) -> list[Way | None]:
        """The ways with turns put in here; more than two in a row are never cheapest."""
        ways = list(self.ways)
        for state in (START, SYSTEM, ASSISTANT, USER):
            if (way := ways[state]) is not None:
                self._take(ways, NEXT[state], (way[0] + self._costs.insert, way[1], way[2] + "I"))
        return ways

    def _grow(self, ways: list[Way | None]) -> None:
        self.ways = [way and (way[0], self._audits.add(way[1], way[2]), "") for way in ways]

    def turn(self, initial: str, deleted: bool, truncated: bool) -> None:
        """The next turn; ``deleted`` if it has to be."""
        costs, new = self._costs, [None] * 4
        more = costs.truncated if truncated else 0
        for state, way in enumerate(self._inserted()):
            if way is None:
                continue
            cost, node, letters = way
            self._take(new, state, (cost + costs.delete, node, letters + "D"))
            if not deleted:
                if (kept := FOLLOWS.get((state, initial))) is not None:
                    self._take(new, kept, (cost + more, node, letters + "K"))
                self._take(new, NEXT[state], (cost + costs.rerole + more, node, letters + "R"))
        self._grow(new)

    def segment(self, costs: list[int | None], audits: list[str]) -> None:
        """The next segment: for each state at its begin, four costs and audits."""
        new = [None] * 4
        for i, (cost, letters) in enumerate(zip(costs, audits)):
            before = self.ways[i // 4]
            if cost is not None and before is not None:
                self._take(new, i % 4, (before[0] + cost, before[1], letters))
        self._grow(new)

    def found(self) -> tuple[list[int | None], list[str]]:
        """Costs and letters by state, before turns are put in at the end."""
        return ([way and way[0] for way in self.ways],
                [self._audits.letters(way[1]) if way else "" for way in self.ways])

    def best(self) -> tuple[int, str]:
        """Cost and letters of the cheapest edits that end as a conversation may."""
        ends: list[Way | None] = [None]
        for state, letters in ((START, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II")):
            if (way := self.ways[state]) is not None:
                self._take(ends, 0, (way[0] + self._costs.insert * len(letters), way[1], letters))
        cost, node, letters = ends[0]
        return cost, self._audits.letters(node) + letters


def repaired(turns: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each turn, deleted and inserted ones included."""
    edits, state = iter(audit), START
    for role, text in turns:
        for edit in edits:
            if edit == "D":
                yield edit, role, text
                break
            if edit == "K":
                state = FOLLOWS[state, role[:1]]
                yield edit, role, text
                break
            state = NEXT[state]
            yield edit, ROLES[state], text if edit == "R" else ""
            if edit == "R":
                break
    for edit in edits:
        state = NEXT[state]
        yield edit, ROLES[state], ""


def find_faults(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of ``conv``, ``turn``, ``role``, ``text``, ``place`` and ``fault``, written once.

    ``fault`` is 1 for a blank text, 2 for a turn whose role and text stand in an earlier one of
    its conversation, 3 for a text that does not end in ``.``, ``!`` or ``?``, else 0. Turns
    go by ``turn`` (nulls first), role, text, and ``place``, which tells repeated rows apart.
    Null roles and texts are one space.
    """
    checkpoint_folder(turns.sparkSession)
    spoken = turns.select(
        F.col(quoted(conv_id)).alias("conv"), F.col(quoted(turn)).cast("long").alias("turn"),
        F.coalesce(F.col(quoted(role)), F.lit(" ")).alias("role"),
        F.coalesce(F.col(quoted(text)), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("place"))
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    # places are written before they are compared: they may differ from job to job
    spoken = spoken.withColumn("said", said).checkpoint()
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("t"),
                  "place")
    # only what was said more than once; summed up in the map tasks
    firsts = (spoken.groupBy(F.col("conv").alias("conv_"), F.col("said").alias("said_"))
              .agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1"))
    met = spoken.join(firsts, F.col("conv").eqNullSafe(F.col("conv_"))
                      & (F.col("said") == F.col("said_")), "left")
    core = F.rtrim(F.col("text"), F.lit(BLANK))
    return met.select(
        "conv", "turn", "role", "text", "place",
        F.when(core == "", 1).when(F.col("n").isNotNull() & (at != F.col("first")), 2)
         .when(~F.right(core, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0).alias("fault"))


_SEGMENTS = ("part int, segment int, costs array<long>, audits array<string>, turns long, "
             "faults array<long>, illegal long, first string, last string, least long, most long, "
             "different long")
_AUDITS = ("turns long, gaps long, blank long, duplicate long, truncated long, illegal long, "
           "cost long, audit string")
LEGAL = {"su", "ua", "au"}


class _Segment:
    def __init__(self, conv: object, starts: range, costs: Costs):
        self.conv, self._edits = conv, [Edits(start, costs) for start in starts]
        self.turns, self._faults = 0, [0] * 4
        self._illegal, self._first, self._last = 0, None, None
        self._least = self._most = None
        self._different = 0

    def turn(self, turn: int | None, initial: str, fault: int) -> None:
        for edits in self._edits:
            edits.turn(initial, fault in (1, 2), fault == 3)
        if self.turns:
            self._illegal += self._last + initial not in LEGAL
        else:
            self._first = initial
        self._last = initial
        if turn is not None:
            self._different += turn != self._most
            self._least = turn if self._least is None else self._least
            self._most = turn
        self.turns += 1
        self._faults[fault] += 1

    def row(self, part: int, at: int) -> tuple:
        found = [edits.found() for edits in self._edits]
        return (self.conv, part, at, [c for f in found for c in f[0]],
                [a for f in found for a in f[1]], self.turns, self._faults[1:], self._illegal,
                self._first, self._last, self._least, self._most, self._different)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _over(df: DataFrame, rows, conv: StructField, schema: str) -> DataFrame:
    """``df`` with ``rows`` applied to each partition's rows, in their order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = StructType([conv, *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(wanted)
    return df.mapInArrow(lambda batches: _batches(rows(_values(batches)), arrow), wanted)


def _segments(costs: Costs, size: int):
    def rows(turns: Iterator[tuple]) -> Iterator[tuple]:
        part, segment, at = TaskContext.get().partitionId(), None, 0
        for conv, turn, initial, fault in turns:
            if segment is None or segment.conv != conv or segment.turns >= size:
                if segment is not None:
                    yield segment.row(part, at)
                # only the first conversation of a range may have begun before it
                begun = segment is not None and segment.conv != conv
                at += 1
                segment = _Segment(conv, range(1 if begun else 4), costs)
            segment.turn(turn, initial, fault)
        if segment is not None:
            yield segment.row(part, at)
    return rows


def _joined(costs: Costs):
    """One row of each conversation, from its segments in order and a row without any."""
    def rows(segments: Iterator[tuple]) -> Iterator[tuple]:
        conv, edits = None, None
        for row in segments:
            if edits is None or row[0] != conv:
                if edits is not None:
                    yield done(conv, edits, total)
                conv, edits = row[0], Edits(START, costs)
                total = {"turns": 0, "faults": [0] * 3, "illegal": 0, "last": None,
                         "least": None, "most": None, "different": 0}
            if row[5]:
                add(total, row[5:])
                edits.segment(row[3], row[4])
        if edits is not None:
            yield done(conv, edits, total)

    def add(total: dict, row: tuple) -> None:
        turns, faults, illegal, first, last, least, most, different = row
        total["illegal"] += illegal + bool(total["turns"] and total["last"] + first not in LEGAL)
        total["turns"] += turns
        total["faults"] = [a + b for a, b in zip(total["faults"], faults)]
        total["last"] = last
        if least is not None:
            total["different"] += different - (least == total["most"])
            total["least"] = least if total["least"] is None else total["least"]
            total["most"] = most

    def done(conv: object, edits: Edits, total: dict) -> tuple:
        gaps = 0 if total["least"] is None else (
            total["most"] - total["least"] + 1 - total["different"])
        return (conv, total["turns"], gaps, *total["faults"], total["illegal"], *edits.best())
    return rows


def audit_conversations(faults: DataFrame, conversations: DataFrame | None = None,
                        costs: Costs = Costs(), segment: int = SEGMENT) -> DataFrame:
    """A row of each conversation: ``conv``, what is wrong with it, ``cost`` and ``audit``.

    ``faults`` is what ``find_faults`` gives. ``conversations`` may name more ids (column
    ``conv``), of which no turn is there: they get zeros and an empty audit. ``gaps`` is how
    many whole numbers between the least and the largest turn are missing, ``blank``,
    ``duplicate`` and ``truncated`` count turns by their fault, and ``illegal`` counts
    neighbours whose roles may not follow each other. A null id is a conversation like others.
    """
    order = ["conv", "turn", "role", "text", "place"]
    ranged = faults.repartitionByRange(*order).sortWithinPartitions(*order)
    id_field = faults.schema["conv"]
    cut = _over(ranged.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault"),
                _segments(costs, segment), id_field, _SEGMENTS)
    if conversations is not None:
        named = conversations.select("conv").distinct()
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in cut.schema.fields[1:]]
        cut = cut.unionByName(named.select("conv", *nothing).withColumn("part", F.lit(-1)))
    met = cut.repartition("conv").sortWithinPartitions("conv", "part", "segment")
    return _over(met, _joined(costs), id_field, _AUDITS)


def repair_turns(faults: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns with their ``edit``, in order: ``conv``, ``edit``, ``role``, ``text``.

    Deleted turns (``D``) are told with what they said; kept ones (``K``), those with a new role
    (``R``) and inserted ones (``I``) make up the repaired conversation. Rows of a conversation
    follow each other in one partition, through which they stream one by one.
    """
    first = [F.lit(None).cast(faults.schema[c].dataType).alias(c) for c in ("turn", "role")]
    both = (audits.where(F.col("turns") >= 0)
            .select("conv", F.lit(0).alias("kind"), *first, F.col("audit").alias("text"),
                    F.lit(-1).cast("long").alias("place"))
            .unionByName(faults.select("conv", F.lit(1).alias("kind"), "turn", "role", "text",
                                       "place")))
    order = ["conv", "kind", "turn", "role", "text", "place"]
    met = both.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text")
    return _over(met, _edited, faults.schema["conv"], "edit string, role string, text string")


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    ahead = next(rows, None)
    while ahead is not None:
        conv, _, _, audit = ahead
        ahead = None

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            for row in rows:
                if not row[1]:
                    ahead = row
                    return
                yield row[2:]

        for edit in repaired(turns(), audit):
            yield conv, *edit


def _digested(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, digest = None, None
    for at, edit, role, text in rows:
        if digest is None or at != conv:
            if digest is not None:
                yield conv, digest.hexdigest()
            conv, digest, empty = at, hashlib.sha256(), True
        if edit != "D":
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False
    if digest is not None:
        yield conv, digest.hexdigest()


def digests(turns: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256`` of what ``repair_turns`` gives, as it comes from there."""
    return _over(turns, _digested, turns.schema["conv"], "repaired_sha256 string")


def damage(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with the faults of a noisy source: some missing, emptied, cut, repeated, misattributed.

    What happens to a turn depends on its ids alone. Null roles and texts, and null ids in that
    choice, are one space.
    """
    def spaced(column: str) -> Column:
        return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat_ws(":", spaced(conv_id), spaced(turn)).cast("binary")) % 20
    return turns.select(
        F.col(quoted(conv_id)).alias("conv"), F.col(quoted(turn)).alias("turn"),
        F.when(fate == 4, "user").otherwise(spaced(role)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spaced(text), "[.!?]", ""))
         .otherwise(spaced(text)).alias("text"),
        F.explode(F.when(fate == 0, F.array().cast("array<int>"))
                  .when(fate == 3, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair(turns: DataFrame, conv_id: str, turn: str, role: str, text: str,
           conversations: DataFrame | None = None, costs: Costs = Costs(),
           segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The conversations' audits and their repaired turns.

    Tables of ``audit_conversations`` and ``repair_turns``. Repeated rows are duplicates of the
    first; turns of the same number go by role and text; other columns are left out, whatever
    their names; an empty table gives no rows, or one of zeros for each of ``conversations``.
    A conversation of any length streams: a task holds the letters of its audit and one
    segment of turns.
    """
    faults = find_faults(turns, conv_id, turn, role, text).checkpoint()
    audits = audit_conversations(faults, conversations, costs, segment).checkpoint()
    return audits, repair_turns(faults, audits)
