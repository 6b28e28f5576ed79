"""Ordered work inside groups, for groups of any size.

A plain window sends each group to one task. That is right for small groups and
fails for a group that holds a third of a large table. ``OrderedGroups`` keeps
the plain window for the groups that fit one task and cuts the others, the hot
ones, into splits: contiguous ranges of the order, made by Spark's range
partitioning. Each split is worked on alone, and what a split needs from those
before it (a count, a sum, a last value) comes from a table with one row per
split.

Hot groups are found by a count, so nothing is assumed about the data, and
every row is kept. There are at most rows / rows_per_split hot groups, and about
twice as many splits at most. Tables of that size are broadcast if a count finds them
small, and joined as Spark chooses if not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from brindle.session import checkpoint_folder

# About a gigabyte of 200-byte rows: a sort that one task can do, spilling a bit.
ROWS_PER_SPLIT = 5_000_000
ROWS_PER_SPLIT_SETTING = "spark.brindle.rowsPerSplit"

# How many rows away a frame may look, in groups whose splits are shorter.
FARTHEST = 100_000
# What is sent to all executors at most.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000

_ALL = "_all_rows"
_SPLIT = "_split"
_POS = "_position"
_OWN = {_ALL, _SPLIT, _POS, "_rows", "_page", "_at_page"}

_AGGREGATE = {
    "count": F.count,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}
# how the results of earlier splits add up to the carry into a split
_CARRY = _AGGREGATE | {"count": F.sum, "first": F.first, "previous": _AGGREGATE["last"]}
_COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "count": lambda here, carry: here + F.coalesce(carry, F.lit(0)),
    "sum": lambda here, carry: F.coalesce(here + carry, here, carry),
    "min": F.least,
    "max": F.greatest,
    "last": F.coalesce,
    "first": lambda here, carry: F.coalesce(carry, here),
    "previous": F.coalesce,
}
# Values of a certain row, null or not: in a struct, to tell a null from no row.
_OF_A_ROW = {"first", "previous"}

Aggregate = tuple[str, str | Column]


_MADE_HERE = object()


@dataclass(frozen=True)
class Frame:
    """A window column that looks at most ``before`` / ``after`` rows away.

    Made by ``lag``, ``lead`` or ``rows``, which know how far it looks: splits of a hot group
    bring that many rows of their neighbours, so a smaller number would change the result.
    """

    before: int
    after: int
    over: Callable[[WindowSpec], Column]
    made: object = None

    def __post_init__(self) -> None:
        if self.made is not _MADE_HERE:
            raise TypeError("use Frame.lag, Frame.lead or Frame.rows")

    @classmethod
    def lag(cls, value: str | Column, rows: int = 1) -> Frame:
        """The value so many rows before."""
        return cls(max(rows, 0), max(-rows, 0), lambda w: F.lag(value, rows).over(w),
                   _MADE_HERE)

    @classmethod
    def lead(cls, value: str | Column, rows: int = 1) -> Frame:
        return cls.lag(value, -rows)

    @classmethod
    def rows(cls, aggregate: Column, start: int, end: int) -> Frame:
        """The aggregate over the rows from ``start`` to ``end``; 0 is the current one."""
        return cls(max(-start, 0), max(end, 0),
                   lambda w: aggregate.over(w.rowsBetween(start, end)), _MADE_HERE)


def _boxed(value: Column) -> Column:
    return F.struct(value.alias("it"))


def _here(how: str, value: Column, ordered: WindowSpec) -> Column:
    """The aggregate up to the current row, inside one window partition."""
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if how == "previous":
        return F.lag(_boxed(value)).over(ordered)
    if how == "first":
        return F.first(_boxed(value)).over(upto)
    return _AGGREGATE[how](value).over(upto)


def _total(how: str, value: Column, order: Sequence[str]) -> Column:
    """What a split gives to those after it."""
    at = F.struct(*order)
    if how == "first":
        return F.min_by(_boxed(value), at)
    if how == "previous":
        return F.max_by(_boxed(value), at)
    if how == "last":
        return F.max_by(value, F.when(value.isNotNull(), at))
    return _AGGREGATE[how](value)


def _columns(aggregates: dict[str, Aggregate]) -> dict[str, tuple[str, Column]]:
    return {n: (how, F.col(value) if isinstance(value, str) else value)
            for n, (how, value) in aggregates.items()}


def split_size(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_SPLIT_SETTING, str(ROWS_PER_SPLIT)))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, a table that is written already, with a hint if its rows and bytes are few.

    Beyond that Spark chooses the join, as for any table.
    """
    rows = df.count()
    if rows == 0:
        return F.broadcast(df)
    if rows > BROADCAST_ROWS:
        return df
    # as text, which is no shorter than most values are in memory
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def matching(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join a written table of a row per key, by keys that may be null; keeps ``df``'s keys."""
    other = broadcast_if_small(other)
    renamed = other.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def written(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def hot_groups(df: DataFrame, keys: Sequence[str], rows_per_split: int) -> DataFrame:
    """Groups with more rows than one split, with their row count ``_rows``."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > rows_per_split)


class OrderedGroups:
    """Rows grouped by ``keys`` and put in the ascending, total order ``order``.

    ``order`` must tell any two rows of a group apart (end it with a unique
    column); that makes the results repeatable and lets equal values be split.
    """

    def __init__(self, cold: DataFrame, hot: DataFrame | None,
                 keys: list[str], order: list[str], rows_per_split: int):
        self._cold, self._hot = cold, hot
        self._keys, self._order = keys, order
        self._rows_per_split = rows_per_split

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], order: Sequence[str],
           rows_per_split: int | None = None,
           at_most: DataFrame | None = None,
           counts: DataFrame | None = None) -> OrderedGroups:
        """Group ``df``, finding its hot groups by a count.

        Where counting ``df`` would repeat a shuffle, give ``at_most``: rows that
        are cheaper to count and at least as many in each group. If no group is
        hot there, none is in ``df``. Where the rows of each group are counted already, give
        ``counts``, a table of ``keys`` and ``_rows``.
        """
        keys, order = list(keys), list(order)
        taken = [c for c in df.columns if c in _OWN or c.startswith(("_here_", "_carry_"))]
        if taken:
            raise ValueError(f"rename these columns, which are used here: {taken}")
        rows_per_split = rows_per_split or split_size(df.sparkSession)
        if not keys:
            df, keys = df.withColumn(_ALL, F.lit(0)), [_ALL]
            at_most = at_most if at_most is None else at_most.withColumn(_ALL, F.lit(0))
        whole = cls(df, None, keys, order, rows_per_split)
        if at_most is not None and hot_groups(at_most, keys, rows_per_split).isEmpty():
            return whole
        if counts is None:
            groups = written(hot_groups(df, keys, rows_per_split))
        else:
            groups = written(counts.where(F.col("_rows") > rows_per_split))
        hot_rows = groups.agg(F.sum("_rows")).first()[0]
        if hot_rows is None:
            return whole

        splits = math.ceil(hot_rows / rows_per_split)
        # Written out, because the split of a row must be the same in every job.
        hot = written(
            matching(df, groups, keys, "left_semi")
            .repartitionByRange(splits, *keys, *order)
            .withColumn(_SPLIT, F.spark_partition_id())
        )
        cold = matching(df, groups, keys, "left_anti")
        return cls(cold, hot, keys, order, rows_per_split)

    @property
    def is_split(self) -> bool:
        return self._hot is not None

    def _with(self, cold: DataFrame, hot: DataFrame | None) -> OrderedGroups:
        return OrderedGroups(cold, hot, self._keys, self._order, self._rows_per_split)

    def _running_hot(self, aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
        place = [*self._keys, _SPLIT]
        within = Window.partitionBy(*place).orderBy(*self._order)
        before = (Window.partitionBy(*self._keys).orderBy(_SPLIT)
                  .rowsBetween(Window.unboundedPreceding, -1))
        totals, carries, here, done = {}, {}, {}, {}
        for name, (how, value) in aggregates.items():
            totals[name] = _total(how, value, self._order)
            carries[name] = _CARRY[how](F.col(name)).over(before).alias(f"_carry_{name}")
            here[f"_here_{name}"] = _here(how, value, within)
            found = _COMBINE[how](F.col(f"_here_{name}"), F.col(f"_carry_{name}"))
            done[name] = found["it"] if how in _OF_A_ROW else found
        # One row per split, and computed now: steps that follow would repeat it.
        carry = written(
            self._hot.groupBy(*place).agg(*[t.alias(n) for n, t in totals.items()])
            .select(*place, *carries.values())
        )
        return (matching(self._hot.withColumns(here), carry, place, "inner")
                .withColumns(done).drop(*here, *[f"_carry_{n}" for n in aggregates]))

    def running(self, **aggregates: Aggregate) -> OrderedGroups:
        """Add aggregates from the group's first row to the current one.

        ``name=(how, column)``, where ``how`` is count, sum, min, max, first (null
        if the first row's is), previous (of the row before) or last (the last
        value that is not null). Sums of whole numbers and decimals are exact; a sum of
        doubles depends in its last digits on how a hot group is split.
        """
        aggregates = _columns(aggregates)
        ordered = Window.partitionBy(*self._keys).orderBy(*self._order)
        columns = {n: _here(how, value, ordered) for n, (how, value) in aggregates.items()}
        cold = self._cold.withColumns({
            n: c["it"] if aggregates[n][0] in _OF_A_ROW else c for n, c in columns.items()})
        return self._with(cold, self._running_hot(aggregates) if self.is_split else None)

    def frame(self, **columns: Frame) -> OrderedGroups:
        """Add window columns of bounded reach.

        For a hot group the windows run over pages of known length, each with the few
        rows of its neighbours that the frames reach. A frame that reaches farther than a
        split and than FARTHEST is refused, as a page would be more than a task's worth.
        """
        before = max(f.before for f in columns.values())
        after = max(f.after for f in columns.values())
        if max(before, after) > max(self._rows_per_split, FARTHEST):
            raise ValueError("a frame reaches too far; take differences of running sums")
        window = Window.partitionBy(*self._keys).orderBy(*self._order)
        cold = self._cold.withColumns({n: f.over(window) for n, f in columns.items()})
        if not self.is_split:
            return self._with(cold, None)

        length = max(self._rows_per_split, before, after, 1)
        offset = (F.col(_POS) - 1) % length
        wanted_by = F.array(
            F.col("_page"),
            F.when(offset >= length - before, F.col("_page") + 1),
            F.when((offset < after) & (F.col("_page") > 0), F.col("_page") - 1),
        )
        if _POS in self._hot.columns:
            numbered = self._hot
        else:
            numbered = self._running_hot({_POS: ("count", F.lit(1))})
        paged = (
            numbered.withColumn("_page", F.floor((F.col(_POS) - 1) / length))
            .withColumn("_at_page", F.explode(F.array_compact(wanted_by)))
        )
        page = Window.partitionBy(*self._keys, "_at_page").orderBy(_POS)
        hot = (paged.withColumns({n: f.over(page) for n, f in columns.items()})
               .where(F.col("_at_page") == F.col("_page"))
               .drop("_at_page", "_page"))
        return self._with(cold, hot)

    def total(self, **aggregates: Aggregate) -> OrderedGroups:
        """Add aggregates (count, sum, min or max) over the whole group to each row."""
        aggregates = _columns(aggregates)
        whole = Window.partitionBy(*self._keys)
        cold = self._cold.withColumns(
            {n: _AGGREGATE[how](value).over(whole) for n, (how, value) in aggregates.items()}
        )
        if not self.is_split:
            return self._with(cold, None)
        sums = written(self._hot.groupBy(*self._keys).agg(
            *[_AGGREGATE[how](value).alias(n) for n, (how, value) in aggregates.items()]
        ))
        return self._with(cold, matching(self._hot, sums, self._keys, "inner"))

    def rowwise(self, change: Callable[[DataFrame], DataFrame]) -> OrderedGroups:
        """Apply a change that looks at single rows (new columns, a filter)."""
        hot = change(self._hot).drop(_POS) if self.is_split else None
        return self._with(change(self._cold), hot)

    def rows(self) -> DataFrame:
        """All rows, those of hot groups included."""
        cold = self._cold.drop(_ALL)
        if not self.is_split:
            return cold
        return cold.unionByName(self._hot.select(*cold.columns))
