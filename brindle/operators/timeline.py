"""Joins and sums along an ordered axis that never list the matching pairs.

Each is one ordered pass: the two sides are put on one axis, a running
aggregate is taken, and the rows that asked the question keep their answer.
The work is that of a sort, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    MapType,
    StringType,
    StructType,
    VariantType,
)

from brindle.operators.ordered import OrderedGroups


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str,
              left_id: str, right_columns: Sequence[str], right_id: str,
              rows_per_split: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its ``on``.

    Both sides carry ``keys`` and ``on``. Where several right rows share an
    instant, the one with the greatest ``right_id``, which is unique, is taken. Left
    rows without a match keep null ``right_columns``; null keys and instants match nothing.
    Only the id and right columns of fixed width go along the axis; others, such as
    texts, are fetched by the id.
    """
    kept = [c for c in left.columns if c not in {*keys, on}]
    wide = [c for c in right_columns
            if isinstance(right.schema[c].dataType, (StringType, BinaryType, ArrayType, MapType,
                                                     StructType, VariantType))]
    slim = [c for c in right_columns if c not in wide]
    asked = left.select(
        *keys, on, F.lit(1).alias("_asks"), F.col(left_id).alias("_tie"),
        F.struct(*kept).alias("_left"),
    )
    given = right.dropna(subset=[*keys, on]).select(
        *keys, on, F.lit(0).alias("_asks"), F.col(right_id).alias("_tie"),
        F.struct(*slim, F.col(right_id).alias("_right_id")).alias("_right"),
    )
    axis = asked.unionByName(given, allowMissingColumns=True)
    matched = (
        OrderedGroups.of(axis, keys, [on, "_asks", "_tie"], rows_per_split)
        .running(_found=("last", "_right"))
        .rows()
        .where(F.col("_asks") == 1)
        .select(*keys, on, *[F.col(f"_left.{c}").alias(c) for c in kept],
                *[F.col(f"_found.{c}").alias(c) for c in slim],
                F.col("_found._right_id").alias("_right_id"))
    )
    if wide:
        fetched = right.dropna(subset=[*keys, on]).select(
            F.col(right_id).alias("_right_id"), *wide)
        matched = matched.join(fetched, "_right_id", "left")
    return matched.select(*keys, on, *kept, *right_columns)


def count_in_intervals(intervals: DataFrame, points: DataFrame, keys: Sequence[str],
                       interval_id: str, low: str, high: str, point: str,
                       name: str = "n_points",
                       rows_per_split: int | None = None) -> DataFrame:
    """How many points of its key lie in each interval, both ends included.

    Points up to the high end less points before the low end. Returns
    ``interval_id`` and the count for every interval. Null keys, points and ends
    match nothing, as in a join on BETWEEN.
    """
    points = points.dropna(subset=[*keys, point])
    # Equal points become one row first, so copies of a point cost nothing.
    counted = (points.groupBy(*keys, F.col(point).alias("_at"))
               .agg(F.count(F.lit(1)).alias("_n")))
    on_axis = counted.withColumn("_kind", F.lit(1))
    # an interval that is empty or lacks an end has both ends before all points
    real = F.col(low) <= F.col(high)
    ends = intervals.select(
        *keys, F.col(interval_id).alias("_id"),
        F.explode(F.array(
            F.struct(F.when(real, F.col(low)).alias("_at"), F.lit(0).alias("_kind")),
            F.struct(F.when(real, F.col(high)).alias("_at"), F.lit(2).alias("_kind")),
        )).alias("_end"),
    ).select(*keys, "_id", "_end.*")
    axis = ends.unionByName(on_axis, allowMissingColumns=True)
    at_most = ends.select(*keys, "_at").union(points.select(*keys, point))
    return (
        OrderedGroups.of(axis, keys, ["_at", "_kind", "_id"], rows_per_split, at_most)
        .running(_upto=("sum", "_n"))
        .rows()
        .where(F.col("_kind") != 1)
        .groupBy(F.col("_id").alias(interval_id))
        .agg(F.sum(F.coalesce("_upto", F.lit(0)) * (F.col("_kind") - 1)).alias(name))
    )


def trailing_sums(df: DataFrame, keys: Sequence[str], at: str, reach: Column,
                  sums: dict[str, Column],
                  rows_per_split: int | None = None) -> DataFrame:
    """Sums over the rows of the last ``reach`` (an interval), for every instant of a key.

    One row per key and instant, covering [instant - reach, instant]. A row
    counts when it comes and is taken off after ``reach``, so give whole numbers: a
    difference of float sums is not exact. Nulls add nothing.
    """
    instants = df.groupBy(*keys, at).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(n) for n, c in sums.items()])
    comes = F.struct(F.col(at), F.lit(0).alias("_leaves"), *sums)
    leaves = F.struct((F.col(at) + reach).alias(at), F.lit(1).alias("_leaves"),
                      *[(-F.col(n)).alias(n) for n in sums])
    steps = F.explode(F.array(comes, leaves)).alias("_step")
    axis = instants.select(*keys, steps).select(*keys, "_step.*")
    at_most = df.select(*keys, F.explode(F.array(F.lit(0), F.lit(1))))
    return (
        OrderedGroups.of(axis, keys, [at, "_leaves"], rows_per_split, at_most)
        .running(**{f"_{n}": ("sum", n) for n in sums})
        .rows()
        .where(F.col("_leaves") == 0)
        .select(*keys, at, *[F.col(f"_{n}").alias(n) for n in sums])
    )


def sessions(df: DataFrame, keys: Sequence[str], at: str, unique: str, gap: Column,
             sums: dict[str, Column], rows_per_split: int | None = None) -> DataFrame:
    """Runs of a key's rows with no more than ``gap`` (an interval) between neighbours.

    Returns keys, session_start, session_end (the last row's instant), n_rows
    and the sums. A hot key is split like any ordered group, where Spark's batch
    ``session_window`` would send it to one task.
    """
    needed = df.select(*keys, at, unique, *[c.alias(f"_{n}") for n, c in sums.items()])
    numbered = (
        OrderedGroups.of(needed, keys, [at, unique], rows_per_split)
        .running(_prev=("previous", at))
        .rowwise(lambda d: d.withColumn(
            "_starts",
            F.when(F.col("_prev").isNull() | (F.col(at) > F.col("_prev") + gap), 1)))
        .running(_session=("count", "_starts"))
        .rows()
    )
    return numbered.groupBy(*keys, "_session").agg(
        F.min(at).alias("session_start"), F.max(at).alias("session_end"),
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(f"_{n}").alias(n) for n in sums],
    ).drop("_session")
