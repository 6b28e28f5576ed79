"""Joins that Spark's own equi-joins do not cover.

Plain equi-joins are left to Spark: it broadcasts a side only when its measured
size is under the threshold, and adaptive execution splits skewed partitions of
the inner, outer-on-the-skewed-side, semi and anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.ordered import broadcast_if_small, hot_groups, split_size, written

# A cell of two hot sides makes up to the square of its rows in pairs, so it is smaller
# than a split by this factor: 100,000 rows a side for the usual split.
CELLS_PER_SPLIT = 50
# An interval touches about so many buckets at most; longer ones take wider buckets.
MOST_BUCKETS = 1000
# How many widths there are; what is too long for the widest takes one bucket for all.
WIDTHS = 6


def _cuts(side: DataFrame, keys: Sequence[str], rows: int, name: str) -> DataFrame:
    """In how many parts the rows of each hot key are cut."""
    parts = F.ceil(F.col("_rows") / rows).alias(name)
    return broadcast_if_small(
        written(hot_groups(side.dropna(subset=list(keys)), keys, rows).select(*keys, parts)))


def _cut(df: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
    """A row gets one part of its own side's cuts and goes to all of the other side's."""
    return (
        df.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_left_cuts", "_right_cuts")})
        .withColumn(f"{own}_cell", F.pmod(F.xxhash64(row_id), F.col(f"{own}_cuts")))
        .withColumn(f"{other}_cell", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.col(f"{other}_cuts") - 1)))
        .drop("_left_cuts", "_right_cuts")
    )


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str,
              right_id: str, rows_per_cell: int | None = None) -> DataFrame:
    """Inner equi-join in which a key may be hot on either side or both.

    A key with more than ``rows_per_cell`` rows on a side is cut in that many
    parts by the row's id, and the other side's rows of this key go to every
    part. Two hot sides make a grid, each cell of which is a task's worth.
    Other keys take the join unchanged.
    """
    rows = rows_per_cell or max(1, split_size(left.sparkSession) // CELLS_PER_SPLIT)
    left_cuts = _cuts(left, keys, rows, "_left_cuts")
    right_cuts = _cuts(right, keys, rows, "_right_cuts")
    if left_cuts.isEmpty() and right_cuts.isEmpty():
        return left.join(right, list(keys))

    def cut(side: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        known = side.join(left_cuts, list(keys), "left").join(right_cuts, list(keys), "left")
        return _cut(known, row_id, own, other)

    cells = [*keys, "_left_cell", "_right_cell"]
    return (cut(left, left_id, "_left", "_right")
            .join(cut(right, right_id, "_right", "_left"), cells)
            .drop("_left_cell", "_right_cell"))


def band_join(intervals: DataFrame, points: DataFrame, keys: Sequence[str],
              interval_id: str, low: str, high: str, point_id: str, point: str,
              width: float, rows_per_cell: int | None = None) -> DataFrame:
    """Pairs of an interval and a point of its key inside it, both ends included.

    The axis is cut in buckets of ``width``, best about an interval's length: an
    interval goes to each bucket it touches and meets only the points of those,
    by equi-join. Use ``count_in_intervals`` where the pairs are only counted. An interval
    that touches more than MOST_BUCKETS takes buckets wider by a power of that number, and a
    still longer one, as one without an end, a single bucket. Points go to each width that
    intervals use, which a job finds first: write intervals that are costly to compute.
    """
    def bucket(column: str) -> Column:
        wide = F.lit(float(width)) * F.pow(F.lit(float(MOST_BUCKETS)), F.col("_width"))
        return F.when(F.col("_width") == WIDTHS, 0).otherwise(F.floor(F.col(column) / wide))

    length = (F.col(high).cast("double") - F.col(low).cast("double")) / width
    fitting = F.lit(WIDTHS)
    for level in reversed(range(WIDTHS)):
        fitting = F.when(length < float(MOST_BUCKETS) ** (level + 1), level).otherwise(fitting)
    known = intervals.where(F.col(low) <= F.col(high)).withColumn("_width", fitting)
    used = sorted(r[0] for r in known.select("_width").distinct().collect()) or [0]
    reached = known.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    widths = F.lit(used[0]) if len(used) == 1 else F.explode(F.array(*map(F.lit, used)))
    placed = points.withColumn("_width", widths).withColumn("_bucket", bucket(point))
    return (
        grid_join(reached, placed, [*keys, "_width", "_bucket"], interval_id, point_id,
                  rows_per_cell)
        .where(F.col(point).between(F.col(low), F.col(high)))
        .drop("_width", "_bucket")
    )
