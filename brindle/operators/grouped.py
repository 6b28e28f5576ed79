"""Group totals on every row, and set operations by grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.ordered import hot_groups, matching, split_size, written


def with_totals(df: DataFrame, keys: Sequence[str], totals: dict[str, Column],
                rows_per_split: int | None = None) -> DataFrame:
    """Each row with aggregates over its whole group, such as ``F.sum("x")``.

    The rows of a hot group are not moved: the totals of hot groups, of which
    there are at most rows / rows_per_split, are sent to them. Totals of doubles depend in
    their last digits on the order of addition.
    """
    groups = written(hot_groups(df, keys, rows_per_split or split_size(df.sparkSession)))
    whole = Window.partitionBy(*keys)

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({n: total.over(whole) for n, total in totals.items()})

    if groups.isEmpty():
        return windowed(df)
    hot = matching(df, groups.select(*keys), keys, "left_semi")
    hot_totals = written(
        hot.groupBy(*keys).agg(*[total.alias(n) for n, total in totals.items()]))
    return windowed(matching(df, groups, keys, "left_anti")).unionByName(
        matching(hot, hot_totals, keys, "inner"))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows in both, nulls being equal, by one grouping.

    Repeats are dropped in the map tasks and each side is shuffled once, where
    ``intersect`` shuffles for a join after it has shuffled to drop repeats.
    """
    sides = left.withColumn("_side", F.lit(1)).union(right.withColumn("_side", F.lit(2)))
    return (sides.groupBy(*left.columns).agg(F.bit_or("_side").alias("_sides"))
            .where(F.col("_sides") == 3).drop("_sides"))


def surplus(left: DataFrame, right: DataFrame, copies_per_row: int = 10_000) -> DataFrame:
    """The rows of ``left`` beyond as many equal rows of ``right``, nulls being equal.

    Equal rows are counted in the map tasks. What is left of a row is written out in three
    steps: as blocks of chunks, as chunks, and as copies. Blocks and chunks are dealt out anew, so
    that the copies of a hot row are made by many tasks, and no list is longer than
    ``copies_per_row``, or the copies over its square.
    """
    both = left.withColumn("_sign", F.lit(1)).union(right.withColumn("_sign", F.lit(-1)))
    found = both.groupBy(*left.columns).agg(F.sum("_sign").alias("_n")).where("_n > 0")
    # a given number: by the size of the pieces' rows Spark would join the partitions again
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for size in (copies_per_row ** 2, copies_per_row):
        at, most = F.col("_piece"), F.lit(size).cast("bigint")
        found = (found.withColumn("_piece", F.explode(F.expr(f"sequence(0L, (_n - 1) div {size})")))
                 .repartition(parts, *left.columns, "_piece")
                 .withColumn("_n", F.least(most, F.col("_n") - at * most)))
    return (found.withColumn("_copy", F.explode(F.expr("sequence(1L, _n)")))
            .select(*left.columns))
