"""Ranks, exact quantiles and the largest rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.ordered import (
    OrderedGroups,
    hot_groups,
    matching,
    split_size,
    written,
)


def _by_windows(df: DataFrame, keys: Sequence[str], by: str, unique: str) -> DataFrame:
    rows = Window.partitionBy(*keys).orderBy(by, unique)
    values = Window.partitionBy(*keys).orderBy(by)
    # the longer order first: the rows are then sorted for the other windows too
    return df.withColumn("row_num", F.row_number().over(rows).cast("bigint")).withColumns({
        "rank": F.rank().over(values).cast("bigint"),
        "dense_rank": F.dense_rank().over(values).cast("bigint"),
        "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
    })


def _by_values(df: DataFrame, keys: Sequence[str], by: str, unique: str,
               rows_per_split: int) -> DataFrame:
    """The same for hot groups, whose different values are placed first.

    A value's rows need no more than its place and their own order. The place comes as a row
    of its own, ahead of them: one shuffle and one sort, by key and value, and no join. Only a
    value that is hot itself is split.
    """
    counts = written(df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_rows")))
    placed = written(
        OrderedGroups.of(counts.withColumnRenamed("_rows", "_same"), keys, [by], rows_per_split)
        .running(_upto=("sum", "_same"), dense_rank=("count", F.lit(1)))
        .total(_n=("sum", "_same"))
        .rows()
        .select(*keys, by, F.struct(
            (F.col("_upto") - F.col("_same")).alias("before"), "dense_rank", "_n").alias("_value"))
    )
    both = df.withColumn("_row", F.lit(1)).unionByName(
        placed.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    numbered = (
        OrderedGroups.of(both, [*keys, by], ["_row", unique], rows_per_split, counts=counts)
        .running(_nth=("sum", "_row"), _placed=("first", "_value"))
        .rows().where("_row = 1")
    )
    return numbered.withColumns({
        "row_num": F.col("_placed.before") + F.col("_nth"),
        "rank": F.col("_placed.before") + 1,
        "dense_rank": F.col("_placed.dense_rank"),
        "_n": F.col("_placed._n"),
    }).drop("_row", "_nth", "_value", "_placed")


def rank_rows(df: DataFrame, keys: Sequence[str], by: str, unique: str,
              tiles: int = 4, rows_per_split: int | None = None) -> DataFrame:
    """Add row_num, rank, dense_rank, percent_rank and tile, ascending by ``by``.

    ``unique`` tells rows with equal ``by`` apart. Every measure follows from the
    row's position, the position at which its value starts, and the group's
    size, which are all known for a hot group too. Whole numbers are bigint, as a group
    may have more rows than an int counts.
    """
    rows_per_split = rows_per_split or split_size(df.sparkSession)
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("_whole", F.lit(0)), ["_whole"]
    groups = written(hot_groups(df, keys, rows_per_split))
    if groups.isEmpty():
        ranked = _by_windows(df, keys, by, unique)
    else:
        cold = _by_windows(matching(df, groups, keys, "left_anti"), keys, by, unique)
        hot = _by_values(matching(df, groups, keys, "left_semi"), keys, by, unique,
                         rows_per_split)
        ranked = cold.unionByName(hot)
    # tiles differ by one row at most, the larger ones first
    small, extra = F.floor(F.col("_n") / tiles), F.col("_n") % tiles
    in_large = extra * (small + 1)
    zero_based = F.col("row_num") - 1
    tile = F.when(zero_based < in_large, F.floor(zero_based / (small + 1))).otherwise(
        extra + F.floor((zero_based - in_large) / F.greatest(small, F.lit(1))))
    percent = F.when(F.col("_n") > 1, (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return ranked.withColumns({
        "tile": (tile + 1).cast("bigint"),
        "percent_rank": percent,
    }).drop("_n", "_whole")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    quantiles: dict[str, float],
                    rows_per_split: int | None = None) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours as ``percentile`` does.

    Equal values are counted before the shuffle, and no group's values meet in
    one task: the value at a position is found from running counts.
    """
    known = df.where(F.col(value).isNotNull())
    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_same"))
    placed = (
        OrderedGroups.of(counted, keys, [value], rows_per_split, at_most=known)
        .running(_upto=("sum", "_same"))
        .total(_n=("sum", "_same"))
        .rows()
    )

    def at(position: Column) -> Column:
        found = (position >= F.col("_upto") - F.col("_same")) & (position < F.col("_upto"))
        return F.max(F.when(found, F.col(value)))

    picked = []
    for name, q in quantiles.items():
        exact = F.lit(q) * (F.col("_n") - 1)
        low = F.floor(exact)
        picked += [
            at(low).alias(f"_{name}_low"),
            at(F.ceil(exact)).alias(f"_{name}_high"),
            F.max(exact - low).alias(f"_{name}_part"),
        ]
    return placed.groupBy(*keys).agg(*picked).select(*keys, *[
        (F.col(f"_{n}_low") + F.col(f"_{n}_part")
         * (F.col(f"_{n}_high") - F.col(f"_{n}_low"))).alias(n)
        for n in quantiles
    ])


def largest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                      k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each group in ``order``.

    Spark cuts each map task's rows to ``k`` per group before the shuffle (its
    WindowGroupLimit), so a hot group sends k rows per task, not all of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
