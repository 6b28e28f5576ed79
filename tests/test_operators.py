"""Operators against Spark's own windows or brute force, with groups whole and split."""

from __future__ import annotations

import bisect
import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import (
    Frame,
    OrderedGroups,
    asof_join,
    band_join,
    count_in_intervals,
    exact_quantiles,
    grid_join,
    intersection,
    largest_per_group,
    rank_rows,
    sessions,
    surplus,
    trailing_sums,
    with_totals,
)

WHOLE, SPLIT = 10**6, 7
BOTH = pytest.mark.parametrize("rows_per_split", [WHOLE, SPLIT])
DAY = dt.datetime(2024, 1, 1)


def listed(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    """(k, g, v, x, id): a key with most of the rows, small keys, null keys, ties, nulls."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        k = None if i % 11 == 0 else (1 if i % 3 else rng.randrange(2, 30))
        x = None if rng.random() < 0.3 else rng.randrange(100)
        rows.append((k, rng.choice("ab"), rng.randrange(25), x, i))
    rng.shuffle(rows)
    return spark.createDataFrame(
        rows, "k bigint, g string, v bigint, x bigint, id bigint").repartition(3).cache()


@BOTH
@pytest.mark.parametrize("keys", [["k"], ["k", "g"], []])
def test_running_frames_and_totals_equal_plain_windows(table, keys, rows_per_split):
    groups = OrderedGroups.of(table, keys, ["v", "id"], rows_per_split)
    assert groups.is_split == (rows_per_split == SPLIT)
    found = (
        groups.running(n=("count", F.lit(1)), some=("count", "x"), s=("sum", "x"),
                       lo=("min", "x"), hi=("max", "x"), seen=("last", "x"),
                       opened=("first", "x"), prev=("previous", "x"))
        .frame(back=Frame.lag("x", 9), ahead=Frame.lead("x", 8),
               near=Frame.rows(F.sum("x"), -3, 5))
        .total(most=("max", "x"), rows=("count", F.lit(1)))
        .rows()
    )
    by = [F.col(k) for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*by).orderBy("v", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    expected = table.withColumns({
        "n": F.count(F.lit(1)).over(upto), "some": F.count("x").over(upto),
        "s": F.sum("x").over(upto), "lo": F.min("x").over(upto), "hi": F.max("x").over(upto),
        "seen": F.last("x", ignorenulls=True).over(upto), "opened": F.first("x").over(upto),
        "prev": F.lag("x").over(w),
        "back": F.lag("x", 9).over(w), "ahead": F.lead("x", 8).over(w),
        "near": F.sum("x").over(w.rowsBetween(-3, 5)),
        "most": F.max("x").over(whole), "rows": F.count(F.lit(1)).over(whole),
    })
    assert found.columns == expected.columns
    assert listed(found) == listed(expected)


@BOTH
def test_steps_can_follow_each_other(table, rows_per_split):
    found = (
        OrderedGroups.of(table, ["k"], ["v", "id"], rows_per_split)
        .frame(prev=Frame.lag("v"))
        .rowwise(lambda d: d.withColumn("new", F.when(~F.col("v").eqNullSafe(F.col("prev")), 1)))
        .running(block=("count", "new"))
        .frame(prev_block=Frame.lag("block", 2))
        .rowwise(lambda d: d.where(F.col("v") > 3))
        .rows().select("id", "block", "prev_block")
    )
    w = Window.partitionBy("k").orderBy("v", "id")
    expected = (
        table.withColumn("block", F.dense_rank().over(Window.partitionBy("k").orderBy("v")))
        .withColumn("prev_block", F.lag("block", 2).over(w)).where("v > 3")
        .select("id", "block", "prev_block")
    )
    assert listed(found) == listed(expected)


def test_a_frame_knows_its_reach(spark):
    rows = spark.range(60).select(F.lit(1).alias("k"), "id", (F.col("id") ** 2).alias("v"))
    sums = [OrderedGroups.of(rows, ["k"], ["id"], size)
            .frame(s=Frame.rows(F.sum("v"), -5, 0)).rows().agg(F.sum("s")).first()[0]
            for size in (100, 10)]
    assert sums[0] == sums[1]
    with pytest.raises(ValueError, match="too far"):
        OrderedGroups.of(rows, ["k"], ["id"], 10).frame(s=Frame.lag("v", 10 ** 6))


def test_names_that_are_used_inside_are_refused(spark):
    with pytest.raises(ValueError, match="_split"):
        OrderedGroups.of(spark.range(1).withColumn("_split", F.lit(1)), [], ["id"])


def test_small_tables_are_joined_alike_without_broadcast(table, monkeypatch):
    def ranked():
        return listed(rank_rows(table, ["k"], "v", "id", 4, SPLIT).select("id", "rank", "tile"))
    with_hint = ranked()
    monkeypatch.setattr("brindle.operators.ordered.BROADCAST_ROWS", 0)
    assert ranked() == with_hint
    monkeypatch.setattr("brindle.operators.ordered.BROADCAST_ROWS", 200_000)
    monkeypatch.setattr("brindle.operators.ordered.BROADCAST_BYTES", 0)
    assert ranked() == with_hint


def test_no_rows(table):
    empty = table.where("id < 0")
    assert OrderedGroups.of(empty, ["k"], ["id"], SPLIT).running(n=("count", "id")).rows(
    ).count() == 0
    assert exact_quantiles(empty, ["k"], "x", {"m": 0.5}, SPLIT).count() == 0


@BOTH
@pytest.mark.parametrize("tiles", [1, 4, 1000])
def test_ranks(table, rows_per_split, tiles):
    w, full = Window.partitionBy("k").orderBy("v"), Window.partitionBy("k").orderBy("v", "id")
    expected = table.select(
        "id", F.row_number().over(full).alias("row_num"), F.rank().over(w).alias("rank"),
        F.dense_rank().over(w).alias("dense_rank"),
        F.percent_rank().over(w).alias("percent_rank"), F.ntile(tiles).over(full).alias("tile"))
    found = rank_rows(table, ["k"], "v", "id", tiles, rows_per_split).select(expected.columns)
    assert listed(found) == listed(expected)
    # counts beyond 2^31 must fit
    assert {t for n, t in found.dtypes if n not in ("id", "percent_rank")} == {"bigint"}


@BOTH
def test_quantiles(table, rows_per_split):
    found = exact_quantiles(table, ["k"], "x", {"low": 0.1, "mid": 0.5, "top": 1.0},
                            rows_per_split)
    values = {}
    for r in table.where("x is not null").collect():
        values.setdefault(r.k, []).append(r.x)
    assert found.count() == len(values)
    for r in found.collect():
        assert np.allclose([r.low, r.mid, r.top], np.percentile(values[r.k], [10, 50, 100]))


def test_largest_per_group(table):
    found = largest_per_group(table, ["k"], [F.desc("v"), F.asc("id")], 3)
    rows = sorted(table.collect(), key=lambda r: (repr(r.k), -r.v, r.id))
    expected = [(r.k, r.id, i + 1) for _, group in itertools.groupby(rows, lambda r: repr(r.k))
                for i, r in enumerate(itertools.islice(group, 3))]
    assert listed(found.select("k", "id", "place")) == sorted(expected, key=repr)


def in_time(table):
    at = (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("v"))).alias("at")
    return table.select("k", at, "x", "id")


@BOTH
def test_asof(table, rows_per_split):
    timed = in_time(table).withColumn("at", F.when(F.col("id") % 17 > 0, F.col("at")))
    asked = timed.where("id % 2 = 0").select("k", "at", "id")
    given = timed.where("id % 2 = 1").select("k", "at", F.col("id").alias("g_id"), "x")
    found = asof_join(asked, given, ["k"], "at", "id", ["g_id", "x"], "g_id", rows_per_split)
    facts = given.collect()
    expected = []
    for a in asked.collect():
        known = [g for g in facts if g.k == a.k is not None and a["at"] and g["at"]
                 and g["at"] <= a["at"]]
        best = max(known, key=lambda g: (g["at"], g.g_id), default=None)
        expected.append((a.k, a["at"], a.id, best and best.g_id, best and best.x))
    assert found.columns == ["k", "at", "id", "g_id", "x"]
    assert listed(found) == sorted(expected, key=repr)
    # wide columns are not carried but fetched
    named = given.withColumn("text", F.concat(F.lit("row "), F.col("g_id")))
    found = asof_join(asked, named, ["k"], "at", "id", ["text", "x"], "g_id", rows_per_split)
    assert listed(found) == sorted(
        ((k, at, i, g and f"row {g}", x) for k, at, i, g, x in expected), key=repr)


@BOTH
@pytest.mark.parametrize("keys", [["k"], []])
def test_counts_in_intervals(table, keys, rows_per_split):
    # some empty, some with a null end
    intervals = table.where("id % 4 = 0").select(
        "k", "id", F.when(F.col("id") % 28 > 0, F.col("v") - 2).alias("low"),
        F.when(F.col("id") % 36 > 0, F.col("v") + F.col("id") % 9 - 4).alias("high"))
    points = table.select("k", F.col("x").alias("p"))
    found = count_in_intervals(intervals, points, keys, "id", "low", "high", "p", "n",
                               rows_per_split)
    pts = points.collect()
    expected = [
        (i.id, sum(
            None not in (i.low, p.p, i.high) and i.low <= p.p <= i.high
            and (not keys or p.k == i.k is not None) for p in pts))
        for i in intervals.collect()
    ]
    assert listed(found) == sorted(expected, key=repr)


@BOTH
def test_trailing_sums(table, rows_per_split):
    found = trailing_sums(in_time(table), ["k"], "at", F.expr("interval 3 hours"),
                          {"n": F.lit(1), "s": F.col("x")}, rows_per_split)
    rows = in_time(table).collect()
    expected = set()
    for r in rows:
        near = [o for o in rows
                if o.k == r.k and dt.timedelta(0) <= r["at"] - o["at"] <= dt.timedelta(hours=3)]
        expected.add((r.k, r["at"], len(near), sum(o.x or 0 for o in near)))
    assert listed(found) == sorted(expected, key=repr)


@BOTH
def test_sessions(table, rows_per_split):
    timed = in_time(table)
    found = sessions(timed, ["k"], "at", "id", F.expr("interval 1 hour"), {"s": F.lit(2)},
                     rows_per_split)
    by_key = {}
    for r in timed.collect():
        by_key.setdefault(r.k, []).append(r["at"])
    expected = []
    for k, times in by_key.items():
        times.sort()
        cuts = [i for i in range(1, len(times))
                if times[i] - times[i - 1] > dt.timedelta(hours=1)]
        for a, b in itertools.pairwise([0, *cuts, len(times)]):
            expected.append((k, times[a], times[b - 1], b - a, 2 * (b - a)))
    assert listed(found) == sorted(expected, key=repr)


@BOTH
@pytest.mark.parametrize("width", [1.0, 4.0, 1000.0])
def test_band_join(table, rows_per_split, width):
    bands = table.where("id % 5 = 0").select(
        "g", F.col("id").alias("i"), (F.col("v") - 1).alias("low"), (F.col("v") + 1).alias("high"))
    points = table.where("x is not null").select("g", F.col("id").alias("p"), "x")
    found = band_join(bands, points, ["g"], "i", "low", "high", "p", "x", width,
                      rows_per_split).select("i", "p")
    pts = points.collect()
    expected = [(b.i, p.p) for b in bands.collect() for p in pts
                if b.g == p.g and b.low <= p.x <= b.high]
    assert listed(found) == sorted(expected, key=repr)


@BOTH
def test_grid_join_with_both_sides_hot(table, rows_per_split):
    left = table.select("k", F.col("id").alias("a"))
    right = table.where("v < 8").select("k", F.col("id").alias("b"))
    found = grid_join(left, right, ["k"], "a", "b", rows_per_split)
    assert listed(found.select("k", "a", "b")) == listed(left.join(right, "k"))


def test_grid_join_without_broadcast(table, monkeypatch):
    monkeypatch.setattr("brindle.operators.ordered.BROADCAST_ROWS", 0)
    left = table.select("k", F.col("id").alias("a"))
    found = grid_join(left, left.withColumnRenamed("a", "b"), ["k"], "a", "b", SPLIT)
    assert found.count() == left.join(left, "k").count()


@BOTH
def test_totals(table, rows_per_split):
    found = with_totals(table, ["k"], {"s": F.sum("x"), "n": F.count("x")}, rows_per_split)
    whole = Window.partitionBy("k")
    expected = table.withColumns({"s": F.sum("x").over(whole), "n": F.count("x").over(whole)})
    assert listed(found) == listed(expected)


def test_intersection_with_nulls_and_repeats(table):
    left, right = table.where("id < 150").select("k", "g"), table.where("id > 90").select("k", "g")
    assert listed(intersection(left, right)) == listed(left.intersect(right))


def test_surplus_with_nulls_and_repeats(table):
    left, right = table.select("k", "g"), table.where("id > 90").select("k", "g")
    wanted = listed(left.exceptAll(right))
    assert wanted and listed(surplus(left, right)) == wanted
    assert listed(surplus(left, right, copies_per_row=3)) == wanted
    hot = left.sparkSession.range(100_000).select(F.lit(7).alias("k"), F.lit("x").alias("g"))
    found = surplus(hot, right, copies_per_row=1000)
    assert found.count() == 100_000
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert "ReplicateRows" not in found._jdf.queryExecution().toString().lower()


@BOTH
def test_band_join_of_intervals_of_all_lengths(spark, rows_per_split):
    inf = float("inf")
    ends = [(-5.0, 1e4), (3.0, 2e7), (-1e12, 4.0), (5.0, 5.0), (0.0, 1e20), (-inf, 0.0), (7.0, inf),
            (-inf, inf), (2.0, 1.0), (None, 3.0), (inf, inf), (999.0, 1999.0), (1e15, 1e15 + 2500)]
    values = [-1e13, -5.0, 0.0, 4.0, 5.0, 7.5, 1e4, 1e4 + 1, 2e7, 1e15 + 1, 1e19, inf, None]
    wide = spark.createDataFrame([(1, i, *e) for i, e in enumerate(ends)],
                                 "g int, i long, low double, high double")
    points = spark.createDataFrame([(1, p, x) for p, x in enumerate(values)],
                                   "g int, p long, x double")
    found = band_join(wide, points, ["g"], "i", "low", "high", "p", "x", 1.0, rows_per_split)
    assert listed(found.select("i", "p")) == sorted(
        ((i, p) for i, (low, high) in enumerate(ends) for p, x in enumerate(values)
         if None not in (low, x) and low <= x <= high), key=repr)


def test_brute_force_helper_agrees_with_a_sorted_search(table):
    # guards the interval test's own expectation on one key
    points = sorted(r.x for r in table.where("k = 1 and x is not null").collect())
    intervals = table.where("k = 1 and id % 4 = 0").select(
        "k", "id", (F.col("v") - 2).alias("low"), (F.col("v") + 3).alias("high"))
    found = count_in_intervals(intervals, table.where("x is not null"), ["k"], "id", "low",
                               "high", "x", "n", SPLIT)
    counts = {r.id: r.n for r in found.collect()}
    for i in intervals.collect():
        assert counts[i.id] == bisect.bisect_right(points, i.high) - bisect.bisect_left(
            points, i.low)


def test_a_frame_tells_how_far_it_looks():
    with pytest.raises(TypeError, match="Frame.rows"):
        Frame(0, 1, lambda w: F.sum("x").over(w.rowsBetween(-5, 0)))
    assert (Frame.rows(F.lit(1), -5, 0).before, Frame.lead("x", 2).after) == (5, 2)
