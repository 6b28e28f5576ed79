"""Queries that depend on the order of rows: windows, ranks, top rows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import hundredths
from brindle.operators import (
    Frame,
    OrderedGroups,
    largest_per_group,
    rank_rows,
    sessions,
    trailing_sums,
)
from brindle.operators.ordered import written
from brindle.plans.registry import Plans
from brindle.sources import Tables

plans = Plans()


@plans("""
SELECT event_id, user_id,
       lag(event_type) OVER w AS previous_type,
       lead(event_type) OVER w AS next_type,
       first_value(event_type) OVER w AS first_type,
       lag(ts, 2) OVER w AS ts_two_before
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def event_neighbours(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "user_id", "event_type", "ts")
    return (
        OrderedGroups.of(events, ["user_id"], ["ts", "event_id"])
        .running(first_type=("first", "event_type"))
        .frame(
            previous_type=Frame.lag("event_type"),
            next_type=Frame.lead("event_type"),
            ts_two_before=Frame.lag("ts", 2),
        )
        .rows()
        .select("event_id", "user_id", "previous_type", "next_type", "first_type",
                "ts_two_before")
    )


@plans("""
SELECT o_orderkey, o_orderpriority,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)
         AS row_num,
       rank() OVER w AS rank,
       dense_rank() OVER w AS dense_rank,
       percent_rank() OVER w AS percent_rank,
       ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS tile
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)
""")
def order_date_ranks(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    return rank_rows(orders, ["o_orderpriority"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@plans("""
SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) AS rank,
       percent_rank() OVER (ORDER BY o_totalprice) AS percent_rank
FROM orders
""")
def global_price_ranks(t: Tables) -> DataFrame:
    # No partition key: past one split's size the whole table is split.
    return rank_rows(t.orders.select("o_orderkey", "o_totalprice"), [], "o_totalprice",
                     "o_orderkey").select("o_orderkey", "rank", "percent_rank")


@plans("""
SELECT event_id, user_id,
       round(avg(value) OVER w, 6) AS mean_of_seven,
       max(value) OVER w AS max_of_seven
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")
def moving_averages(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "user_id", "value", "ts")
    return (
        OrderedGroups.of(events, ["user_id"], ["ts", "event_id"])
        .frame(
            mean_of_seven=Frame.rows(F.avg("value"), -6, 0),
            max_of_seven=Frame.rows(F.max("value"), -6, 0),
        )
        .rows()
        .select("event_id", "user_id", F.round("mean_of_seven", 6).alias("mean_of_seven"),
                "max_of_seven")
    )


@plans("""
SELECT DISTINCT user_id, ts,
       count(*) OVER w AS n_in_day,
       CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) AS value_in_day
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts
             RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)
""")
def trailing_day(t: Tables) -> DataFrame:
    return trailing_sums(
        t.events, ["user_id"], "ts", F.expr("interval 24 hours"),
        {"n_in_day": F.lit(1), "value_in_day": hundredths("value")},
    ).withColumn("value_in_day", F.col("value_in_day") / 100)


@plans("""
SELECT event_id, user_id,
       count(*) OVER w AS n_so_far,
       CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) AS value_so_far,
       min(value) OVER w AS min_so_far
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def running_totals(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "user_id", "value", "ts")
    return (
        OrderedGroups.of(events, ["user_id"], ["ts", "event_id"])
        .running(n_so_far=("count", F.lit(1)), value_so_far=("sum", hundredths("value")),
                 min_so_far=("min", "value"))
        .rows()
        .select("event_id", "user_id", "n_so_far",
                (F.col("value_so_far") / 100).alias("value_so_far"), "min_so_far")
    )


@plans("""
SELECT * FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         CAST(row_number() OVER (PARTITION BY o_custkey
                                 ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place
  FROM orders)
WHERE place <= 3
""")
def top_orders_per_customer(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return largest_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")],
                             3)


@plans("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 20
""")
def largest_orders(t: Tables) -> DataFrame:
    # Each task keeps its own first rows; no full sort.
    return (
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(100)
    )


@plans("""
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_rows,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total
FROM (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                  AS session
      FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                    + INTERVAL 6 HOUR, true) AS starts
            FROM events))
GROUP BY user_id, session
""")
def user_sessions(t: Tables) -> DataFrame:
    return sessions(
        t.events, ["user_id"], "ts", "event_id", F.expr("interval 6 hours"),
        {"total": hundredths("value")},
    ).withColumn("total", F.col("total") / 100)


PAGE = 4


@plans(f"""
SELECT conv_id, CAST(floor((pos - 1) / {PAGE}) AS BIGINT) AS page,
       CAST(count(*) AS INT) AS n_turns,
       string_agg(role || ': ' || text, ' | ' ORDER BY turn) AS turns
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
      FROM conversations)
GROUP BY ALL
""")
def conversation_pages(t: Tables) -> DataFrame:
    # An ordered array per page of turns: a conversation of any length is kept
    # whole, and no array grows with it.
    # The turns are numbered without their texts, so that a split's size does not depend
    # on them. The texts come back by a number that is written first: turns may be repeated.
    told = written(t.conversations.withColumn("row", F.monotonically_increasing_id()))
    numbered = (
        OrderedGroups.of(told.select("conv_id", "turn", "row"), ["conv_id"], ["turn", "row"])
        .running(pos=("count", F.lit(1))).rows().select("row", "pos")
    )
    placed = told.join(numbered, "row")
    said = F.struct("turn", F.concat_ws(": ", "role", "text").alias("said"))
    return (
        placed.groupBy("conv_id", F.floor((F.col("pos") - 1) / PAGE).alias("page"))
        .agg(F.array_sort(F.collect_list(said)).alias("found"))
        .select("conv_id", "page", F.size("found").alias("n_turns"),
                F.array_join("found.said", " | ").alias("turns"))
    )
