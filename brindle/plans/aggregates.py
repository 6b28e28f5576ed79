"""Grouped aggregation. Every one sums up inside the map tasks before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import charged, discounted, exact_sum, hundredths, money
from brindle.operators import exact_quantiles
from brindle.plans.registry import Plans
from brindle.sources import Tables

plans = Plans()


@plans("""
SELECT l_returnflag, l_linestatus,
       CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE) AS sum_disc_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l_discount AS DECIMAL(3,2)))
                * (1 + CAST(l_tax AS DECIMAL(3,2)))) AS DOUBLE) AS sum_charge,
       round(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*), 6) AS avg_qty,
       round(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / count(*), 6)
         AS avg_price,
       count(*) AS n_lines
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(t: Tables) -> DataFrame:
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            money(exact_sum(hundredths("l_quantity"), 2)).alias("sum_qty"),
            money(exact_sum(hundredths("l_extendedprice"), 2)).alias("sum_base_price"),
            money(exact_sum(discounted(), 4)).alias("sum_disc_price"),
            money(exact_sum(charged(), 6)).alias("sum_charge"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        .withColumns({
            "avg_qty": F.round(F.col("sum_qty") / F.col("n_lines"), 6),
            "avg_price": F.round(F.col("sum_base_price") / F.col("n_lines"), 6),
        })
    )


@plans("""
SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_nations,
       count(*) FILTER (c_acctbal < 0) AS n_in_debt, count(*) AS n_customers
FROM customer GROUP BY c_mktsegment
""")
def segment_counts(t: Tables) -> DataFrame:
    # Spark counts distinct values in two steps, so no group's values meet in one set.
    return t.customer.groupBy("c_mktsegment").agg(
        F.countDistinct("c_nationkey").alias("n_nations"),
        F.count_if(F.col("c_acctbal") < 0).alias("n_in_debt"),
        F.count(F.lit(1)).alias("n_customers"),
    )


@plans("""
SELECT l_returnflag, l_linestatus,
       CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
       count(*) AS n_lines
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def quantity_rollup(t: Tables) -> DataFrame:
    # Rolling up the finest groups copies a few rows, not every line.
    finest = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum(hundredths("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n"))
    return finest.rollup("l_returnflag", "l_linestatus").agg(
        money(F.sum("qty")).alias("sum_qty"), F.sum("n").alias("n_lines"))


@plans("""
SELECT o_orderstatus, o_orderpriority,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
       count(*) AS n_orders
FROM orders
GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())
""")
def order_grouping_sets(t: Tables) -> DataFrame:
    by, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    finest = t.orders.groupBy(by, priority).agg(
        exact_sum(hundredths("o_totalprice"), 2).alias("price"), F.count(F.lit(1)).alias("n"))
    return finest.groupingSets([(by, priority), (priority,), ()], by, priority).agg(
        money(F.sum("price")).alias("total"), F.sum("n").alias("n_orders"))


@plans("""
SELECT l_returnflag, l_linestatus,
       CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE) AS revenue
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def revenue_cube(t: Tables) -> DataFrame:
    finest = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum(discounted(), 4).alias("r"))
    return finest.cube("l_returnflag", "l_linestatus").agg(
        F.grouping_id().alias("level"), money(F.sum("r")).alias("revenue"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@plans("""
SELECT user_id,
       CAST(sum(CASE WHEN event_type = 'click' THEN 1 END) AS BIGINT) AS click,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS error,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 END) AS BIGINT) AS purchase,
       CAST(sum(CASE WHEN event_type = 'signup' THEN 1 END) AS BIGINT) AS signup,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 END) AS BIGINT) AS view,
       CAST(sum(CASE WHEN event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')
                       OR event_type IS NULL THEN 1 END) AS BIGINT) AS other
FROM events GROUP BY user_id
""")
def events_pivot(t: Tables) -> DataFrame:
    # Given values spare Spark the extra pass that finds them; all else is counted as other.
    kind = F.when(F.col("event_type").isin(EVENT_TYPES), F.col("event_type")).otherwise("other")
    return (t.events.select("user_id", kind.alias("kind"))
            .groupBy("user_id").pivot("kind", [*EVENT_TYPES, "other"]).count())


@plans("""
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS qty_price_corr,
       round(stddev_samp(l_extendedprice), 4) AS price_stddev
FROM lineitem GROUP BY l_returnflag
""")
def price_statistics(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("qty_price_corr"),
        F.round(F.stddev_samp("l_extendedprice"), 4).alias("price_stddev"),
    )


@plans("""
SELECT o_orderpriority,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median_price,
       round(quantile_cont(o_totalprice, 0.9), 4) AS p90_price
FROM orders GROUP BY o_orderpriority
""")
def price_quantiles(t: Tables) -> DataFrame:
    found = exact_quantiles(t.orders, ["o_orderpriority"], "o_totalprice",
                            {"median_price": 0.5, "p90_price": 0.9})
    return found.withColumns({
        c: F.round(c, 4) for c in ("median_price", "p90_price")})


@plans("""
SELECT word, count(*) AS n
FROM (SELECT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS word FROM benchmark)
WHERE word <> '' GROUP BY word
""")
def word_counts(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@plans("""
SELECT l_orderkey, l_linenumber, count(*) AS n_lines
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def repeated_line_keys(t: Tables) -> DataFrame:
    return (t.lineitem.groupBy("l_orderkey", "l_linenumber")
            .agg(F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") > 1))


@plans("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total
FROM events GROUP BY ALL
""")
def tumbling_hours(t: Tables) -> DataFrame:
    return (
        t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), money(exact_sum(hundredths("value"), 2)).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


@plans("""
SELECT window_start, event_type, count(*) AS n
FROM (SELECT event_type,
             unnest([time_bucket(INTERVAL 30 MINUTE, ts),
                     time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE])
               AS window_start
      FROM events)
GROUP BY ALL
""")
def sliding_hours(t: Tables) -> DataFrame:
    # Counted per half hour first: a window then copies counts, not events.
    halves = t.events.groupBy(F.window("ts", "30 minutes").alias("h"), "event_type").agg(
        F.count(F.lit(1)).alias("in_half"))
    return (
        halves.groupBy(
            F.window(F.col("h.start"), "1 hour", "30 minutes").alias("w"), "event_type")
        .agg(F.sum("in_half").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n")
    )
