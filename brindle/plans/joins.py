"""Joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import discounted, exact_sum, hundredths, money
from brindle.operators import asof_join, band_join, count_in_intervals, sessions, with_totals
from brindle.operators.ordered import written
from brindle.plans.registry import Plans
from brindle.sources import Tables

plans = Plans()


@plans("""
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                        * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
  AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA'
GROUP BY n_name
""")
def regional_revenue(t: Tables) -> DataFrame:
    # The region narrows customers and suppliers first, so that fewer lines are shuffled.
    nations = t.nation.join(t.region.where(F.col("r_name") == "ASIA"),
                            F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    buyers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    sellers = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "n_nationkey", "n_name")
    return (
        t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sellers, (F.col("l_suppkey") == F.col("s_suppkey"))
              & (F.col("s_nationkey") == F.col("n_nationkey")))
        .groupBy("n_name").agg(money(exact_sum(discounted(), 4)).alias("revenue"))
    )


@plans("""
SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n_lines,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS gross
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_orderpriority
""")
def order_line_counts(t: Tables) -> DataFrame:
    # Lines are summed by order before the join, where an order has one row on each side.
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), exact_sum(hundredths("l_extendedprice"), 2).alias("price"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "o_orderpriority",
        F.coalesce("n", F.lit(0)).alias("n_lines"), money(F.col("price")).alias("gross"))


@plans("""
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
""")
def customers_with_large_orders(t: Tables) -> DataFrame:
    # distinct() drops a customer's repeats in the map tasks, before the shuffle.
    large = t.orders.where(F.col("o_totalprice") > 400000).select("o_custkey").distinct()
    return t.customer.join(
        large, F.col("c_custkey") == F.col("o_custkey"), "left_semi"
    ).select("c_custkey", "c_name")


@plans("""
SELECT o_orderkey, o_orderdate FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def orders_without_lines(t: Tables) -> DataFrame:
    with_lines = t.lineitem.select("l_orderkey").distinct()
    return t.orders.join(
        with_lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"
    ).select("o_orderkey", "o_orderdate")


@plans("""
SELECT c_custkey, c_name, user_id, n_events, total
FROM customer
FULL JOIN (SELECT user_id, count(*) AS n_events,
                  CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total
           FROM events WHERE event_type = 'purchase' GROUP BY user_id)
  ON user_id = c_custkey + 100
""")
def customer_purchases_full(t: Tables) -> DataFrame:
    # Adaptive execution cannot split a full outer join, so each side has one row a key.
    bought = (
        t.events.where(F.col("event_type") == "purchase").groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_events"),
             money(exact_sum(hundredths("value"), 2)).alias("total"))
    )
    # the shift gives both sides keys the other lacks
    return t.customer.select("c_custkey", "c_name").join(
        bought, F.col("user_id") == F.col("c_custkey") + 100, "full")


@plans("""
SELECT s_suppkey, c_custkey, round(abs(c_acctbal - s_acctbal), 2) AS gap
FROM (SELECT s_suppkey, s_acctbal, c_custkey, c_acctbal,
             row_number() OVER (PARTITION BY s_suppkey
                                ORDER BY c_acctbal DESC, c_custkey DESC) AS place
      FROM supplier JOIN customer
        ON c_nationkey = s_nationkey
       AND c_acctbal BETWEEN s_acctbal - 250 AND s_acctbal + 250)
WHERE place = 1
""")
def balance_band_pairs(t: Tables) -> DataFrame:
    # Each supplier with the customer of its nation that is uppermost in its band: one
    # ordered pass, and a row per supplier at most, whatever the bands hold.
    sellers = t.supplier.select(F.col("s_nationkey").alias("nation"),
                                (F.col("s_acctbal") + 250).alias("balance"),
                                "s_suppkey", "s_acctbal")
    buyers = t.customer.select(F.col("c_nationkey").alias("nation"),
                               F.col("c_acctbal").alias("balance"), "c_custkey", "c_acctbal")
    return (
        asof_join(sellers, buyers, ["nation"], "balance", "s_suppkey",
                  ["c_custkey", "c_acctbal"], "c_custkey")
        .where(F.col("c_acctbal") >= F.col("s_acctbal") - 250)
        .select("s_suppkey", "c_custkey",
                F.round(F.abs(F.col("c_acctbal") - F.col("s_acctbal")), 2).alias("gap"))
    )


@plans("""
SELECT s_suppkey, count(c_custkey) AS n_customers
FROM supplier LEFT JOIN customer ON c_acctbal BETWEEN s_acctbal - 250 AND s_acctbal + 250
GROUP BY s_suppkey
""")
def balance_band_counts(t: Tables) -> DataFrame:
    bands = t.supplier.select(
        "s_suppkey",
        (F.col("s_acctbal") - 250).alias("low"), (F.col("s_acctbal") + 250).alias("high"))
    return count_in_intervals(bands, t.customer, [], "s_suppkey", "low", "high", "c_acctbal",
                              "n_customers")


@plans("""
SELECT p.event_id, count(v.event_id) AS n_views
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON v.user_id = p.user_id AND v.ts BETWEEN p.ts - INTERVAL 12 HOUR AND p.ts
GROUP BY p.event_id
""")
def views_before_purchase(t: Tables) -> DataFrame:
    purchases = t.events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", F.expr("ts - interval 12 hours").alias("low"),
        F.col("ts").alias("high"))
    views = t.events.where(F.col("event_type") == "view")
    return count_in_intervals(purchases, views, ["user_id"], "event_id", "low", "high", "ts",
                              "n_views")


@plans("""
WITH marked AS (
  SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                          + INTERVAL 6 HOUR, true) AS starts
  FROM events),
numbered AS (
  SELECT *, count(*) FILTER (starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM marked),
spans AS (
  SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_rows
  FROM numbered GROUP BY user_id, session)
SELECT e.event_id, e.user_id, session_start, session_end, n_rows
FROM events e JOIN spans s ON s.user_id = e.user_id AND e.ts BETWEEN session_start AND session_end
WHERE event_type = 'purchase'
""")
def purchase_sessions(t: Tables) -> DataFrame:
    # A user's sessions are apart, so there is one pair for each purchase. Sessions of more than
    # 1,000 times six hours go to wider buckets.
    def micros(column: str) -> Column:
        # by an interval: a cast to an instant depends on the session's time zone
        since = F.col(column) - F.expr("timestamp_ntz'1970-01-01'")
        return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")

    spans = written(
        sessions(t.events, ["user_id"], "ts", "event_id", F.expr("interval 6 hours"), {})
        .withColumns({"low": micros("session_start"), "high": micros("session_end")}))
    purchases = t.events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", micros("ts").alias("at"))
    return band_join(spans, purchases, ["user_id"], "low", "low", "high", "event_id", "at",
                     width=6 * 3600 * 1e6).select(
        "event_id", "user_id", "session_start", "session_end", "n_rows")


@plans("""
SELECT p.event_id, p.user_id, p.ts, s.event_id AS signup_id, s.ts AS signup_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s
  ON s.user_id = p.user_id AND s.ts <= p.ts
""")
def last_signup_before_purchase(t: Tables) -> DataFrame:
    purchases = t.events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", "ts")
    signups = t.events.where(F.col("event_type") == "signup").select(
        "user_id", "ts", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_ts"))
    return asof_join(purchases, signups, ["user_id"], "ts", "event_id",
                     ["signup_id", "signup_ts"], "signup_id")


@plans("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice
FROM lineitem AS o
WHERE l_quantity < (SELECT 0.4 * sum(l_quantity) / count(*) FROM lineitem AS i
                    WHERE i.l_partkey = o.l_partkey)
""")
def small_quantity_lines(t: Tables) -> DataFrame:
    # The lines and their part's mean from one scan and one shuffle. A join with the
    # means would not be split for a hot part, as an aggregate stands below it.
    lines = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    ).where(F.col("l_partkey").isNotNull())
    totals = with_totals(lines, ["l_partkey"], {
        "part_qty": F.sum("l_quantity"), "part_lines": F.count("l_quantity")})
    return totals.where(
        F.col("l_quantity") < 0.4 * F.col("part_qty") / F.col("part_lines")
    ).drop("part_qty", "part_lines")


@plans("""
SELECT lang, quality, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality
""")
def labelled_languages(t: Tables) -> DataFrame:
    return (
        t.documents.join(t.labels, "doc_id").groupBy("lang", "quality")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"))
    )
