"""Set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import intersection, surplus
from brindle.plans.registry import Plans
from brindle.sources import Tables

plans = Plans()


@plans("""
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier
""")
def nations_in_use(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).union(
        t.supplier.select("s_nationkey")).distinct()


@plans("""
SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R'
INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'
""")
def parts_returned_and_accepted(t: Tables) -> DataFrame:
    def parts(flag: str) -> DataFrame:
        return t.lineitem.where(F.col("l_returnflag") == flag).select(
            F.col("l_partkey").alias("partkey"))
    return intersection(parts("R"), parts("A"))


@plans("""
SELECT user_id AS key FROM events WHERE event_type = 'view'
EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'purchase'
""")
def views_beyond_purchases(t: Tables) -> DataFrame:
    def users(kind: str) -> DataFrame:
        return t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"))
    return surplus(users("view"), users("purchase"))


@plans("""
SELECT o_orderkey, 'status' AS field, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders
""")
def order_fields(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    ).unpivot("o_orderkey", ["status", "priority"], "field", "value")
