"""Functions on single rows: text, dates, JSON, URLs, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import dot
from brindle.plans.registry import Plans
from brindle.sources import Tables

plans = Plans()


@plans("""
SELECT p_partkey, upper(p_name) AS shouted, string_split(p_name, ' ')[1] AS first_word,
       replace(p_brand, 'Brand#', '') AS brand_no, lpad(CAST(p_size AS VARCHAR), 4, '0') AS size,
       CAST(length(p_type) AS INT) AS type_length, p_type LIKE '%M%' AS has_m,
       reverse(p_type) AS reversed
FROM part
""")
def part_texts(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.upper("p_name").alias("shouted"),
        F.split("p_name", " ")[0].alias("first_word"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand_no"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size"),
        F.length("p_type").alias("type_length"),
        F.col("p_type").like("%M%").alias("has_m"),
        F.reverse("p_type").alias("reversed"),
    )


@plans("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
       CAST(isodow(o_orderdate) AS INT) AS weekday, last_day(o_orderdate) AS month_end,
       CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS month_later,
       CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INT) AS day_no,
       CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start,
       strftime(o_orderdate, '%Y/%m/%d') AS shown
FROM orders
""")
def order_dates(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        (F.weekday(day) + 1).alias("weekday"),
        F.last_day(day).alias("month_end"),
        F.add_months(day, 1).alias("month_later"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("day_no"),
        F.trunc(day, "quarter").alias("quarter_start"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("shown"),
    )


@plans("""
SELECT TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n
FROM events GROUP BY k
""")
def event_property_counts(t: Tables) -> DataFrame:
    # what is no number counts as null and ends no job
    k = F.get_json_object("props", "$.k").try_cast("int").alias("k")
    return t.events.groupBy(k).agg(F.count(F.lit(1)).alias("n"))


@plans("""
SELECT nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS host, count(*) AS n_pages,
       CAST(sum(length(html)) AS BIGINT) AS chars
FROM pages GROUP BY host
""")
def pages_by_host(t: Tables) -> DataFrame:
    # a bad URL has a null host and ends no job
    return t.pages.groupBy(F.try_parse_url("url", F.lit("HOST")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("html")).alias("chars"))


@plans("""
SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]),
                                        CAST(q.embedding AS DOUBLE[])), 5) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
""")
def similarity_to_first(t: Tables) -> DataFrame:
    # A scalar subquery: one vector, and an error if there were two.
    query = t.embeddings.where(F.col("vec_id") == 0).select("embedding").scalar()
    return (
        t.embeddings.select("vec_id", "embedding", query.alias("query"))
        .select("vec_id", F.round(dot("embedding", "query"), 5).alias("similarity"))
    )
