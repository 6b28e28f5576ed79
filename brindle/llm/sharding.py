"""Contiguous shards of nearly equal bytes, cut by global prefix sums.

Rows are put in one global order, partition by partition. Each partition's
total of bytes and rows is known after one job; a prefix sum over those totals,
one row per partition, says where each partition starts. Inside a partition a
running sum goes on from there, so every row knows the bytes before it in the
whole table and falls into the shard whose equal share of all bytes holds its
middle byte. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.texts import quoted
from brindle.session import checkpoint_folder

#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def byte_size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("bigint") + ROW_BYTES


def text_crc32(text: str) -> Column:
    return F.coalesce(F.crc32(F.col(quoted(text)).cast("binary")), F.lit(0)).cast("bigint")


def byte_shards(df: DataFrame, doc_id: str, text: str, shards: int) -> DataFrame:
    """Return ``doc_id``, size, text_crc32, shard and slot for every row.

    Shards are contiguous in the order of id, checksum and size, and hold equal
    bytes as nearly as rows allow: a cut is at most half a row off. ``slot``
    counts a shard's rows from 0.

    Only ids, sizes and checksums are moved, never texts. The order ends in the
    row's place in the input, so a repeated id is spread over partitions like any
    other row; rows that agree in id, checksum and size are alike in the result,
    whichever comes first. Null ids come first, a null text has size 8 and
    checksum 0, other columns are not looked at, an empty table gives no rows. A
    row larger than a share leaves shards empty.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    order = ["id", "text_crc32", "size", "_place"]
    slim = df.select(F.col(quoted(doc_id)).alias("id"), byte_size(text).alias("size"),
                     text_crc32(text).alias("text_crc32"),
                     F.monotonically_increasing_id().alias("_place"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: a row's partition must be the same in every later job.
    placed = (slim.repartitionByRange(parts, *order)
              .withColumn("_part", F.spark_partition_id())).checkpoint()

    # One row per partition, whatever the table holds.
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select("_part",
                F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_bytes_before"),
                F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_rows_before"),
                F.sum("_bytes").over(Window.partitionBy()).alias("_all_bytes"))
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        placed.withColumns({"_upto": F.sum("size").over(running),
                            "_row": F.row_number().over(inside).cast("bigint")})
        .join(starts, "_part")
        # twice the row's middle byte, in whole numbers
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size"))
        .select("id", "size", "text_crc32",
                (F.col("_rows_before") + F.col("_row")).alias("_number"),
                F.expr(f"(_middle * {shards}) div (2 * _all_bytes)").cast("int").alias("shard"))
    ).checkpoint()
    # As many rows as shards.
    firsts = numbered.groupBy("shard").agg(F.min("_number").alias("_first"))
    return numbered.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(doc_id), "size", "text_crc32", "shard",
        (F.col("_number") - F.col("_first")).alias("slot"))
