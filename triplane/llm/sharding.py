"""Sharding by a global prefix sum of byte sizes.

Documents stand in the order of their ids. A document's shard is where the bytes before it fall when the corpus is cut
at equal targets, so shards are runs of the order and their sizes differ by about one document at most.

No task sees the whole order: rows are spread over ranges of ids, each range is summed, and the ranges' totals (one row
per range) give the offset at which each range starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplane.llm.common import durable, table


def shard(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, shard, slot``: one per row of ``docs``.

    size: UTF-8 bytes of the text plus 1; a null text has size 1 and the checksum of no bytes. shard: 0 to shards - 1.
    slot: the place in the shard, from 0 without gaps. Null ids come first; equal ids stand by checksum and size, and
    rows alike in all three are interchangeable. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so
    other columns may have any names.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    # The tie spreads rows that are alike over ranges. The ranges are stored: totals and offsets must see the same ones.
    placed = durable(
        slim.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *order)
        .withColumn("part", F.spark_partition_id())
    )
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(  # one row per range: ``ranges`` rows at most
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_start"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_start"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    cut = (
        placed.join(F.broadcast(starts), "part")
        .withColumn("bytes_before", F.col("byte_start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("place", F.col("row_start") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(bytes_before * {shards} div total as int)"))
    )
    cut = durable(cut.select("doc_id", "size", "text_crc32", "shard", "place"))
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first_place"))  # ``shards`` rows
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its shard of 8 and its place there."""
    return shard(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
