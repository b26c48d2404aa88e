"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paytally.storage import write_once

#: Bytes of a record beside its text.
RECORD_BYTES = 8


def shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """``docs(doc_id, text)`` in ``n_shards`` contiguous runs of near equal bytes.

    Rows stand in the order of (digest of the text, doc_id), so equal texts are neighbours and
    a shard is one run of that order: only a group that lies across one of the ``n_shards - 1``
    cuts is in more than one. A row belongs to the shard in which the middle of its bytes falls,
    so a shard misses its equal share by less than one row's size.

    The narrow rows are range partitioned once and written with the number of their partition;
    each partition's total, summed over the earlier ones, is where its own running sum starts.
    No partition grows with a hot text, since doc_id is part of the order. Returns doc_id, size,
    text_crc32, shard and slot (place in the shard, gapless from 0); columns beyond the two are
    not looked at. A null text has size 8 and the checksum 0; null ids come first among equal
    texts; rows that repeat get a place each. An empty table gives no rows, and fewer rows than
    shards leave shards empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    narrow = write_once(narrow, "sizes")
    ordered = write_once(
        narrow.repartitionByRange("digest", "doc_id").withColumn("part", F.spark_partition_id()), "ordered"
    )
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    total = F.broadcast(totals.agg(F.sum("bytes").alias("all_bytes")))
    inside = Window.partitionBy("part").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ordered.select(
            "*", F.sum("size").over(inside).alias("bytes_up_to"), F.count("*").over(inside).alias("rows_up_to")
        )
        .join(before, "part")
        .join(total)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            # Twice the middle of the row, so that all stays in whole numbers.
            (2 * (F.col("bytes_before") + F.col("bytes_up_to")) - F.col("size")).cast("decimal(38,0)").alias("middle"),
            (F.col("rows_before") + F.col("rows_up_to") - 1).alias("place"),
            F.col("all_bytes").cast("decimal(38,0)").alias("all_bytes"),
        )
    )
    shard = F.expr(f"cast(least({n_shards - 1}, (middle * {n_shards}) div (2 * all_bytes)) as int)")
    placed = write_once(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "place"), "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
