"""Contiguous shards of near-equal bytes, from prefix sums of partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def byte_sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32``: UTF-8 bytes plus 1 (null text: 1, crc of the empty text)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def contiguous_shards(sized: DataFrame, shards: int = 16, partitions: int | None = None) -> DataFrame:
    """Give every row of ``doc_id, size, text_crc32`` a ``shard`` and a gapless ``slot``.

    Rows are put in the order of doc_id (nulls first; then size and checksum, so
    that tied rows are interchangeable) by a range exchange. Every partition's
    bytes and rows are summed; prefix sums over these few totals give each
    partition its global offset, and a running sum inside the partition gives
    each row its place. The row whose middle byte lies in the i-th of ``shards``
    equal stretches goes to shard i, so shards are contiguous and each differs
    from the target by less than one row. Only ids, sizes and checksums move,
    never texts. An empty table gives an empty result; groups of equal texts may
    be cut like any others, so a hot text cannot unbalance a shard.
    """
    spark = sized.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["doc_id", "size", "text_crc32"]
    placed = materialise(sized.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), "shard-rows")
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    # One row per partition: a window over all of them is as small as the partition count.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*keys)
    running = (
        placed.join(F.broadcast(offsets), "part")  # one row per partition of the range exchange
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        # (2 * end - size) / 2 is the row's middle byte; integers only, so that no rounding can move a cut
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * end - size) * {shards}) div (2 * all_bytes)) as int)"))
    )
    starts = running.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most `shards` rows
    return running.join(F.broadcast(starts), "shard").select(*keys, "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The shard table of a document table, in the columns of the contract (law ``bytes``)."""
    return contiguous_shards(byte_sizes(docs), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
