"""Contiguous balanced shards: global prefix sums of byte sizes from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import partitions, stage


def prefix_sums(sized: DataFrame, order: list[str], size_col: str) -> DataFrame:
    """``sized`` with bytes_before and rows_before, the sums over all rows that precede in ``order``.

    Rows are dealt by range and staged with their partition's number, so that a rerun task cannot move a
    row; totals per partition (one row each) give each partition's start, and a window inside each
    partition does the rest. Ties are ordered by a row number fixed when staged, so that rows of one key
    spread over several partitions. ``sized`` should be narrow: it is written once.
    """
    spark = sized.sparkSession
    dealt = sized.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order, "_row")
    fixed = stage(dealt.withColumn("_part", F.spark_partition_id()), "sized")
    totals = fixed.groupBy("_part").agg(F.sum(size_col).alias("_b"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    starts = totals.select("_part", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    within = Window.partitionBy("_part").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        fixed.withColumns({"_bi": F.coalesce(F.sum(size_col).over(within), F.lit(0)), "_ni": F.coalesce(F.count("*").over(within), F.lit(0))})
        .join(F.broadcast(starts), "_part")  # as many rows as partitions
        .withColumns({"bytes_before": F.col("_b0") + F.col("_bi"), "rows_before": F.col("_n0") + F.col("_ni")})
        .drop("_part", "_row", "_b0", "_bi", "_n0", "_ni")
    )


def balanced_shards(sized: DataFrame, order: list[str], shards: int, size_col: str = "size") -> DataFrame:
    """``sized`` with shard (0 to shards-1) and slot (gapless from 0 in each shard, in ``order``).

    A row whose middle byte lies in the k-th of ``shards`` equal parts of all bytes goes to shard k, so a
    shard's size differs from the target by one row's at most on either side. Sizes must be positive
    (a row without bytes has no place among equal targets); an empty table gives an empty result.
    """
    summed = prefix_sums(sized, order, size_col)
    total = sized.agg(F.sum(size_col)).first()[0] or 1
    middle = F.col("bytes_before") * 2 + F.col(size_col)
    cut = stage(summed.withColumn("shard", F.least((middle * shards / F.lit(2 * total)).cast("int"), F.lit(shards - 1))), "cut")
    first = cut.groupBy("shard").agg(F.min("rows_before").alias("_first"))  # one row a shard
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("rows_before") - F.col("_first")).drop("_first", "bytes_before", "rows_before")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1; null text has none), text_crc32, law, shard, slot, grown_shard.

    Documents lie in order of id (null first), and rows equal in id, size and checksum in any order: they
    are interchangeable here. Other columns are left out; join them by id.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = balanced_shards(sized, ["doc_id", "size", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
