"""Contiguous, byte-balanced shards from global prefix sums; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyobs.llm.runtime import checkpointed, in_buckets, partitions, salted

#: Stands for a null id in the order of ids: nulls come first.
FIRST = -(1 << 63)


def with_prefix_sums(dealt: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """dealt with `rank` (how many rows are ahead in the global order) and for each of sums `before_<name>` (its sum over those).

    dealt has `bucket`: rows of a lower one come first, and within one `order` decides. The local sums of a bucket are
    kept with the rows; the totals of the buckets, one row each, become offsets by a running sum. No row order
    passes through one task. Ties in all of `order` get an arbitrary order.
    """
    local = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    kept = checkpointed(dealt.select("*", zero(F.count(F.lit(1)).over(local)).alias("_rank"), *[zero(F.sum(c).over(local)).alias(f"_before_{c}") for c in sums]))
    totals = kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = totals.select(F.col("bucket").alias("_bucket"), zero(F.sum("_rows").over(ahead)).alias("_rows_ahead"), *[zero(F.sum(f"_sum_{c}").over(ahead)).alias(f"_ahead_{c}") for c in sums])
    # one row for each bucket: bounded by the number of shuffle partitions
    found = kept.join(F.broadcast(offsets), F.col("bucket") == F.col("_bucket"))
    return found.select(*dealt.columns, (F.col("_rank") + F.col("_rows_ahead")).alias("rank"), *[(F.col(f"_before_{c}") + F.col(f"_ahead_{c}")).alias(f"before_{c}") for c in sums])


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, dealt to ranges by any columns, with `bucket`, for with_prefix_sums. For small rows: the window deals them again."""
    return checkpointed(rows.repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()))


def shard_of(before: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard of the span [before, before + size): the one that its middle falls in."""
    middle = (before.cast("decimal(38,0)") * 2 + size) * shards
    return F.least(F.lit(shards - 1), F.floor(F.try_divide(middle, total.cast("decimal(38,0)") * 2)).cast("int"))


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all documents, in the order of their ids, to contiguous shards of near-equal bytes.

    Returns id_col, size (UTF-8 bytes of the text plus 1; a null text has 1), text_crc32 (of the text's
    UTF-8; 0 for null or empty), law ('bytes'), shard, slot (from 0 in each shard, without gaps, in the
    order of ids) and grown_shard (null under this law). Shards differ from the equal share by at most
    the two documents on their borders. Ids are whole numbers; null ids come first; repeated ids and rows are all
    kept, in the order of a hash of size and checksum; other columns are ignored, whatever their names; an
    empty table gives an empty one. Texts never move: only (id, size, checksum) rows are shuffled, once, and an
    id that many rows share is spread over tasks.
    """
    text, n = F.coalesce(F.col(text_col), F.lit("")), partitions(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = slim.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(FIRST))).withColumn("tie", salted(F.xxhash64("size", "text_crc32")))
    placed = with_prefix_sums(in_buckets(checkpointed(keyed), "key", "tie", n).repartitionById(n, "bucket"), ["key", "tie"], ["size"])
    total = placed.agg(F.sum("size").alias("total"))
    with_shard = placed.crossJoin(F.broadcast(total)).withColumn("shard", shard_of(F.col("before_size"), F.col("size"), F.col("total"), shards))
    # `shards` rows: where each shard starts in the global order
    starts = with_shard.groupBy("shard").agg(F.min("rank").alias("start")).withColumnRenamed("shard", "_shard")
    return with_shard.join(F.broadcast(starts), F.col("shard") == F.col("_shard")).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
