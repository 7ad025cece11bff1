"""Contiguous shards of equal bytes from global prefix sums, in DataFrame functions only.

Only slim rows (id, size, checksum) are shuffled, never texts. A range sort by id puts
them in a total order over many partitions; one total per partition gives every
partition the bytes and rows before it, and running sums inside the partition give
every row its place in the whole. The bytes are cut at equal targets: a row belongs to
the shard in which its middle byte lies, so each shard is contiguous in the order and
off its target by at most one row.

Defined cases: a null text has no bytes; rows are ordered by id (nulls first), then by
size and checksum, so equal rows may change places among themselves; an empty table has
no shards; there may be shards without rows when a row is larger than a target; very long
texts are measured whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeforge.session import reliable


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32): UTF-8 bytes of the text plus one, and their checksum."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(
        F.col(id).alias("id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).cast("bigint").alias("text_crc32"),
    )


def byte_shards(
    docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row; slots count from 0 within a shard."""
    order = ["id", "size", "text_crc32"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes(docs, id, text).repartitionByRange(parts, *order)
    # The checkpoint fixes which rows a partition holds for both of the passes below.
    fixed = reliable(dealt.withColumn("part", F.spark_partition_id()))

    totals = fixed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per partition: bounded by configuration.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = fixed.join(F.broadcast(offsets), "part").select(
        *order, "all_bytes",
        (F.col("bytes_before") + F.sum("size").over(inside)).alias("end"),
        (F.col("rows_before") + F.count("*").over(inside) - 1).alias("position"),
    )
    middle = F.col("end") - F.expr("size div 2") - 1
    cut = F.floor(middle.cast("decimal(38,0)") * shards / F.col("all_bytes"))
    placed = reliable(upto.withColumn("shard", cut.cast("int")))
    # Shards follow each other, so a row's slot is its position less the shard's first.
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot")
    )
