"""Operator 1: contiguous shards of nearly equal bytes.

Rows are put in order of ``doc_id`` by a range shuffle. Each range partition numbers its own rows and adds up its own
bytes; the totals of the partitions (one row each) give every partition the rows and bytes before it, so each row gets
its global byte interval without any task seeing more than one partition. The line of bytes is cut at equal targets: a
row belongs to the shard that holds the middle of its interval, so a shard differs from its target by less than its two
border rows.

Null texts have size 1 and the checksum of the empty text. Rows with equal or null ids keep the order of the scan;
repeated rows stay separate rows. An empty table gives an empty table. Other columns are ignored, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, documents, partitions, text_of

LOCAL = "doc_id long, size long, text_crc32 long, part int, bytes_before long, rows_before long"


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        total = b["size"].cumsum()
        b["doc_id"] = b["doc_id"].astype("Int64")
        b["part"], b["bytes_before"], b["rows_before"] = part, total - b["size"] + size, range(rows, rows + len(b))
        size, rows = size + int(b["size"].sum()), rows + len(b)
        yield b.drop(columns="row")


def shard(df: DataFrame, n_shards: int = 16) -> DataFrame:
    """Columns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    text = F.encode(text_of(), "UTF-8")
    rows = df.select(F.col("doc_id").cast("long"), (F.octet_length(text_of()) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(partitions(df), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    local = checkpoint(ordered.mapInPandas(_running, LOCAL))
    totals = local.groupBy("part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("part_bytes"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_rows"), F.sum("b").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"))
    placed = local.join(F.broadcast(totals), "part").withColumn("start", F.col("part_bytes") + F.col("bytes_before")).withColumn("line", F.col("part_rows") + F.col("rows_before"))
    placed = placed.withColumn("shard", F.expr(f"cast((({n_shards} * (2 * start + size)) div (2 * all_bytes)) as int)"))
    firsts = placed.groupBy("shard").agg(F.min("line").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("line") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
