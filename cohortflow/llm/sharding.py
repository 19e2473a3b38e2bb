"""Operator 1: contiguous shards of near-equal bytes.

Method: order the rows, take the byte total of every partition, turn the
totals into global prefix sums, and cut the byte line at equal targets. A row
goes to the shard that its byte midpoint falls into, so a shard misses its
target by less than one row at either end.

Plan: one range shuffle orders the whole rows and is written down, so that the
partition numbers the totals are taken by cannot change in a retry. All that
follows is worked out on (place, size): windows inside each partition add the
partition's offset, and every partition learns where its shards begin. The
written rows then look up their shard, without another shuffle, and are
written to one folder a shard. The offsets are one row per partition.

Defined results: a null text has size 1 and checksum 0; null ids come first;
repeated rows each keep their own place (ties end by position in the input); an
empty table gives no rows; other columns of the input stay in their row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .common import stage

ORDER = ("doc_id", "text_crc32", "size", "_src")


def write_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """The written shards and their path: doc_id, size, text_crc32, shard, slot and ``row``, all columns of the input.

    The path holds one folder ``shard=N`` for every shard that is not empty; ``slot`` orders the rows of a shard.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                        (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"),
                        F.monotonically_increasing_id().alias("_src"))
    # a row's place: number of the partition, and rank within it in the lower 33 bits
    ordered = stage(sized.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).drop("_src")
                    .withColumn("_at", F.monotonically_increasing_id()), "sharding")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    rank = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))

    # one row per partition: a window without a key is bounded by their number
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ordered.groupBy("_part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    offsets = totals.select("_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                            F.sum("b").over(every).alias("total"))

    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = stage(ordered.select("_part", "_at", "size").withColumn("_end", F.sum("size").over(upto))
                   .join(F.broadcast(offsets), "_part")
                   .withColumn("shard", F.expr(
                       f"CAST(least({n_shards - 1}, ((2 * (b0 + _end) - size) * {n_shards}) div (2 * total)) AS INT)"))
                   .groupBy("_part", "n0", "shard").agg(F.min("_at").alias("at"), F.min(F.col("n0") + rank).alias("pos")), "shard-begins")
    first = begins.groupBy("shard").agg(F.min("pos").alias("first"))  # one row per shard
    by_part = (begins.join(F.broadcast(first), "shard").groupBy("_part")
               .agg(F.sort_array(F.collect_list(F.struct("at", "shard", (F.col("n0") - F.col("first")).alias("shift")))).alias("begins")))
    placed = (ordered.join(F.broadcast(by_part), "_part")
              .withColumn("b", F.expr("element_at(filter(begins, b -> b.at <= _at), -1)"))
              .select("doc_id", "size", "text_crc32", F.col("b.shard").alias("shard"), (F.col("b.shift") + rank).alias("slot"), "row"))
    path = shared_path(docs.sparkSession, "llm-stage", f"shards-{uuid.uuid4().hex}")
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path).select(*placed.columns), path


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``, from the written shards."""
    return write_shards(docs, n_shards, id_col, text_col)[0].drop("row")
