"""Proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; a row of rank r among n has the
fractional rank (r + 0.5) / n. Sorting all rows by it interleaves the sources in proportion, and cutting
that order into equal runs gives shards of equal size whose mixture is that of the whole table.

Ranks come from two range sorts and the row counts of their partitions, never from a window over a source,
so a source with a third of all rows is spread over as many tasks as its rows need.

Cases: a null source is a source of its own; null text has size 1 and the checksum of no bytes; rows that
repeat in every column are interchangeable, each gets a slot; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, input_partitions


def range_ranked(df: DataFrame, scratch: Scratch, name: str, order: list[str]) -> DataFrame:
    """``df`` in range partitions by ``order``, written with ``_pid`` and the row's place ``_at`` in its partition."""
    n = input_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    serial = F.monotonically_increasing_id()
    placed = placed.withColumn("_serial", serial)
    placed = placed.withColumn("_pid", F.shiftright("_serial", 33)).withColumn("_at", F.col("_serial").bitwiseAND((1 << 33) - 1)).drop("_serial")
    return scratch.save(placed, name)


def stratified_shards(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """``(id, stratum, size, text_crc32, shard, slot)``: shards' row counts differ by one at most."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"),
        F.col(stratum_col).cast("string").alias("_stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("_h"),
    )
    slim = scratch.save(slim, "slim")

    ranked = range_ranked(slim, scratch, "by_stratum", ["_stratum", "_h", "_id"])
    scratch.drop("slim")
    runs = ranked.groupBy("_stratum", "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_stratum").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_stratum")
    runs = runs.select(
        F.col("_stratum").alias("_s"),
        F.col("_pid").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("_total"),
    )
    rank = F.col("_at") + F.col("_shift")
    mixed = ranked.join(runs, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_pid") == F.col("_p"))).select(
        "_id", "_stratum", "size", "text_crc32", rank.alias("_rank"), ((rank + F.lit(0.5)) / F.col("_total")).alias("_fraction"), F.xxhash64(F.lit(seed), F.col("_stratum")).alias("_turn")
    )

    placed = range_ranked(scratch.save(mixed, "mixed"), scratch, "placed", ["_fraction", "_turn", "_stratum", "_rank"])
    scratch.drop("by_stratum")
    scratch.drop("mixed")
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    running = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_pid").alias("_p"), F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    at = F.col("_at") + F.col("_before")
    shard = F.expr(f"(_position * {shards}) div _all")
    start = F.expr(f"(shard * _all + {shards} - 1) div {shards}")
    return (
        placed.join(counts, F.col("_pid") == F.col("_p"))
        .withColumn("_position", at)
        .withColumn("shard", shard)
        .select(F.col("_id").alias(id_col), F.col("_stratum").alias(stratum_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_position") - start).alias("slot"))
    )
