"""Files to a store as they arrive. Every batch is deduplicated by content against the store, so a batch that is
run again after a failure, or a file that comes twice, adds nothing. Lines that are not JSON go to a table of their
own with their batch, one row for each text. A batch appends what is new; what is there is only read for its hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.store import Tables
from lakeloom.sources.imports import hashed, new_items

ITEMS = "record string, content_hash string, batch long"
REJECTED = "line string, content_hash string, lines long, batch long"


def ingest_stream(spark: SparkSession, source: str, store: str, checkpoint: str, files_per_batch: int = 100):
    """Starts a query over NDJSON files under ``source`` into the tables ``items`` and ``rejected`` of a store;
    ``availableNow`` ends it once all files that are there have been read. ``files_per_batch`` holds back how much is
    read at once."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(source).where(F.trim("value") != "")

    def commit(batch: DataFrame, number: int) -> None:
        tables = Tables(spark, store)
        at = F.lit(number).cast("long").alias("batch")
        good = F.try_parse_json("value").isNotNull()
        with tables.transaction() as tx:
            records = hashed(batch.where(good).select(F.col("value").alias("record")))
            tx.append("items", new_items(records, tx.read("items", ITEMS), ["record"]).select("record", "content_hash", at))
            bad = batch.where(~good).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("lines")).withColumn("content_hash", F.sha2("line", 256))
            held = tx.read("rejected", REJECTED).where(F.col("batch") == number)  # the same batch, run again
            tx.append("rejected", bad.join(held.select("content_hash"), "content_hash", "left_anti").select("line", "content_hash", "lines", at))

    return lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
