"""From records to catalog entries: content hashes, deduplication, identity and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.ids import content_hash, proquint, resource_id
from lakeloom.functions.json_values import canonical_json
from lakeloom.functions.names import resource_schema
from lakeloom.operators.catalog import ENTRIES, assign_versions, upsert_memberships
from lakeloom.operators.store import Tables


def hashed(records: DataFrame, column: str = "record") -> DataFrame:
    return records.withColumn("content_hash", content_hash(canonical_json(F.col(column))))


def new_items(records: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """The first of each content that the catalog lacks; ``records`` have a ``content_hash``."""
    first = records.groupBy("content_hash").agg(F.min_by(F.struct(*records.columns), F.struct(*order)).alias("r")).select("r.*")
    return first.join(known.select("content_hash").distinct(), "content_hash", "left_anti")


def item_memberships(records: DataFrame, collection: str, index: str) -> DataFrame:
    """Every record's place in its collection by content; a repeated one keeps its first place."""
    return records.groupBy(F.col("content_hash").alias("item_id")).agg(F.min(index).alias("item_index")).withColumn("collection_id", F.lit(collection))


def identity_json(record: F.Column, fields: list[str]) -> F.Column:
    """The identity fields by dotted path as canonical JSON; null unless all are there. A list stands for its first element."""
    values = []
    for f in fields:
        path = "$." + f
        first = F.get_json_object(record, path + "[0]")
        values.append(F.coalesce(first, F.get_json_object(record, path)))
    complete = F.lit(bool(fields))
    for v in values:
        complete = complete & v.isNotNull()
    return F.when(complete, F.to_json(F.struct(*(v.alias(f) for f, v in sorted(zip(fields, values), key=lambda x: x[0])))))


def with_identity(items: DataFrame, root_schema: str, fields: list[str], column: str = "record") -> DataFrame:
    """Adds identity, resource id and the pronounceable short id."""
    items = items.withColumn("identity_json", identity_json(F.col(column), fields))
    return items.withColumn("resource_id", resource_id(F.lit(root_schema), F.col("identity_json"), F.col("content_hash"))).withColumn("proquint", proquint(F.col("content_hash")))


def import_items(records: DataFrame, known: DataFrame, root_schema: str, fields: list[str], order: list[str]) -> DataFrame:
    """New items with identity and version; ``known(content_hash, resource_id, version)`` is the catalog."""
    fresh = with_identity(new_items(hashed(records), known, order), root_schema, fields)
    return assign_versions(known, fresh, *map(F.col, order))


def import_observations(observed: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each target and content: its first sighting, how often it was seen, and whether it is new.

    ``observed(target, content_hash, seq, ...)``, ``known(target, content_hash)``.
    """
    first = observed.groupBy("target", "content_hash").agg(F.min("seq").alias("first_seen"), F.count(F.lit(1)).alias("sightings"))
    held = known.select("target", "content_hash", F.lit(False).alias("_new")).distinct()
    return first.join(held, ["target", "content_hash"], "left").withColumn("is_new", F.coalesce("_new", F.lit(True))).drop("_new")


def staged_path(content: F.Column, at: F.Column, extension: str) -> F.Column:
    """Where a payload is kept: by day, under the first half of its hash."""
    return F.concat(F.lit("raw/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), F.substring(content, 1, 16), F.lit(extension))


def store_payloads(records: DataFrame, path: str, at: str, column: str = "record") -> None:
    """Appends payloads that are new, partitioned by day."""
    day = Window.partitionBy("content_hash").orderBy(at)
    rows = hashed(records, column).withColumn("_first", F.row_number().over(day)).where("_first = 1").drop("_first")
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def observation_schema(resource_type: F.Column, mapped: F.Column, loaded: F.Column, inferred: F.Column, generic: str) -> F.Column:
    """The schema of an observed record: mapped, else by its resource type if that is loaded, else inferred, else generic."""
    return F.coalesce(mapped, F.when(loaded, resource_schema(resource_type, generic)), inferred, F.lit(generic))


MEMBERS = "collection_id string, item_id string, item_index long"
PAYLOADS = "id string, record string"


def entries_of(rows: DataFrame) -> DataFrame:
    """``rows`` with all columns of the catalog, null where they have none."""
    kinds = T.StructType.fromDDL(ENTRIES)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))


def commit_collection(tables: Tables, collection: str, items: DataFrame, now: int, schema: str | None = None, origin: str | None = None, format: str = "json") -> int:
    """Items, their memberships and the collection's own row with the true count, in one transaction or not at all.

    ``items(record, item_index)``; content that the store holds only gains a membership. Entries and payloads are
    appended; a collection that comes again gets its row anew, which rewrites the entries.
    """
    at = F.timestamp_seconds(F.lit(now))
    with tables.transaction() as tx:
        held = tx.read("entries", ENTRIES)
        fresh = hashed(items)
        first = fresh.groupBy("content_hash").agg(F.min_by("record", "item_index").alias("record"), F.min("item_index").alias("item_index"))
        first = first.join(held.select(F.col("id").alias("content_hash")), "content_hash", "left_anti")
        places = item_memberships(fresh, collection, "item_index").select("collection_id", "item_id", F.col("item_index").cast("long"))
        known = tx.read("memberships", MEMBERS)
        again = not known.where(F.col("collection_id") == collection).isEmpty()
        if again:
            tx.write("memberships", upsert_memberships(known, places))
        else:
            tx.append("memberships", places)
        count = places.count()
        tx.append("payloads", first.select(F.col("content_hash").alias("id"), "record"))
        common = {"schema": F.lit(schema), "origin": F.lit(origin), "format": F.lit(format), "import_timestamp": at, "created_at": at, "updated_at": at, "version": F.lit(1), "status": F.lit("unknown")}
        new = first.select(F.col("content_hash").alias("id"), "content_hash", F.col("content_hash").alias("item_id"), "item_index", F.lit(collection).alias("collection_id"), F.lit("item").alias("entry_type"), F.lit("item").alias("collection_type"), F.octet_length("record").alias("size_bytes"), F.lit(1).alias("record_count")).withColumns(common)
        own = tables.spark.createDataFrame([(collection, "collection", "collection", count)], "id string, entry_type string, collection_type string, record_count long").withColumns(common)
        rows = entries_of(new).unionByName(entries_of(own))
        if again:
            tx.write("entries", held.where(F.col("id") != collection).unionByName(rows))
        else:
            tx.append("entries", rows)
    return count
