"""The catalog: filters, sorting, pages, collections, versions, status, runs and snapshots.

Tables: ``entries`` (one row for each import or item), ``memberships(collection_id, item_id, item_index)``,
``runs`` and ``snapshots``. Ties are broken by an explicit ``seq`` column wherever order matters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.names import ROOT, normalize_schema
from lakeloom.plans.terms import RuleError

#: The columns of the catalog, with an order column for ties.
ENTRIES = (
    "id string, stored_path string, metadata_path string, import_timestamp timestamp, format string, origin string, schema string, confidence double, record_count long, size_bytes long, "
    "collection_id string, item_index long, collection_type string, item_id string, resource_id string, content_hash string, identity_json string, version int, entry_type string, definition string, "
    "run_id string, tags string, status string, target string, created_at timestamp, updated_at timestamp"
)
#: Sortable columns by name; anything else sorts by time, newest first.
SORTS = {"timestamp": "import_timestamp", "size": "size_bytes", "records": "record_count", "schema": "schema", "origin": "origin", "format": "format", "id": "id"}
#: Statuses of an entry.
STATUSES = ("unknown", "clean", "drifted", "converging", "failed")


@dataclass(frozen=True)
class Filters:
    """``schema``, ``origin`` and ``format`` are parts of the value in any case; the others are exact."""

    schema: str | None = None
    origin: str | None = None
    format: str | None = None
    collection_id: str | None = None
    collection_type: str | None = None
    item_id: str | None = None
    entry_types: tuple[str, ...] = ()


def select_entries(entries: DataFrame, filters: Filters, memberships: DataFrame | None = None) -> DataFrame:
    rows = entries
    for column in ("schema", "origin", "format"):
        if (part := getattr(filters, column)) is not None:
            rows = rows.where(F.col(column).ilike(f"%{part}%"))
    for column in ("collection_type", "item_id"):
        if (value := getattr(filters, column)) is not None:
            rows = rows.where(F.col(column) == value)
    if filters.entry_types:
        rows = rows.where(F.col("entry_type").isin(*filters.entry_types))
    if filters.collection_id is not None:
        rows = rows.join(memberships.where(F.col("collection_id") == filters.collection_id).select(F.col("item_id").alias("id")), "id", "left_semi")
    return rows


def sort_entries(rows: DataFrame, by: str | None = None, reverse: bool = False) -> DataFrame:
    """Newest first by default; a named column ascends unless reversed."""
    if by is None or by not in SORTS:
        return rows.orderBy(F.desc("import_timestamp"), "id")
    column = F.col(SORTS[by])
    return rows.orderBy(column.desc() if reverse else column.asc(), "id")


def newest(rows: DataFrame, n: int = 1, time: str = "import_timestamp", serial: str = "seq") -> DataFrame:
    """The ``n`` newest rows; of equal times the one with the higher serial number comes first."""
    return rows.orderBy(F.desc(time), F.desc(serial)).limit(n)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    return rows.offset((number - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return math.ceil(total / size) if size else 1


def page_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("size_bytes"), F.sum("record_count").alias("record_count"))


def distinct_values(entries: DataFrame, columns: tuple[str, ...] = ("schema", "origin", "format")) -> DataFrame:
    """``(field, value, n)`` of each column, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return entries.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def curated_view(entries: DataFrame, memberships: DataFrame) -> DataFrame:
    """Entries with the collection they are in, if it is only one."""
    return entries.join(singleton_membership(memberships), F.col("id") == F.col("item_id"), "left").drop("item_id")


# Collections ------------------------------------------------------------------------------------


def collection_items(entries: DataFrame, memberships: DataFrame, collection: str | None = None) -> DataFrame:
    """Entries of collections in the order of their index."""
    own = memberships if collection is None else memberships.where(F.col("collection_id") == collection)
    return own.join(entries, own["item_id"] == entries["id"]).orderBy("collection_id", "item_index")


def singleton_membership(memberships: DataFrame) -> DataFrame:
    """``(item_id, collection_id)`` of items in exactly one collection."""
    grouped = memberships.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("collection_id").alias("collection_id"))
    return grouped.where("n = 1").select("item_id", "collection_id")


def membership_counts(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def upsert_memberships(memberships: DataFrame, new: DataFrame) -> DataFrame:
    """A pair that comes again takes its new index; the last row given wins."""
    both = memberships.select("collection_id", "item_id", "item_index", F.lit(0).alias("_round")).unionByName(new.select("collection_id", "item_id", "item_index", F.lit(1).alias("_round")))
    best = both.groupBy("collection_id", "item_id").agg(F.max_by("item_index", F.struct("_round", "item_index")).alias("item_index"))
    return best


def delete_entry(entries: DataFrame, memberships: DataFrame, entry: str) -> tuple[DataFrame, DataFrame]:
    if entries.where(F.col("id") == entry).isEmpty():
        raise LookupError(entry)
    return entries.where(F.col("id") != entry), memberships.where((F.col("item_id") != entry) & (F.col("collection_id") != entry))


def cascade_delete(entries: DataFrame, memberships: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Deletes a collection and those of its items that no other collection holds."""
    rest = memberships.where(F.col("collection_id") != collection)
    gone = memberships.where(F.col("collection_id") == collection).select("item_id").join(rest.select("item_id"), "item_id", "left_anti")
    kept = entries.where(F.col("id") != collection).join(gone.select(F.col("item_id").alias("id")), "id", "left_anti")
    return kept, rest


def add_entries(entries: DataFrame, new: DataFrame, root: str = ROOT) -> DataFrame:
    """Appends rows whose id is new: schema names are normalised, a missing content hash is the id, the first version is 1."""
    filled = new.withColumn("schema", normalize_schema(F.col("schema"), root))
    for column, default in (("content_hash", F.col("id")), ("version", F.lit(1)), ("status", F.lit("unknown"))):
        if column in entries.columns:
            filled = filled.withColumn(column, F.coalesce(F.col(column), default) if column in new.columns else default)
    return entries.unionByName(filled.join(entries.select("id"), "id", "left_anti"), allowMissingColumns=True)


def update_entries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows take the values of ``changes`` with their id; a null change keeps the value, an unknown id is an error."""
    if not changes.join(entries.select("id"), "id", "left_anti").isEmpty():
        raise LookupError("a changed entry is not in the catalog")
    columns = [c for c in changes.columns if c != "id"]
    joined = entries.join(changes.select("id", *(F.col(c).alias(f"_{c}") for c in columns)), "id", "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in entries.columns))


def schema_distribution(entries: DataFrame, memberships: DataFrame, collection: str) -> DataFrame:
    """How many records of each schema a snapshot or collection holds."""
    own = memberships.where(F.col("collection_id") == collection).select(F.col("item_id").alias("id"))
    return entries.join(own, "id", "left_semi").groupBy("schema").agg(F.count(F.lit(1)).alias("n"))


# Versions and status ----------------------------------------------------------------------------


def latest_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def resequence_versions(entries: DataFrame) -> DataFrame:
    """Versions 1, 2, ... of each resource by import time, creation and id."""
    order = Window.partitionBy("resource_id").orderBy("import_timestamp", "created_at", "id")
    return entries.withColumn("version", F.row_number().over(order))


def assign_versions(known: DataFrame, batch: DataFrame, *order: Column) -> DataFrame:
    """Versions of a batch, after the highest known one of each resource."""
    base = known.groupBy("resource_id").agg(F.max("version").alias("_base"))
    rank = F.row_number().over(Window.partitionBy("resource_id").orderBy(*order))
    return batch.withColumn("_rank", rank).join(base, "resource_id", "left").withColumn("version", F.coalesce("_base", F.lit(0)) + F.col("_rank")).drop("_base", "_rank")


def update_status(entries: DataFrame, target: str, status: str) -> DataFrame:
    """Sets the status of the newest row of a target."""
    if status not in STATUSES:
        raise RuleError(f"status must be one of {', '.join(STATUSES)}")
    newest = latest_by(entries.where(F.col("definition") == target), ["definition"], F.desc("import_timestamp"), F.desc("id")).select("id", F.lit(True).alias("_newest"))
    return entries.join(F.broadcast(newest), "id", "left").withColumn("status", F.when(F.col("_newest"), status).otherwise(F.col("status"))).drop("_newest").select(entries.columns)


def promote_converging(entries: DataFrame, targets: list[str] | None = None, model: str | None = None) -> tuple[DataFrame, int]:
    """Converging rows become clean: of these targets (a model's own or untagged rows), or of all with the model's tag."""
    tag = F.get_json_object("tags", "$.model")
    who = F.col("status") == "converging"
    if targets is not None:
        who = who & F.col("definition").isin(*targets) & (tag.isNull() | (tag == model) if model else F.lit(True))
    else:
        who = who & (tag == model)
    who = F.coalesce(who, F.lit(False))
    return entries.withColumn("status", F.when(who, "clean").otherwise(F.col("status"))), entries.where(who).count()


# Runs -------------------------------------------------------------------------------------------


def unfinished_runs(runs: DataFrame, model: str | None = None) -> DataFrame:
    rows = runs.where("finished_at is null")
    return (rows if model is None else rows.where(F.col("model") == model)).orderBy(F.desc("started_at"), F.desc("run_id"))


def fold_runs(events: DataFrame) -> DataFrame:
    """Run rows from an append-only log ``(run_id, model, kind, at, verdict, scoped)`` of start, apply, receipt and finish."""
    kind = F.col("kind")
    rows = events.groupBy("run_id").agg(
        F.max("model").alias("model"), F.min(F.when(kind == "start", F.col("at"))).alias("started_at"), F.max(F.when(kind == "finish", F.col("at"))).alias("finished_at"),
        F.count_if(kind == "apply").alias("applies"), F.max_by("verdict", F.when(kind == "finish", F.col("at"))).alias("verdict"), F.bool_or(F.coalesce("scoped", F.lit(False))).alias("scoped"),
        (F.count_if(kind == "apply") > F.count_if(kind == "receipt")).alias("needs_verification"),
    )
    done = F.when(F.col("finished_at").isNull(), "running").when(F.col("verdict") == "failed", "failed").otherwise("succeeded")
    return rows.withColumn("completion_status", done)


def applies_since_clean(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """``(model, applies)`` since the newest unscoped clean run."""
    newer = Window.partitionBy("model").orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    clean = ((F.col("verdict") == "clean") & ~F.coalesce("scoped", F.lit(False))).cast("int")
    rows = runs.withColumn("_clean", F.max(F.coalesce(clean, F.lit(0))).over(newer))
    return rows.groupBy("model").agg(F.sum(F.when(F.col("_clean") == 0, F.col("applies")).otherwise(0)).alias("applies"))


def model_verdict(verdict: Column, scoped: Column) -> Column:
    """A clean run over part of a model proves nothing about the whole."""
    return F.when((verdict == "clean") & scoped, "unknown").otherwise(verdict)


# Snapshots --------------------------------------------------------------------------------------


def eligible_snapshots(snapshots: DataFrame, runs: DataFrame, workspace: str, sources: tuple[str, ...] = ("populate", "observe", "converge")) -> DataFrame:
    """Snapshots of succeeded runs in a workspace."""
    good = runs.where("completion_status = 'succeeded'").select("run_id")
    return snapshots.where((F.col("workspace") == workspace) & F.col("source").isin(*sources)).join(good, "run_id", "left_semi")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return latest_by(snapshots, ["model"], F.desc("created_at"), F.desc("seq"))


def prune_victims(snapshots: DataFrame, keep: int, older_than: object | None = None) -> DataFrame:
    """Snapshots that are not retained, not among the newest of their model, and older than a time."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("created_at"), F.desc("seq")))
    rows = snapshots.withColumn("_place", place).where((F.col("_place") > keep) & ~F.coalesce("retained", F.lit(False)))
    if older_than is not None:
        rows = rows.where(F.col("created_at") < F.lit(older_than))
    return rows.drop("_place")


def prune_impact(victims: DataFrame, memberships: DataFrame) -> DataFrame:
    """``(item_id)`` of records that only pruned snapshots hold."""
    doomed = victims.select(F.col("snapshot_id").alias("collection_id"))
    inside = memberships.join(doomed, "collection_id", "left_semi").select("item_id").distinct()
    return inside.join(memberships.join(doomed, "collection_id", "left_anti").select("item_id"), "item_id", "left_anti")


# Item schemas -----------------------------------------------------------------------------------


def upsert_item_schemas(known: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed by item and schema; the later row wins."""
    both = known.withColumn("_round", F.lit(0)).unionByName(new.withColumn("_round", F.lit(1)))
    return latest_by(both, ["item_id", "schema_ref"], F.desc("_round"), F.desc("classified_at")).drop("_round")


def reclassify(item_schemas: DataFrame, registry: DataFrame) -> DataFrame:
    """Unresolved references become declared once the registry has their schema."""
    known = registry.select("schema_ref", F.lit(True).alias("_known"))
    rows = item_schemas.join(known, "schema_ref", "left")
    return rows.withColumn("status", F.when((F.col("status") == "unresolved") & F.col("_known"), "declared").otherwise(F.col("status"))).select(item_schemas.columns)
