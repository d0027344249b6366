"""Registered queries of what works on the driver or through a store: orders, transactions, streams, loops."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeloom.api import Workspace
from lakeloom.operators import catalog, facts, graph, reconcile, schemas
from lakeloom.operators.catalog import ENTRIES, Filters
from lakeloom.operators.store import FactStore, Tables
from lakeloom.plans.engine import Engine, strata
from lakeloom.plans.lineage import shared_folder
from lakeloom.plans.relations import Relations
from lakeloom.plans.rules import CONVERGENCE_RULES, relation_listing, shadowed
from lakeloom.plans.terms import Rule, RuleError, parse_term
from lakeloom.queries import NOW, Data, _registry, document_facts, event_second, place_edges, query, rule
from lakeloom.sources import formats, imports
from lakeloom.streaming.incremental import ITEMS, REJECTED, ingest_stream


@query("WITH n AS (SELECT 'r' || r_regionkey AS node, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation) SELECT node, level, bool_and(level >= 0) AS ordered FROM n GROUP BY ALL")
def g5_topological_order(spark, path):
    edges = [tuple(r) for r in place_edges(spark, path).where("from like 'n%'").collect()]  # nations and regions: 30 rows by nature
    regions = [r["r"] for r in Data(spark, path).region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("r")).collect()]
    order = graph.topological_order(edges, regions)
    place = {n: k for k, n in enumerate(order)}
    rows = [(n, int(n[0] == "n"), all(place[b] < place[a] for a, b in edges if a == n)) for n in order]
    return spark.createDataFrame(rows, "node string, level int, ordered boolean")


@query("SELECT * FROM (VALUES (0, 'dns'), (1, 'net'), (2, 'db'), (3, 'app')) t(place, model)")
def g6_r6_run_set(spark, path):
    models = {"app": {"requires": ["store", "net"], "aliases": ["web"]}, "db": {"requires": ["net"], "aliases": ["store"]}, "net": {"requires": ["dns"]}, "dns": {}, "idle": {"requires": ["dns"]}}
    return spark.createDataFrame(list(enumerate(graph.run_set(models, ["web"]))), "place int, model string")


@query("SELECT DISTINCT 'n' || s_nationkey AS resource FROM supplier WHERE s_suppkey <= 5 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey <= 5 UNION SELECT 'r' || n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey <= 5")
def g7_resource_closure(spark, path):
    edges = place_edges(spark, path).select(F.col("from").alias("a"), F.col("to").alias("b"))
    start = Data(spark, path).supplier.where("s_suppkey <= 5").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("x"))
    rules = [rule({"resource": "$X"}, ("start", {"x": "$X"}), name="needed"), rule({"resource": "$Y"}, ("needed", {"resource": "$X"}), ("edge", {"a": "$X", "b": "$Y"}), name="needed")]
    return Engine(Relations({"start": start, "edge": edges}), rules).query("needed")


@query("SELECT * FROM (VALUES ('base/core.#Item', 0, 0), ('tpc.#Part', 0, 0), ('tpc.#SmallPart', 1, 1)) t(name, depth, bases)")
def g9_inheritance(spark, path):
    registry = _registry()
    return spark.createDataFrame([(n, registry.depth(n), len(registry.chain(n)) - 1) for n in registry.most_specific_first()], "name string, depth int, bases int")


@query("SELECT * FROM (VALUES ('depends_transitive', 0), ('cyclic', 1), ('impacted_by', 1)) t(relation, after)")
def g10_strata(spark, path):
    order = [r for stratum in strata([Rule.parse(r) for r in CONVERGENCE_RULES]) for r in stratum]
    return spark.createDataFrame([(r, int(order.index(r) > 0)) for r in order], "relation string, after int")


@query("SELECT * FROM (VALUES ('aggregate in body'), ('aggregate in recursion'), ('reserved head'), ('unbound head')) t(refused)")
def a7_f17_refused_rules(spark, path):
    cases = {
        "aggregate in body": [rule({"x": "$X"}, ("a", {"x": "$X", "n": "count($X)"}))],
        "aggregate in recursion": [rule({"n": "count($X)"}, ("a", {"x": "$X"})), rule({"n": "$N"}, ("r", {"n": "$N"}))],
        "reserved head": [rule({"x": "$X"}, ("a", {"x": "$X"}), name="fact_scored")],
        "unbound head": [rule({"y": "$Y"}, ("a", {"x": "$X"}))],
        "fine": [rule({"x": "$X"}, ("a", {"x": ">=10", "y": "$X"}))],
    }
    out = []
    for name, rules in cases.items():
        try:
            Engine(Relations(reserved=facts.RESERVED), rules)
        except RuleError:
            out.append((name,))
    assert parse_term("count($X)").function == "count"
    return spark.createDataFrame(out, "refused string")


@query("SELECT * FROM (VALUES ('cyclic', 'model'), ('depends_transitive', 'from,to'), ('impacted_by', 'changed,impacted'), ('observation', '')) t(relation, keys)")
def e1_e3_relation_listing(spark, path):
    stored = [r["relation"] for r in document_facts(spark, path).select("relation").distinct().collect()]
    listing = relation_listing([Rule.parse(r) for r in CONVERGENCE_RULES], stored)
    return spark.createDataFrame([(r, ",".join(k)) for r, k in listing.items()], "relation string, keys string")


# Stores -----------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM nation) AS committed, 0 AS after_rollback, 2 AS version, true AS conflict")
def m4_transactions(spark, path):
    tables = Tables(spark, shared_folder(spark, "store"))
    rows = Data(spark, path).nation.select(F.col("n_nationkey").cast("long").alias("k"))
    with tables.transaction() as tx:
        tx.write("t", rows)
    try:
        with tables.transaction() as tx:
            tx.write("t", rows.limit(0))
            lost = tx.read("t", "k long").count()
            raise ZeroDivisionError
    except ZeroDivisionError:
        pass
    conflict = False
    try:
        with tables.transaction() as tx:
            tx.write("t", rows)
            with Tables(spark, tables.path).transaction() as other:
                other.write("t", rows)
    except RuntimeError:
        conflict = True
    return spark.createDataFrame([(tables.read("t", "k long").count(), lost, tables.version(), conflict)], "committed long, after_rollback int, version int, conflict boolean")


@query("WITH d AS (SELECT sha256('{\"source\":\"' || source || '\",\"text\":' || n || '}') AS id FROM (SELECT DISTINCT source, n_chars AS n FROM documents)) SELECT 'item' AS entry_type, count(*) AS n FROM d UNION ALL SELECT 'collection', 1")
def m17_i2_collection_commit(spark, path):
    record = F.concat(F.lit('{"text": '), F.col("n_chars").cast("string"), F.lit(', "source": "'), "source", F.lit('"}'))
    tables = Tables(spark, shared_folder(spark, "store"))
    imports.commit_collection(tables, "c", Data(spark, path).documents.select(record.alias("record"), F.col("doc_id").alias("item_index")), NOW)
    entries = tables.read("entries", ENTRIES)
    return entries.groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 's' || s_suppkey AS \"from\", 'n' || s_nationkey AS \"to\", s_acctbal <= 0 AS closed FROM supplier")
def m14_edge_facts(spark, path):
    store = FactStore(spark, shared_folder(spark, "store"))
    edges = Data(spark, path).supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("from"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("to"), "s_acctbal")
    store.reconcile_edges("model_depends_on", "declared", edges.select("from", "to"), 10)
    store.reconcile_edges("model_depends_on", "declared", edges.where("s_acctbal > 0").select("from", "to"), 20)
    get = lambda k: F.get_json_object("args", f"$.{k}").alias(k)
    return store.facts().select(get("from"), get("to"), F.col("valid_end").isNotNull().alias("closed"))


@query("WITH e AS (SELECT '{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}' AS r FROM documents) SELECT sha256(r) AS id, 'item' AS entry_type, 'base/core.#Item' AS schema, 'json' AS format, CAST(length(r) AS BIGINT) AS size_bytes FROM e UNION ALL SELECT 'c', 'collection', 'base/core.#Item', 'json', NULL")
def e8_s26_import_and_list(spark, path):
    folder = shared_folder(spark, "workspace")
    rows = Data(spark, path).documents.select(F.to_json(F.struct("doc_id", "source")).alias("record"), F.col("doc_id").alias("item_index"))
    imports.commit_collection(Tables(spark, folder), "c", rows, NOW, schema="base/core.#Item", origin="documents")
    listed = Workspace(spark, folder, read_only=True).list_catalog(Filters(schema="core", origin="DOC"), sort="size")
    return listed.select("id", "entry_type", "schema", "format", "size_bytes")


@query("SELECT 'bug' AS kind, 'it broke' AS description, 'repo:path' AS scope, 'human' AS source UNION ALL SELECT 'pattern', 'it repeats', NULL, NULL")
def m18_e2_observations(spark, path):
    store = FactStore(spark, shared_folder(spark, "store"))
    store.observe("bug", "it broke", NOW, scope="repo:path", source="human")
    store.observe("pattern", "it repeats", NOW)
    get = lambda k: F.get_json_object("args", f"$.{k}").alias(k)
    return store.query_facts("observation").select(get("kind"), get("description"), get("scope"), "source")


# Sources and streams ----------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str, folder: str) -> None:
    line = F.when(F.col("event_type") == "error", "{broken").otherwise(F.to_json(F.struct("user_id", "event_type")))
    Data(spark, path).events.select(line.alias("value")).repartition(3).write.text(folder)


@query("SELECT user_id, event_type, 0 AS rejected FROM events WHERE event_type <> 'error' GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*) FROM events WHERE event_type = 'error'")
def st6_incremental_ingest(spark, path):
    base = shared_folder(spark, "stream")
    _lines(spark, path, f"{base}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(spark, f"{base}/in", f"{base}/store", f"{base}/progress", files_per_batch=2).awaitTermination()
    tables = Tables(spark, f"{base}/store")
    items = tables.read("items", ITEMS).select(F.get_json_object("record", "$.user_id").cast("long").alias("user_id"), F.get_json_object("record", "$.event_type").alias("event_type"), F.lit(0).cast("long").alias("rejected"))
    none = F.lit(None)
    return items.unionByName(tables.read("rejected", REJECTED).agg(F.sum("lines").alias("rejected")).select(none.cast("long").alias("user_id"), none.cast("string").alias("event_type"), "rejected"))


@query("SELECT event_id, event_type FROM events")
def s10_s17_s23_export_and_glob(spark, path):
    base = shared_folder(spark, "export")
    rows = Data(spark, path).events.select(F.to_json(F.struct("event_id", "event_type")).alias("record"))
    formats.export(rows, f"{base}/out", "ndjson")
    back = formats.read_ndjson(spark, f"{base}/out/part-*")
    return back.select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), F.get_json_object("record", "$.event_type").alias("event_type"))


@query("SELECT count(*) AS n, count(*) FILTER (event_id % 20 = 0) AS bad, true AS tolerable FROM events")
def st4_error_tolerance(spark, path):
    line = F.when(F.col("event_id") % 20 == 0, "{broken").otherwise('{"a": 1}')
    rows = Data(spark, path).events.select(line.alias("record")).withColumn("error", F.when(F.try_parse_json("record").isNull(), "not JSON"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"))
    return counts.withColumn("tolerable", F.lit(formats.tolerable(rows)))


# Schemas and loops ------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('tpc.#SmallPart', 1), ('tpc.#Part', 2)) t(schema, place)")
def o7_candidate_order(spark, path):
    found = _registry().candidates({"p_name": "x", "p_size": 3})
    return spark.createDataFrame([(n, k + 1) for k, (n, _) in enumerate(found) if n.startswith("tpc")], "schema string, place int")


@query("SELECT 'OK' AS outcome, count(*) AS n FROM part WHERE p_size <= 20 AND p_partkey % 9 <> 0 UNION ALL SELECT 'INVALID', count(*) FROM part WHERE p_size > 20 OR p_partkey % 9 = 0")
def i9_verify(spark, path):
    record = F.when(F.col("p_partkey") % 9 == 0, '{"other":1}').otherwise(F.to_json(F.struct("p_name", "p_size")))
    return schemas.verify(Data(spark, path).part.select(record.alias("record"), F.lit("tpc.#SmallPart").alias("schema")), _registry())


@query("SELECT * FROM (VALUES ('missing', 'b: missing'), ('kind', 'a: not int'), ('bound', 'a: over 9'), ('enum', 'b: not one of x, y'), ('pattern', 'c: does not match'), ('closed', 'd: not allowed'), ('element', 'l[1]: not string')) t(name, problem)")
def i13_constraints(spark, path):
    Fd = schemas.Field
    fields = {"a": Fd("int", most=9), "b": Fd("string", enum=("x", "y")), "c": Fd("string", required=False, pattern="^c"), "l": Fd("list", required=False, element=Fd("string"))}
    cases = {"missing": {"a": 1}, "kind": {"a": "1", "b": "x"}, "bound": {"a": 10, "b": "x"}, "enum": {"a": 1, "b": "z"}, "pattern": {"a": 1, "b": "x", "c": "d"}, "closed": {"a": 1, "b": "x", "d": 1}, "element": {"a": 1, "b": "y", "l": ["s", 2]}}
    return spark.createDataFrame([(n, "; ".join(schemas.record_errors(r, fields, closed=True))) for n, r in cases.items()], "name string, problem string")


@query("SELECT * FROM (VALUES ('gen.#Item', 2), ('gen.#Collection', 0)) t(name, fields)")
def i15_generated_collection(spark, path):
    record = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct("p_name", "p_size"))).otherwise(F.to_json(F.struct("p_brand", "p_type")))
    made = schemas.generate_collection(Data(spark, path).part.select(record.alias("record")), _registry(), "gen")
    return spark.createDataFrame([(s.name, len(s.fields)) for s in made], "name string, fields int")


@query("SELECT * FROM (VALUES ('clean', 'clean', 2, 'clean'), ('capped', 'failed:cap-exhausted', 3, 'failed'), ('budget', 'failed:budget-exhausted', 1, 'failed'), ('dry', 'dry-run', 0, ''), ('lost', 'needs-verification', 1, 'unknown')) t(name, outcome, applies, verdict)")
def r8_r9_convergence(spark, path):
    def run(after: int, record=None, **options):
        state = {"n": 0}
        return reconcile.converge(lambda: state["n"] >= after, lambda: state.update(n=state["n"] + 1), record, **options)

    def fail(_):
        raise OSError("no receipt")

    runs = {"clean": run(2), "capped": run(9), "budget": run(9, budget=1), "dry": run(2, dry_run=True), "lost": run(2, fail)}
    rows = [(n, r.outcome, r.iterations, reconcile.run_verdict(r, dry_run=n == "dry")) for n, r in runs.items()]
    return spark.createDataFrame(rows, "name string, outcome string, applies int, verdict string")


@query("SELECT doc_id, n_chars / 1000.0 AS worth FROM (SELECT *, rank() OVER (ORDER BY n_chars DESC) AS r FROM documents) WHERE r <= 15")
def w6_o3_top_with_ties(spark, path):
    worth = F.to_json(F.struct((F.col("n_chars") / 1000.0).alias("worth")))
    f = document_facts(spark, path).select("id", "relation", "source", "valid_end", "tx_start", "tx_end", "provenance", F.lit(NOW).cast("long").alias("valid_start"))
    f = f.join(Data(spark, path).documents.select(F.col("doc_id").cast("string").alias("id"), worth.alias("args")), "id")
    return facts.top_by_worth(f, NOW, 15).select(F.col("id").cast("long").alias("doc_id"), "worth")


@query("SELECT event_id, user_id FROM events ORDER BY date_trunc('day', ts) DESC, event_id DESC LIMIT 1")
def o3_newest(spark, path):
    return catalog.newest(Data(spark, path).events.withColumn("day", F.date_trunc("day", "ts")), 1, "day", "event_id").select("event_id", "user_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'unknown' WHEN o_orderstatus = 'O' THEN 'failed'
WHEN o_totalprice > 400000 THEN '' WHEN o_totalprice > 300000 THEN 'drifted' WHEN o_orderpriority = '5-LOW' THEN 'drifted' ELSE 'clean' END AS verdict FROM orders""")
def r9_run_verdicts(spark, path):
    status, price, priority = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    runs = Data(spark, path).orders.select(
        "o_orderkey", F.when(status == "O", "failed:cap-exhausted").alias("outcome"), (priority == "1-URGENT").alias("needs_verification"), (price <= 300_000).alias("drift_clean"),
        (price <= 400_000).alias("verified"), F.when(priority == "5-LOW", 2).otherwise(0).alias("failed_checks"), (status == "P").alias("dry_run"),
    )
    return reconcile.run_verdicts(runs).select("o_orderkey", "verdict")


@query("SELECT n_nationkey, sha256('{\"models\":[\"n' || n_nationkey || '\",\"r' || n_regionkey || '\"],\"only\":null}') AS digest FROM nation")
def e7_plan_digest(spark, path):
    plan = F.concat(F.lit('{"only": null, "models": ["n'), F.col("n_nationkey").cast("string"), F.lit('", "r'), F.col("n_regionkey").cast("string"), F.lit('"]}'))
    return Data(spark, path).nation.select("n_nationkey", reconcile.plan_digest(plan).alias("digest"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def t7_time_literals(spark, path):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(event_second("ts").cast("string"))
    return Data(spark, path).events.select("event_id", facts.time_seconds(text).alias("seconds"))


@query("SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' UNION SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def u2_set_union(spark, path):
    rules = [rule({"s": "$S"}, ("lineitem", {"l_suppkey": "$S", "l_returnflag": "R"})), rule({"s": "$S"}, ("lineitem", {"l_suppkey": "$S", "l_linestatus": "O"})), rule({"s": "$S"}, ("r", {"s": "$S"}))]
    return Engine(Relations({"lineitem": Data(spark, path).lineitem}), rules).query("r")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2")
def u5_e6_shadowed_rules(spark, path):
    of = lambda region: {"of_region": Rule.parse(rule({"name": "$N"}, ("nation", {"n_name": "$N", "n_regionkey": region})), "of_region")}
    return Engine(Relations({"nation": Data(spark, path).nation}), shadowed([of(1), of(2)])).query("r")
