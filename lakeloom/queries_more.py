"""More registered queries: sources, changes of facts and catalog, and the pieces of an import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import ids, json_values
from lakeloom.operators import catalog, facts, reconcile, schemas, search
from lakeloom.plans.engine import Engine
from lakeloom.plans.lineage import shared_folder
from lakeloom.plans.relations import Relations, Scope
from lakeloom.plans.rules import CONVERGENCE_RULES
from lakeloom.queries import _DOC_FACTS_SQL, _ENTRIES_SQL, _FACTS_SQL, _MID, _MEMBERS_SQL, NOW, Data, _middle, _registry, conversation_members, document_entries, document_facts, event_facts, query, rule
from lakeloom.sources import formats, imports

_NONE = "CAST(NULL AS VARCHAR)"


def files(spark: SparkSession, path: str, content: Column, name: str = "f") -> DataFrame:
    """A made file for each nation."""
    key = F.col("n_nationkey").cast("string")
    return Data(spark, path).nation.select(F.concat(F.lit(name), key).alias("path"), content.alias("content"))


_KEY = "CAST(n_nationkey AS VARCHAR)"


# Sources ----------------------------------------------------------------------------------------


@query(f"SELECT 'f' || {_KEY} AS path, unnest(range(3)) AS position, '{{\"k\":' || {_KEY} || '}}' AS record FROM nation")
def s9_s12_json_array(spark, path):
    item = F.concat(F.lit('{"k": '), F.col("n_nationkey").cast("string"), F.lit("}"))
    return formats.json_records(files(spark, path, F.concat(F.lit("["), item, F.lit(", "), item, F.lit(",\n"), item, F.lit("]"))))


@query(f"SELECT 'f' || {_KEY} AS path, CAST(0 AS BIGINT) AS position, '{{\"a\":' || {_KEY} || ',\"b\":\"x\"}}' AS record FROM nation")
def s9_s28_json_object(spark, path):
    return formats.json_records(files(spark, path, F.concat(F.lit('{"b": "x",\n"a": '), F.col("n_nationkey").cast("string"), F.lit("}"))))


@query(f"SELECT 'f' || {_KEY} || '.yaml' AS path, unnest([0, 1])::BIGINT AS position, '{{\"n\": ' || {_KEY} || '}}' AS record, {_NONE} AS error FROM nation")
def s13_yaml_documents(spark, path):
    doc = F.concat(F.lit("n: "), F.col("n_nationkey").cast("string"), F.lit("\n"))
    rows = files(spark, path, F.concat(doc, F.lit("---\n"), doc)).withColumn("path", F.concat("path", F.lit(".yaml")))
    return formats.yaml_records(rows)


@query(f"SELECT 'f' || {_KEY} AS path, i AS position, CASE i WHEN 0 THEN '{{\"name\": \"' || n_name || '\", \"size\": ' || {_KEY} || ', \"_row_number\": 1, \"_column_count\": 2}}' ELSE '{{\"name\": null, \"size\": 1.5, \"col_2\": true, \"_row_number\": 2, \"_column_count\": 3}}' END AS record, {_NONE} AS error FROM (SELECT *, unnest(range(2)) AS i FROM nation)")
def s14_csv_records(spark, path):
    return formats.csv_records(files(spark, path, F.concat(F.lit("name, size\n"), "n_name", F.lit(","), F.col("n_nationkey").cast("string"), F.lit("\n,1.5,true\n"))))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, sha256(text) AS hash FROM documents")
def s15_generic(spark, path):
    d = Data(spark, path).documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    get = lambda k: F.get_json_object("record", f"$.{k}")
    return formats.generic_records(d).select(F.col("path").cast("long").alias("doc_id"), get("size").cast("long").alias("size"), get("lines").cast("long").alias("lines"), get("hash").alias("hash"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zstd' WHEN 2 THEN 'gzip' ELSE 'none' END AS codec FROM nation")
def s16_compression(spark, path):
    k = F.col("n_nationkey") % 4
    head = F.when(k == 1, F.unhex(F.lit("28B52FFD00"))).when(k == 2, F.unhex(F.lit("1F8B0800"))).otherwise(F.encode(F.lit("text"), "UTF-8"))
    return Data(spark, path).nation.select("n_nationkey", formats.compression(F.when(k == 0, "a.json.gz").otherwise("a.json"), head).alias("codec"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'yaml' ELSE 'generic' END AS processor FROM nation")
def s19_probe(spark, path):
    k = F.col("n_nationkey") % 4
    content = F.when(k == 0, ' {"a": 1}').when(k == 1, "a,b\n1,2").when(k == 2, "a: 1\nb: 2").otherwise("words only")
    return Data(spark, path).nation.select("n_nationkey", formats.probe_processor(content).alias("processor"))


@query(f"SELECT entry_type, target, status FROM (SELECT 'manifest' AS entry_type, {_NONE} AS target, {_NONE} AS status FROM nation UNION ALL SELECT 'action', 'n' || {_KEY}, 'converging' FROM nation UNION ALL SELECT 'action', 'x', 'failed' FROM nation)")
def s22_manifest(spark, path):
    record = F.concat(F.lit('{"summary":{},"actions":[{"target":"//n'), F.col("n_nationkey").cast("string"), F.lit('","status":"ok"},{"target":"x","status":"failed"}]}'))
    return formats.manifest_rows(Data(spark, path).nation.select(record.alias("record"))).select("entry_type", "target", "status")


@query("SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'error') AS rejected FROM events WHERE event_type <> 'error'")
def s10_s11_ndjson_lines(spark, path):
    folder = shared_folder(spark, "lines")
    line = F.when(F.col("event_type") == "error", "{broken").otherwise(F.to_json(F.struct("event_id", "event_type")))
    Data(spark, path).events.select(line.alias("value")).write.text(folder)
    rejected = formats.ndjson_lines(spark, folder).agg(F.count("error").alias("rejected"))
    rows = formats.read_ndjson(spark, folder, strict=False).select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), F.get_json_object("record", "$.event_type").alias("event_type"))
    return rows.crossJoin(F.broadcast(rejected))  # one row


@query("SELECT doc_id, 'raw/2024/01/02/' || substr(sha256(text), 1, 16) || '.txt' AS stored FROM documents")
def s24_payload_path(spark, path):
    day = F.lit("2024-01-02").cast("date")
    return Data(spark, path).documents.select("doc_id", imports.staged_path(ids.content_hash(F.col("text")), day, ".txt").alias("stored"))


@query(f"WITH {_ENTRIES_SQL} SELECT id, origin FROM entries WHERE id = 'd17'")
def s5_s27_lookup(spark, path):
    return facts.lookup(document_entries(spark, path), "d17").select("id", "origin")


@query(f"WITH {_MEMBERS_SQL}, one AS (SELECT item_id, min(collection_id) AS collection_id FROM memberships GROUP BY item_id HAVING count(*) = 1) SELECT DISTINCT role, collection_id FROM items LEFT JOIN one ON id = item_id WHERE role = 'user'")
def s6_catalog_relation(spark, path):
    members, items = conversation_members(spark, path)
    engine = Engine(Relations({"catalog_entry": catalog.curated_view(items, members)}, reserved={"catalog_entry"}), [rule({"role": "$R", "collection_id": "$C"}, ("catalog_entry", {"role": "$R", "collection_id": "$C"}), ("catalog_entry", {"role": "user", "collection_id": "$D", "id": "$I"}), ("catalog_entry", {"id": "$I", "role": "$R"}))])
    return engine.query("r").where("role = 'user'")


@query(f"WITH {_FACTS_SQL} SELECT event_id FROM facts WHERE relation = 'signup' AND valid_end IS NULL AND tx_end IS NULL AND CAST(json_extract(args, '$.worth') AS INTEGER) = 2")
def s8_p7_stored_relation(spark, path):
    return Engine(Relations(facts=event_facts(spark, path)), []).query("signup", {"worth": "2.0"}).select("event_id")


# Facts ------------------------------------------------------------------------------------------


@query("SELECT doc_id, '{\"a\":' || doc_id || ',\"b\":{\"c\":1,\"d\":\"' || lang || '\"}}' AS canonical FROM documents")
def f3_canonical_json(spark, path):
    raw = F.concat(F.lit('{ "b": {"d":"'), "lang", F.lit('", "c": 1.0}, "a":'), F.col("doc_id").cast("string"), F.lit("}"))
    return Data(spark, path).documents.select("doc_id", json_values.canonical_json(raw).alias("canonical"))


@query(f"WITH {_DOC_FACTS_SQL} SELECT doc_id, doc_id || ' ' || kind || ' ' || scope AS text FROM docs")
def f11_search_text(spark, path):
    return document_facts(spark, path).select(F.col("id").cast("long").alias("doc_id"), search.search_text(F.col("args")).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '{\"meta.name\":\"' || event_type || '\",\"tags\":\"t' || user_id || '\"}' END AS identity FROM events")
def f8_identity(spark, path):
    tags = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(',"tags":["t'), F.col("user_id").cast("string"), F.lit('","u"]'))).otherwise("")
    record = F.concat(F.lit('{"meta":{"name":"'), "event_type", F.lit('"}'), tags, F.lit("}"))
    return Data(spark, path).events.select("event_id", imports.identity_json(record, ["tags", "meta.name"]).alias("identity"))


@query(f"WITH {_FACTS_SQL} SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id FROM facts UNION SELECT sha256('extra' || chr(0) || '{{\"n\":' || n_nationkey || '}}' || chr(0) || '5' || chr(0) || 's') FROM nation)")
def m1_s25_add_facts(spark, path):
    held = event_facts(spark, path).drop("event_id").dropDuplicates(["id"])
    args = F.concat(F.lit('{"n": '), F.col("n_nationkey").cast("string"), F.lit("}"))
    new = Data(spark, path).nation.select(F.lit("extra").alias("relation"), args.alias("args"), F.lit(5).cast("long").alias("valid_start"), F.lit("s").alias("source"))
    return facts.add(facts.add(held, new, NOW), new, NOW).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query(f"WITH {_DOC_FACTS_SQL} SELECT doc_id, CASE WHEN doc_id = 3 THEN {NOW} END AS valid_end, CASE WHEN doc_id = 4 THEN {NOW} END AS tx_end FROM docs")
def m2_m3_retract_invalidate(spark, path):
    f = facts.retract(facts.invalidate(document_facts(spark, path), "3", NOW), "4", NOW)
    return f.select(F.col("id").cast("long").alias("doc_id"), "valid_end", "tx_end")


@query("SELECT 'pattern' AS kind, 'reviewed' AS status, '1' AS prev, 2 AS open_before, 1 AS closed")
def m5_promote(spark, path):
    held, made = facts.promote(document_facts(spark, path).where("id in ('1', '2')").withColumn("args", F.regexp_replace("args", '"(fact|pattern)"', '"pattern"')), "1", "reviewed", NOW)
    row = held.where(F.col("id") == made)
    get = lambda k: F.get_json_object("args", f"$.{k}")
    counts = held.agg(F.count_if(F.col("valid_end").isNull()).cast("int").alias("open_before"), F.count_if(F.col("valid_end").isNotNull()).cast("int").alias("closed"))
    return row.select(get("kind").alias("kind"), get("status").alias("status"), get("prevVersion").alias("prev")).crossJoin(counts)  # one row each


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'kind' WHEN doc_id % 4 = 1 THEN 'worth' WHEN doc_id % 4 = 2 THEN 'status' END AS bad FROM documents")
def i12_write_validation(spark, path):
    k = F.col("doc_id") % 4
    args = F.to_json(F.struct(F.when(k == 0, "odd").otherwise("bug").alias("kind"), F.lit("d").alias("description"), F.when(k == 1, 1.5).otherwise(0.5).alias("worth"), F.when(k == 2, "new").otherwise("raw").alias("status")))
    return Data(spark, path).documents.select("doc_id", facts.invalid(args, F.lit("observation")).alias("bad"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, event_id AS b FROM events WHERE event_type = 'view' AND event_id <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events WHERE event_type = 'view')), c AS (SELECT a, b FROM e UNION SELECT e.a, c.b FROM e JOIN c ON e.b = c.a) SELECT CAST(a AS VARCHAR) AS \"from\", CAST(b AS VARCHAR) AS \"to\" FROM c")
def t6_closure_as_of(spark, path):
    e = Data(spark, path).events.where("event_type = 'view'")
    args = F.concat(F.lit('{"from":'), F.col("user_id").cast("string"), F.lit(',"to":'), F.col("event_id").cast("string"), F.lit("}"))
    none = F.lit(None)
    f = e.select(F.col("event_id").cast("string").alias("id"), F.lit("model_depends_on").alias("relation"), args.alias("args"), F.col("event_id").alias("valid_start"), none.cast("long").alias("valid_end"), F.lit(0).cast("long").alias("tx_start"), none.cast("long").alias("tx_end"), F.lit("s").alias("source"), none.cast("string").alias("provenance"))
    return Engine(Relations(facts=f), CONVERGENCE_RULES).query("depends_transitive", scope=Scope(valid_at=_middle(f)))


@query(f"WITH {_FACTS_SQL} SELECT source, count(*) AS n FROM facts, {_MID} WHERE valid_start > m AND source = 'u1' GROUP BY source")
def p14_a9_source_after_query(spark, path):
    f = event_facts(spark, path)
    return facts.statistics(f.withColumns({"valid_end": F.lit(None).cast("long"), "tx_end": F.lit(None).cast("long")}).where(F.col("valid_start") > _middle(f)), ["source"]).where("source = 'u1'")


@query("WITH t AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id FROM t WHERE list_contains(w, 'license') AND source = 'src3'")
def j11_o4_search_facts(spark, path):
    d = Data(spark, path).documents
    none = F.lit(None)
    f = d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("r_"), "source").alias("relation"), F.to_json(F.struct("text")).alias("args"), none.cast("long").alias("valid_end"), none.cast("long").alias("tx_end"))
    return search.search(f, "license", relation="r_src3", limit=None).select(F.col("id").cast("long").alias("doc_id"))


# Catalog changes --------------------------------------------------------------------------------

_STATES_SQL = "states AS (SELECT event_id AS id, 't' || (user_id % 5) AS definition, CASE WHEN event_type = 'click' THEN 'converging' ELSE 'unknown' END AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'm' || (event_id % 3) END AS model, event_id AS import_timestamp FROM events)"


def states(spark: SparkSession, path: str) -> DataFrame:
    e = Data(spark, path).events
    tags = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"model":"m'), (F.col("event_id") % 3).cast("string"), F.lit('"}')))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("definition"), F.when(F.col("event_type") == "click", "converging").otherwise("unknown").alias("status"), tags.alias("tags"), F.col("event_id").alias("import_timestamp"))


@query(f"WITH {_STATES_SQL} SELECT id, CASE WHEN definition = 't2' AND id = (SELECT max(id) FROM states WHERE definition = 't2') THEN 'drifted' ELSE status END AS status FROM states")
def m10_update_status(spark, path):
    return catalog.update_status(states(spark, path), "t2", "drifted").select("id", "status")


@query(f"WITH {_STATES_SQL} SELECT id, CASE WHEN status = 'converging' AND definition IN ('t1', 't3') AND (model IS NULL OR model = 'm1') THEN 'clean' ELSE status END AS status FROM states")
def m11_p13_promote_converging(spark, path):
    return catalog.promote_converging(states(spark, path), ["t1", "t3"], "m1")[0].select("id", "status")


@query("SELECT user_id AS run_id, count(*) FILTER (event_type = 'click') AS applies, count(*) FILTER (event_type = 'click') > count(*) FILTER (event_type = 'view') AS needs_verification, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'running' ELSE 'succeeded' END AS completion_status FROM events GROUP BY user_id")
def m12_run_lifecycle(spark, path):
    kinds = F.create_map(*(F.lit(x) for pair in {"signup": "start", "click": "apply", "view": "receipt", "purchase": "finish", "error": "other"}.items() for x in pair))
    log = Data(spark, path).events.select(F.col("user_id").alias("run_id"), F.lit("m").alias("model"), kinds[F.col("event_type")].alias("kind"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "purchase", "clean").alias("verdict"), F.lit(False).alias("scoped"))
    return catalog.fold_runs(log).select("run_id", "applies", "needs_verification", "completion_status")


@query(f"WITH {_ENTRIES_SQL} SELECT id, CASE WHEN id = 'd5' THEN 'elsewhere' ELSE origin END AS origin, CASE WHEN id = 'new' THEN 'base/core.#Item' ELSE schema END AS schema FROM (SELECT id, origin, schema FROM entries UNION ALL SELECT 'new', 'o', 'x')")
def m7_add_update_entries(spark, path):
    e = document_entries(spark, path)
    e = catalog.add_entries(e, spark.createDataFrame([("new", "core.#Item", "o"), ("d5", "x", "y")], "id string, schema string, origin string"))
    return catalog.update_entries(e, spark.createDataFrame([("d5", "elsewhere")], "id string, origin string")).select("id", "origin", "schema")


@query("SELECT doc_id AS item_id, 's' || (doc_id % 3) AS schema_ref, CASE WHEN doc_id % 3 = 1 THEN 'declared' WHEN doc_id % 10 = 0 THEN 'inferred' ELSE 'unresolved' END AS status FROM documents WHERE NOT (doc_id % 3 = 1 AND doc_id % 10 = 0) UNION ALL SELECT doc_id, 's1', 'inferred' FROM documents WHERE doc_id % 3 = 1 AND doc_id % 10 = 0")
def m15_item_schemas(spark, path):
    d = Data(spark, path).documents
    rows = d.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("schema_ref"), F.lit("unresolved").alias("status"), F.lit(1).cast("long").alias("classified_at"))
    newer = rows.where("item_id % 10 = 0").withColumn("status", F.lit("inferred")).withColumn("classified_at", F.lit(2).cast("long"))
    out = catalog.reclassify(catalog.upsert_item_schemas(rows, newer), spark.createDataFrame([("s1",)], "schema_ref string"))
    return out.select("item_id", "schema_ref", "status")


@query(f"WITH {_MEMBERS_SQL} SELECT role AS schema, count(*) AS n FROM items WHERE id IN (SELECT item_id FROM memberships WHERE collection_id = 'c2') GROUP BY role")
def a15_schema_distribution(spark, path):
    members, items = conversation_members(spark, path)
    return catalog.schema_distribution(items.withColumnRenamed("role", "schema"), members, "c2")


@query("SELECT p_partkey AS id, 'tpc.#Part' AS old_schema, CASE WHEN p_partkey % 9 = 0 THEN 'base/core.#Item' ELSE 'tpc.#SmallPart' END AS new_schema FROM part WHERE p_partkey % 9 = 0 OR p_size <= 20")
def m16_i9_reinference(spark, path):
    record = F.when(F.col("p_partkey") % 9 == 0, '{"other":1}').otherwise(F.to_json(F.struct("p_name", "p_size")))
    return schemas.reinfer(Data(spark, path).part.select(F.col("p_partkey").alias("id"), F.lit("tpc.#Part").alias("schema"), record.alias("record")), _registry())


# Import -----------------------------------------------------------------------------------------


@query("WITH h AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, 'u' || user_id AS who FROM h")
def i4_identity_versions(spark, path):
    e = Data(spark, path).events.select("event_id", F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("who"), "event_type")).alias("record"))
    known = spark.createDataFrame([], "content_hash string, resource_id string, version int")
    out = imports.import_items(e, known, "base/event.#Event", ["who"], ["event_id"])
    return out.select("event_id", F.col("version").cast("long").alias("version"), F.get_json_object("identity_json", "$.who").alias("who"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'mapped.#X' WHEN 1 THEN 'base/linux.#Host' WHEN 2 THEN 'guessed.#Y' ELSE 'base/core.#Observation' END AS schema FROM nation")
def i7_observation_schema(spark, path):
    k = F.col("n_nationkey") % 4
    return Data(spark, path).nation.select("n_nationkey", imports.observation_schema(F.lit("linux.host"), F.when(k == 0, "mapped.#X"), k == 1, F.when(k == 2, "guessed.#Y"), "base/core.#Observation").alias("schema"))


@query("SELECT * FROM (VALUES ('p_name', 'string', true), ('p_retailprice', 'number', true), ('p_size', 'int', false)) t(field, kind, required)")
def i10_generated_schema(spark, path):
    record = F.to_json(F.struct("p_name", (F.col("p_retailprice") + 0.001).alias("p_retailprice"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("p_size")))
    made = schemas.generate_schema(Data(spark, path).part.select(record.alias("record")), "gen.#Part")
    return spark.createDataFrame([(n, f.kind, f.required) for n, f in made.fields.items()], "field string, kind string, required boolean")


@query("SELECT 'part' AS pattern, round(avg(CASE WHEN p_partkey % 2 = 0 THEN 0.8 + 0.1 ELSE 0.8 END), 9) AS score FROM part")
def i11_pattern(spark, path):
    record = F.to_json(F.struct("p_name", "p_size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("p_brand")))
    patterns = {"part": (["p_name", "p_size"], ["p_brand", "p_none"]), "order": (["o_orderkey"], ["p_name"])}
    return schemas.best_pattern(Data(spark, path).part.select(record.alias("record")), patterns).select("pattern", F.round("score", 9).alias("score"))


# Reconciliation ---------------------------------------------------------------------------------


@query("SELECT 's' || s_suppkey AS resource, CASE WHEN s_suppkey % 3 = 0 THEN 'missing' ELSE 'changed' END AS reason FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0")
def r3_differential(spark, path):
    s = Data(spark, path).supplier
    item = F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("resource"), (F.col("s_suppkey") % 3 != 0).alias("exists"), (F.col("s_suppkey") % 5 != 0).alias("matches"), F.lit("d").alias("diff"))
    rows = s.groupBy(F.col("s_nationkey").cast("string").alias("target")).agg(F.collect_list(item).alias("resources")).withColumn("error", F.lit(""))
    return reconcile.differential_drift(rows).select("resource", "reason")


@query("SELECT 'observation' AS relation, 'tpc drifted: ' || count(*) || ' resources' AS description FROM part WHERE p_partkey % 7 = 0")
def r12_drift_observation(spark, path):
    drift = Data(spark, path).part.where("p_partkey % 7 = 0").select(F.col("p_name").alias("resource"), F.lit("missing").alias("reason"), F.lit("").alias("diff"))
    return reconcile.drift_observation(drift, "tpc", NOW).select("relation", F.get_json_object("args", "$.description").alias("description"))


@query(f"WITH {_ENTRIES_SQL} SELECT id FROM entries WHERE origin = 'src2'")
def r2_scope(spark, path):
    e = document_entries(spark, path)
    none = spark.createDataFrame([], "collection_id string, item_id string, snapshot_id string")
    return reconcile.resolve_scope(e, none, none, "unknown", "src2").select("id")


@query("SELECT p_partkey, p_partkey % 4 < 2 AS advisory FROM part")
def r5_selection(spark, path):
    targets = F.array(F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")), F.lit("other"))
    return Data(spark, path).part.select("p_partkey", (~reconcile.in_selection(targets, ["t2", "t3"])).alias("advisory"))


@query("SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O')")
def u4_intersection(spark, path):
    li = Data(spark, path).lineitem
    rules = [rule({"s": "$S"}, ("lineitem", {"l_suppkey": "$S", "l_returnflag": "R"}), ("open", {"l_suppkey": "$S"}))]
    return Engine(Relations({"lineitem": li, "open": li.where("l_linestatus = 'O'").select("l_suppkey").distinct()}), rules).query("r")


@query(f"WITH {_FACTS_SQL} SELECT event_id, row_number() OVER (ORDER BY valid_start, id) AS place FROM facts WHERE relation = 'purchase' ORDER BY valid_start, id LIMIT 50")
def o6_history_order(spark, path):
    rows = facts.history(event_facts(spark, path), "purchase").limit(50)
    return rows.withColumn("place", F.monotonically_increasing_id() + 1).select("event_id", "place")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def st2_record_dedup(spark, path):
    rows = Data(spark, path).documents.withColumn("content_hash", ids.content_hash(F.col("text")))
    return imports.new_items(rows, spark.createDataFrame([], "content_hash string"), ["doc_id"]).select("doc_id", "source")
