"""Registered queries over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import ids, json_values, names, scores
from lakeloom.operators import catalog, curation, facts, graph, reconcile, schemas, search
from lakeloom.plans.engine import Engine
from lakeloom.plans.relations import Relations, Scope
from lakeloom.plans.rules import CONVERGENCE_RULES
from lakeloom.sources import formats, imports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: "Now" of every query, so that results do not change.
NOW = 1_800_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Data:
    """Tables of one folder by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def rule(head: dict, *body: tuple[str, dict], name: str = "r") -> dict:
    return {"head": {"rel": name, "args": head}, "body": [{"rel": r, "args": a} for r, a in body]}


def ask(spark: SparkSession, path: str, rules: list[dict], constraints: dict | None = None, name: str = "r", **native: DataFrame) -> DataFrame:
    data = Data(spark, path)
    wanted = {a["rel"] for r in rules for a in r["body"]} - {r["head"]["rel"] for r in rules} - set(native)
    return Engine(Relations({w: getattr(data, w) for w in wanted} | native), rules).query(name, constraints)


# Rules: projection, filters ---------------------------------------------------------------------


@query("SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem")
def p1_p2_project_distinct(spark, path):
    return ask(spark, path, [rule({"flag": "$F", "status": "$S"}, ("lineitem", {"l_returnflag": "$F", "l_linestatus": "$S"}))])


@query("SELECT DISTINCT p_partkey AS part, p_brand AS brand FROM part WHERE p_size = 10")
def p3_ground_term(spark, path):
    return ask(spark, path, [rule({"part": "$P", "brand": "$B"}, ("part", {"p_partkey": "$P", "p_brand": "$B", "p_size": 10}))])


def _comparison(op: str):
    @query(f"SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_quantity {op.replace('!=', '<>')} 40")
    def compare(spark, path):
        return ask(spark, path, [rule({"o": "$O", "n": "$N"}, ("lineitem", {"l_orderkey": "$O", "l_linenumber": "$N", "l_quantity": f"{op}40"}))])

    return compare


for _name, _op in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "ne": "!="}.items():
    _f = _comparison(_op)
    for _held in (QUERIES, ORACLES):
        _held[f"p4_compare_{_name}"] = _held.pop("compare")


@query("SELECT DISTINCT l_orderkey AS o, l_partkey AS k FROM lineitem WHERE l_partkey = l_suppkey")
def p5_self_equality(spark, path):
    return ask(spark, path, [rule({"o": "$O", "k": "$K"}, ("lineitem", {"l_orderkey": "$O", "l_partkey": "$K", "l_suppkey": "$K"}))])


@query("SELECT DISTINCT c_custkey AS c, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'")
def p6_constraint(spark, path):
    return ask(spark, path, [rule({"c": "$C", "segment": "$S"}, ("customer", {"c_custkey": "$C", "c_mktsegment": "$S"}))], {"segment": "BUILDING"})


@query("SELECT DISTINCT p_partkey AS part, p_size AS size FROM part WHERE p_size = 7")
def p7_constraint_coerced(spark, path):
    return ask(spark, path, [rule({"part": "$P", "size": "$S"}, ("part", {"p_partkey": "$P", "p_size": "$S"}))], {"size": "7.0"})


# Joins ------------------------------------------------------------------------------------------


@query("SELECT DISTINCT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey")
def j1_join2(spark, path):
    return ask(spark, path, [rule({"c": "$C", "o": "$O"}, ("customer", {"c_custkey": "$C"}), ("orders", {"o_custkey": "$C", "o_orderkey": "$O"}))])


@query("SELECT DISTINCT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P'")
def j2_self_join(spark, path):
    return ask(spark, path, [rule({"a": "$A", "b": "$B"}, ("orders", {"o_custkey": "$C", "o_orderkey": "$A", "o_orderstatus": "F"}), ("orders", {"o_custkey": "$C", "o_orderkey": "$B", "o_orderstatus": "P"}))])


@query("SELECT DISTINCT o_orderkey AS o, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j3_join4(spark, path):
    return ask(spark, path, [rule({"o": "$O", "nation": "$N", "region": "$R"}, ("orders", {"o_orderkey": "$O", "o_custkey": "$C"}), ("customer", {"c_custkey": "$C", "c_nationkey": "$K"}), ("nation", {"n_nationkey": "$K", "n_name": "$N", "n_regionkey": "$G"}), ("region", {"r_regionkey": "$G", "r_name": "$R"}))])


@query("SELECT DISTINCT n_name AS nation, r_name AS region FROM nation, region")
def j4_cross(spark, path):
    return ask(spark, path, [rule({"nation": "$N", "region": "$R"}, ("nation", {"n_name": "$N"}), ("region", {"r_name": "$R"}))])


_FACTS_SQL = """facts AS (
  SELECT sha256(concat_ws(chr(0), relation, args, CAST(valid_start AS VARCHAR), source)) AS id, * FROM (
    SELECT event_type AS relation, '{"user":' || user_id || ',"worth":' || CAST(event_id % 10 AS VARCHAR) || '}' AS args,
      epoch_us(ts) // 1000000 AS valid_start, lead(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_end,
      epoch_us(ts) // 1000000 AS tx_start, CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000000 + 3600 END AS tx_end,
      'u' || (user_id % 3) AS source, event_id FROM events))"""


def event_second(ts: str) -> F.Column:
    """Seconds of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def event_facts(spark: SparkSession, path: str) -> DataFrame:
    """Events as facts: each holds until the user's next; errors were retracted an hour later."""
    e = Data(spark, path).events.withColumn("at", event_second("ts"))
    nxt = F.lead("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    args = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"worth":'), (F.col("event_id") % 10).cast("string"), F.lit("}"))
    source = F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))
    return e.select(
        ids.fact_id(F.col("event_type"), args, F.col("at"), source).alias("id"), F.col("event_type").alias("relation"), args.alias("args"), F.col("at").alias("valid_start"), nxt.alias("valid_end"), F.col("at").alias("tx_start"),
        F.when(F.col("event_type") == "error", F.col("at") + 3600).alias("tx_end"), source.alias("source"), F.lit(None).cast("string").alias("provenance"), "event_id",
    )


_MID = "(SELECT (min(valid_start) + max(valid_start)) // 2 AS m FROM facts)"


def _middle(rows: DataFrame) -> int:
    r = rows.agg(F.min("valid_start").alias("a"), F.max("valid_start").alias("b")).first()
    return (r["a"] + r["b"]) // 2


@query(f"WITH {_FACTS_SQL} SELECT id, relation, valid_start, source FROM facts WHERE valid_end IS NULL AND tx_end IS NULL")
def t1_s1_facts_now(spark, path):
    return facts.scan(event_facts(spark, path)).select("id", "relation", "valid_start", "source")


@query(f"WITH {_FACTS_SQL} SELECT id, relation, valid_start FROM facts, {_MID} WHERE valid_start <= m AND (valid_end IS NULL OR valid_end > m) AND tx_end IS NULL")
def t2_facts_as_of_valid(spark, path):
    f = event_facts(spark, path)
    return facts.scan(f, scope=Scope(valid_at=_middle(f))).select("id", "relation", "valid_start")


@query(f"WITH {_FACTS_SQL} SELECT id, relation, valid_start FROM facts, {_MID} WHERE tx_start <= m AND (tx_end IS NULL OR tx_end > m)")
def t3_facts_as_of_tx(spark, path):
    f = event_facts(spark, path)
    return facts.scan(f, scope=Scope(tx_at=_middle(f))).select("id", "relation", "valid_start")


@query(f"WITH {_FACTS_SQL} SELECT id, relation, valid_start FROM facts, {_MID} WHERE valid_start <= m AND (valid_end IS NULL OR valid_end > m) AND tx_start <= m AND (tx_end IS NULL OR tx_end > m)")
def t4_facts_bitemporal(spark, path):
    f = event_facts(spark, path)
    m = _middle(f)
    return facts.scan(f, scope=Scope(m, m)).select("id", "relation", "valid_start")


@query(f"WITH {_FACTS_SQL} SELECT DISTINCT CAST(json_extract(args, '$.user') AS VARCHAR) AS u FROM facts, {_MID} WHERE relation = 'view' AND CAST(json_extract(args, '$.worth') AS INTEGER) > 4 AND valid_start <= m AND (valid_end IS NULL OR valid_end > m) AND tx_end IS NULL")
def t5_rule_as_of(spark, path):
    f = event_facts(spark, path)
    engine = Engine(Relations(facts=f), [rule({"u": "$U"}, ("view", {"user": "$U", "worth": ">4"}))])
    return engine.query("r", scope=Scope(valid_at=_middle(f)))


@query(f"WITH {_FACTS_SQL} SELECT id, tx_start, valid_start FROM facts WHERE relation = 'purchase'")
def s4_fact_history(spark, path):
    return facts.history(event_facts(spark, path), "purchase").select("id", "tx_start", "valid_start")


@query(f"WITH {_FACTS_SQL} SELECT id, relation, source FROM facts WHERE valid_end IS NULL AND tx_end IS NULL AND relation = 'view' AND CAST(json_extract(args, '$.worth') AS INTEGER) = 4")
def s2_s3_current_filtered(spark, path):
    return facts.current(event_facts(spark, path), "view", {"worth": 4}).select("id", "relation", "source")


@query(f"WITH {_FACTS_SQL} SELECT id, event_id FROM facts")
def f4_fact_id(spark, path):
    return event_facts(spark, path).select("id", "event_id")


@query(f"WITH {_FACTS_SQL} SELECT event_id, round(CAST(json_extract(args, '$.worth') AS DOUBLE) * pow(0.5, ({NOW} - valid_start) / 7776000.0), 9) AS decayed FROM facts WHERE valid_end IS NULL AND tx_end IS NULL")
def f1_s7_fact_scored(spark, path):
    return facts.scored(event_facts(spark, path), NOW, keep=("event_id",)).select("event_id", F.round("decayed_worth", 9).alias("decayed"))


@query(f"WITH {_FACTS_SQL}, s AS (SELECT relation, CAST(json_extract(args, '$.worth') AS DOUBLE) AS worth FROM facts WHERE valid_end IS NULL AND tx_end IS NULL) SELECT DISTINCT worth, r_name AS region FROM s, region WHERE worth > 4 AND r_regionkey = 1")
def j5_j6_scored_join(spark, path):
    native = {"fact_scored": facts.scored(event_facts(spark, path), NOW)}
    return ask(spark, path, [rule({"worth": "$W", "region": "$R"}, ("fact_scored", {"worth": "$W", "relation": "$L"}), ("fact_scored", {"worth": ">4", "relation": "$L", "id": "$I"}), ("region", {"r_regionkey": 1, "r_name": "$R"}))], **native).where("worth > 4")


@query(f"WITH {_FACTS_SQL} SELECT relation, source, count(*) AS n FROM facts WHERE valid_end IS NULL AND tx_end IS NULL GROUP BY ALL")
def a8_fact_statistics(spark, path):
    return facts.statistics(event_facts(spark, path), ["relation", "source"])


@query(f"WITH {_FACTS_SQL} SELECT relation, CAST(json_extract(args, '$.worth') AS VARCHAR) AS worth, count(*) AS n FROM facts WHERE valid_end IS NULL AND tx_end IS NULL GROUP BY ALL")
def a8_fact_crosstab(spark, path):
    return facts.statistics(event_facts(spark, path), ["relation", "worth"])


_DOC_FACTS_SQL = """docs AS (SELECT doc_id, 'src:' || source || '/' || lang AS scope, CASE WHEN lang = 'en' THEN 'pattern' ELSE 'fact' END AS kind, source, doc_id % 1000 AS valid_start FROM documents)"""


def document_facts(spark: SparkSession, path: str) -> DataFrame:
    d = Data(spark, path).documents
    scope = F.concat(F.lit("src:"), "source", F.lit("/"), "lang")
    args = F.to_json(F.struct(F.when(F.col("lang") == "en", "pattern").otherwise("fact").alias("kind"), scope.alias("scope"), F.col("doc_id")))
    none = F.lit(None)
    return d.select(F.col("doc_id").cast("string").alias("id"), F.lit("observation").alias("relation"), args.alias("args"), (F.col("doc_id") % 1000).alias("valid_start"), none.cast("long").alias("valid_end"), F.lit(0).cast("long").alias("tx_start"), none.cast("long").alias("tx_end"), "source", none.cast("string").alias("provenance"))


@query(f"WITH {_DOC_FACTS_SQL} SELECT doc_id, valid_start FROM docs WHERE scope LIKE 'src:src1%' AND kind = 'fact' AND source <> 'src1'")
def p11_p12_p14_pull(spark, path):
    rows = facts.pull(document_facts(spark, path), scope_prefix="src:src1", kind="fact").where("source <> 'src1'")
    return rows.select(F.get_json_object("args", "$.doc_id").cast("long").alias("doc_id"), "valid_start")


# Aggregates -------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS status, CAST(count(o_custkey) AS DOUBLE) AS n FROM orders GROUP BY 1")
def a1_count(spark, path):
    return ask(spark, path, [rule({"status": "$S", "n": "count($C)"}, ("orders", {"o_orderstatus": "$S", "o_custkey": "$C"}))])


@query("SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def a2_sum(spark, path):
    rows = ask(spark, path, [rule({"flag": "$F", "total": "sum($Q)"}, ("lineitem", {"l_returnflag": "$F", "l_quantity": "$Q"}))])
    return rows.select("flag", F.round("total", 2).alias("total"))


@query("SELECT c_mktsegment AS segment, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
def a3_a4_min_max(spark, path):
    return ask(spark, path, [rule({"segment": "$S", "low": "min($B)", "high": "max($B)"}, ("customer", {"c_mktsegment": "$S", "c_acctbal": "$B"}))])


@query("SELECT CAST(count(l_orderkey) AS DOUBLE) AS n FROM lineitem WHERE l_returnflag = 'R'")
def a5_global(spark, path):
    return ask(spark, path, [rule({"n": "count($O)"}, ("lineitem", {"l_orderkey": "$O", "l_returnflag": "R"}))])


@query("SELECT c_nationkey AS nation, CAST(count(o_orderkey) AS DOUBLE) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3 GROUP BY 1")
def a6_aggregate_constraint(spark, path):
    return ask(spark, path, [rule({"nation": "$N", "n": "count($O)"}, ("customer", {"c_custkey": "$C", "c_nationkey": "$N"}), ("orders", {"o_custkey": "$C", "o_orderkey": "$O"}))], {"nation": "3"})


@query("SELECT n_name AS nation, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def spend_by_nation(spark, path):
    rows = ask(spark, path, [rule({"nation": "$N", "spent": "sum($P)"}, ("orders", {"o_custkey": "$C", "o_totalprice": "$P"}), ("customer", {"c_custkey": "$C", "c_nationkey": "$K"}), ("nation", {"n_nationkey": "$K", "n_name": "$N"}))])
    return rows.select("nation", F.round("spent", 2).alias("spent"))


@query("SELECT event_type AS what FROM (SELECT DISTINCT event_type FROM events WHERE value > 50) UNION ALL SELECT DISTINCT event_type FROM events WHERE value < 60")
def u1_union_all(spark, path):
    return ask(spark, path, [rule({"what": "$T"}, ("events", {"event_type": "$T", "value": ">50"})), rule({"what": "$T"}, ("events", {"event_type": "$T", "value": "<60"}))])


# Recursion --------------------------------------------------------------------------------------

#: Every customer needs that of half its number; the first three need one another in a circle.
_EDGES_SQL = "edges AS (SELECT c_custkey AS a, CASE WHEN c_custkey < 3 THEN (c_custkey + 1) % 3 ELSE c_custkey // 2 END AS b FROM customer)"
_CLOSURE_SQL = f"WITH RECURSIVE {_EDGES_SQL}, closure AS (SELECT a, b FROM edges UNION SELECT e.a, c.b FROM edges e JOIN closure c ON e.b = c.a)"


def customer_edges(spark: SparkSession, path: str) -> DataFrame:
    k = F.col("c_custkey")
    return Data(spark, path).customer.select(k.alias("from"), F.when(k < 3, (k + 1) % 3).otherwise(F.expr("c_custkey div 2")).alias("to"))


def _closure(spark, path, relation, constraints=None):
    return Engine(Relations({"model_depends_on": customer_edges(spark, path)}), CONVERGENCE_RULES).query(relation, constraints)


@query(f'{_CLOSURE_SQL} SELECT a AS "from", b AS "to" FROM closure')
def g1_g2_closure(spark, path):
    return _closure(spark, path, "depends_transitive")


@query(f"{_CLOSURE_SQL} SELECT b AS changed, a AS impacted FROM closure WHERE b = 5")
def g3_impacted_by(spark, path):
    return _closure(spark, path, "impacted_by", {"changed": "5"})


@query(f"{_CLOSURE_SQL} SELECT DISTINCT a AS model FROM closure WHERE a = b")
def g4_cyclic(spark, path):
    return _closure(spark, path, "cyclic")


@query(f'{_CLOSURE_SQL} SELECT a AS "from", b AS "to" FROM closure WHERE a = 12')
def g1_closure_from(spark, path):
    return _closure(spark, path, "depends_transitive", {"from": 12})


@query("WITH RECURSIVE e AS (SELECT user_id AS a, event_id AS b FROM events WHERE event_type = 'click'), odd AS (SELECT a, b, 1 AS k FROM e UNION SELECT o.a, e.b, 1 - o.k FROM odd o JOIN e ON o.b = e.a) SELECT DISTINCT a AS x, b AS y FROM odd WHERE k = 1")
def g1_mutual_recursion(spark, path):
    e = Data(spark, path).events.where("event_type = 'click'").select(F.col("user_id").alias("a"), F.col("event_id").alias("b"))
    rules = [
        rule({"x": "$X", "y": "$Y"}, ("e", {"a": "$X", "b": "$Y"}), name="odd"),
        rule({"x": "$X", "y": "$Z"}, ("even", {"x": "$X", "y": "$Y"}), ("e", {"a": "$Y", "b": "$Z"}), name="odd"),
        rule({"x": "$X", "y": "$Z"}, ("odd", {"x": "$X", "y": "$Y"}), ("e", {"a": "$Y", "b": "$Z"}), name="even"),
    ]
    return ask(spark, path, rules, name="odd", e=e)


_TREE_SQL = "tree AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def place_edges(spark: SparkSession, path: str) -> DataFrame:
    d = Data(spark, path)
    s = d.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("from"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("to"))
    return s.union(d.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))


@query(f"WITH {_TREE_SQL} SELECT node, max(level) AS level FROM (SELECT a AS node, CASE WHEN a LIKE 's%' THEN 2 ELSE 1 END AS level FROM tree UNION SELECT b, CASE WHEN b LIKE 'n%' THEN 1 ELSE 0 END FROM tree) GROUP BY node")
def g5_topological_levels(spark, path):
    return graph.levels(place_edges(spark, path))


@query(f"WITH {_TREE_SQL}, sourced AS (SELECT a, b, 'declared' AS source FROM tree UNION ALL SELECT a, b, 'derived' FROM tree WHERE b = 'r1') SELECT a AS \"from\", b AS \"to\", string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM sourced GROUP BY a, b")
def g11_dependency_listing(spark, path):
    e = place_edges(spark, path)
    return graph.dependency_listing(e.withColumn("source", F.lit("declared")).union(e.where("to = 'r1'").withColumn("source", F.lit("derived"))))


# Scalar functions -------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def f5_content_hash(spark, path):
    return Data(spark, path).documents.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


def _proquint_sql(n: str) -> str:
    def word(base: int) -> str:
        parts = [(ids.CONSONANTS, 12, 15), (ids.VOWELS, 10, 3), (ids.CONSONANTS, 6, 15), (ids.VOWELS, 4, 3), (ids.CONSONANTS, 0, 15)]
        return " || ".join(f"substr('{a}', CAST((({n}) >> {base + s}) & {m} AS INTEGER) + 1, 1)" for a, s, m in parts)

    return f"{word(16)} || '-' || {word(0)}"


@query(f"SELECT doc_id, {_proquint_sql('h')} AS proquint, h AS back FROM (SELECT doc_id, CAST(('0x' || substr(sha256(text), 1, 8)) AS BIGINT) AS h FROM documents)")
def f6_proquint(spark, path):
    p = ids.proquint(ids.content_hash(F.col("text")))
    return Data(spark, path).documents.select("doc_id", p.alias("proquint"), ids.proquint_to_number(p).alias("back"))


@query("SELECT doc_id, sha256('base/core.#Item' || chr(0) || CASE WHEN lang = 'en' THEN '{\"id\":' || doc_id || '}' ELSE sha256(text) END) AS resource_id FROM documents")
def f7_resource_id(spark, path):
    identity = F.when(F.col("lang") == "en", F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit("}")))
    return Data(spark, path).documents.select("doc_id", ids.resource_id(F.lit("base/core.#Item"), identity, ids.content_hash(F.col("text"))).alias("resource_id"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def f2_p15_json_extract(spark, path):
    return Data(spark, path).events.select("event_id", json_values.pointer(F.col("props"), "/k").cast("long").alias("k"))


@query("SELECT p_partkey, 'base/' || lower(substr(p_brand, 1, 5)) || '.#Part' AS schema, p_partkey % 2 = 0 AS fallback FROM part")
def f9_schema_names(spark, path):
    p = Data(spark, path).part
    raw = F.concat(F.lit("base.schemas/base/"), F.lower(F.substring("p_brand", 1, 5)), F.lit("@v0:Part"))
    item = F.when(F.col("p_partkey") % 2 == 0, "core.#Item").otherwise("core.#Other")
    return p.select("p_partkey", names.normalize_schema(raw).alias("schema"), names.is_fallback(item).alias("fallback"))


@query("SELECT n_nationkey, 'base/aws.#VPCNATID' || CASE WHEN n_nationkey > 10 THEN 'Big' ELSE '' END AS schema FROM nation")
def f10_resource_schema(spark, path):
    t = F.concat(F.lit("aws.ec2.vpc_nat-id"), F.when(F.col("n_nationkey") > 10, "_big").otherwise(""))
    return Data(spark, path).nation.select("n_nationkey", names.resource_schema(t, "base/core.#Observation").alias("schema"))


@query("SELECT page_id, regexp_replace(url, '^https?:', '') AS raw, regexp_replace(url, '^https?://', '') AS target FROM pages")
def f18_target(spark, path):
    raw = F.regexp_replace("url", "^https?:", "")
    return Data(spark, path).pages.select("page_id", raw.alias("raw"), names.normalize_target(raw).alias("target"))


@query("SELECT doc_id, CASE WHEN n > 60 THEN substr(args, 1, 57) || '...' ELSE args END AS summary FROM (SELECT doc_id, text AS args, length(text) AS n FROM documents)")
def f19_summary(spark, path):
    return Data(spark, path).documents.select("doc_id", facts.summary(F.col("text")).alias("summary"))


@query("SELECT p_partkey, round(least(greatest(p_size / 100.0 + CASE WHEN 4 > 1 THEN (4 - p_partkey % 4) / 4.0 * 0.3 END, 0.1), 1), 9) AS confidence FROM part")
def f20_confidence(spark, path):
    return Data(spark, path).part.select("p_partkey", F.round(scores.confidence(F.col("p_size") / 100, F.col("p_partkey") % 4, F.lit(4)), 9).alias("confidence"))


@query("SELECT page_id, CASE WHEN o = '' THEN 'unknown-source' ELSE o END AS origin FROM (SELECT page_id, regexp_replace(regexp_extract(lower(url), '([^/]*)$', 1), '\\.[^.]*$', '') AS o FROM pages)")
def f21_origin(spark, path):
    return Data(spark, path).pages.select("page_id", names.origin_of(F.col("url")).alias("origin"))


# Catalog ----------------------------------------------------------------------------------------

_ENTRIES_SQL = "entries AS (SELECT 'd' || doc_id AS id, 'text/' || lang AS schema, source AS origin, CASE WHEN doc_id % 4 = 0 THEN 'json' ELSE 'text' END AS format, CASE WHEN doc_id % 10 = 0 THEN 'collection' ELSE 'item' END AS entry_type, n_chars AS size_bytes, doc_id % 7 AS record_count, doc_id * 60 AS import_timestamp FROM documents)"


def document_entries(spark: SparkSession, path: str) -> DataFrame:
    d = Data(spark, path).documents
    kind = lambda n, a, b: F.when(F.col("doc_id") % n == 0, a).otherwise(b)
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("text/"), "lang").alias("schema"), F.col("source").alias("origin"), kind(4, "json", "text").alias("format"), kind(10, "collection", "item").alias("entry_type"), F.col("n_chars").alias("size_bytes"), (F.col("doc_id") % 7).alias("record_count"), (F.col("doc_id") * 60).alias("import_timestamp"))


@query(f"WITH {_ENTRIES_SQL} SELECT id, size_bytes FROM entries WHERE schema ILIKE '%EN%' AND origin ILIKE '%src1%' AND entry_type IN ('item')")
def p8_p9_p10_catalog_filter(spark, path):
    return catalog.select_entries(document_entries(spark, path), catalog.Filters(schema="EN", origin="src1", entry_types=("item",))).select("id", "size_bytes")


@query(f"WITH {_ENTRIES_SQL} SELECT id, size_bytes FROM entries ORDER BY size_bytes DESC, id LIMIT 20 OFFSET 40")
def o1_o2_catalog_page(spark, path):
    return catalog.page(catalog.sort_entries(document_entries(spark, path), "size", reverse=True), 3, 20).select("id", "size_bytes")


@query(f"WITH {_ENTRIES_SQL} SELECT id, import_timestamp FROM entries ORDER BY import_timestamp DESC, id LIMIT 25")
def o1_catalog_newest(spark, path):
    return catalog.page(catalog.sort_entries(document_entries(spark, path)), 1, 25).select("id", "import_timestamp")


@query(f"WITH {_ENTRIES_SQL} SELECT 'schema' AS field, schema AS value, count(*) AS n FROM entries GROUP BY ALL UNION ALL SELECT 'origin', origin, count(*) FROM entries GROUP BY ALL UNION ALL SELECT 'format', format, count(*) FROM entries GROUP BY ALL")
def a9_a10_distinct_values(spark, path):
    return catalog.distinct_values(document_entries(spark, path))


@query(f"WITH {_ENTRIES_SQL} SELECT count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(record_count) AS BIGINT) AS record_count FROM entries WHERE format = 'json'")
def a14_summary(spark, path):
    return catalog.page_summary(document_entries(spark, path).where("format = 'json'"))


_MEMBERS_SQL = "memberships AS (SELECT 'c' || conv_id AS collection_id, sha256(text) AS item_id, min(turn) AS item_index FROM conversations GROUP BY ALL), items AS (SELECT sha256(text) AS id, min(role) AS role FROM conversations GROUP BY ALL)"


def conversation_members(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    c = Data(spark, path).conversations.withColumn("id", ids.content_hash(F.col("text")))
    members = c.groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("collection_id"), F.col("id").alias("item_id")).agg(F.min("turn").alias("item_index"))
    return members, c.groupBy("id").agg(F.min("role").alias("role"))


@query(f"WITH {_MEMBERS_SQL} SELECT collection_id, item_index, role FROM memberships JOIN items ON item_id = id")
def j8_collection_items(spark, path):
    members, items = conversation_members(spark, path)
    return catalog.collection_items(items, members).select("collection_id", "item_index", "role")


@query(f"WITH {_MEMBERS_SQL} SELECT id FROM items WHERE id IN (SELECT item_id FROM memberships WHERE collection_id = 'c1')")
def j7_semi_join(spark, path):
    members, items = conversation_members(spark, path)
    return catalog.select_entries(items, catalog.Filters(collection_id="c1"), members).select("id")


@query(f"WITH {_MEMBERS_SQL} SELECT item_id, min(collection_id) AS collection_id FROM memberships GROUP BY item_id HAVING count(*) = 1")
def j9_a12_singleton_membership(spark, path):
    return catalog.singleton_membership(conversation_members(spark, path)[0])


@query(f"WITH {_MEMBERS_SQL} SELECT item_id, count(*) AS n FROM memberships GROUP BY item_id")
def a17_membership_counts(spark, path):
    return catalog.membership_counts(conversation_members(spark, path)[0])


@query(f"WITH {_MEMBERS_SQL}, gone AS (SELECT item_id FROM memberships WHERE collection_id IN ('c1') AND item_id NOT IN (SELECT item_id FROM memberships WHERE collection_id <> 'c1')) SELECT id FROM items WHERE id NOT IN (SELECT item_id FROM gone)")
def m8_cascade_delete(spark, path):
    members, items = conversation_members(spark, path)
    return catalog.cascade_delete(items, members, "c1")[0].select("id")


@query(f"WITH {_MEMBERS_SQL}, new AS (SELECT collection_id, item_id, item_index + 100 AS item_index FROM memberships WHERE item_index = 0) SELECT collection_id, item_id, item_index FROM new UNION ALL SELECT * FROM memberships WHERE (collection_id, item_id) NOT IN (SELECT (collection_id, item_id) FROM new)")
def m9_membership_upsert(spark, path):
    members, _ = conversation_members(spark, path)
    return catalog.upsert_memberships(members, members.where("item_index = 0").withColumn("item_index", F.col("item_index") + 100))


# Versions, runs, snapshots ----------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS version FROM events")
def w1_versions(spark, path):
    e = Data(spark, path).events.select(F.col("event_id").alias("id"), F.col("user_id").alias("resource_id"), F.col("ts").alias("import_timestamp"), F.col("event_type").alias("created_at"))
    return catalog.resequence_versions(e).select(F.col("id").alias("event_id"), F.col("version").cast("long").alias("version"))


@query("WITH base AS (SELECT user_id, count(*) AS m FROM events WHERE event_id % 3 <> 0 GROUP BY 1) SELECT event_id, coalesce(m, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS version FROM events e LEFT JOIN base b ON e.user_id = b.user_id WHERE event_id % 3 = 0")
def w2_a11_incremental_versions(spark, path):
    e = Data(spark, path).events.withColumnRenamed("user_id", "resource_id")
    known = e.where("event_id % 3 <> 0").withColumn("version", F.row_number().over(Window.partitionBy("resource_id").orderBy("event_id")))
    out = catalog.assign_versions(known, e.where("event_id % 3 = 0"), F.col("event_id"))
    return out.select("event_id", F.col("version").cast("long").alias("version"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w5_a13_latest(spark, path):
    return catalog.latest_by(Data(spark, path).events, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 3 AND event_id % 5 <> 0")
def w3_m13_retention(spark, path):
    e = Data(spark, path).events
    s = e.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("model"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 == 0).alias("retained"))
    return catalog.prune_victims(s, keep=3).select(F.col("snapshot_id").alias("event_id"))


@query("WITH r AS (SELECT user_id AS model, event_id AS seq, event_id % 4 AS applies, event_type = 'purchase' AND event_id % 3 <> 0 AS clean FROM events), s AS (SELECT *, max(CASE WHEN clean THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM r) SELECT model, CAST(sum(CASE WHEN seen = 0 THEN applies ELSE 0 END) AS BIGINT) AS applies FROM s GROUP BY model")
def a16_w4_applies_since_clean(spark, path):
    e = Data(spark, path).events
    runs = e.select(F.col("user_id").alias("model"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("applies"), F.when(F.col("event_type") == "purchase", "clean").otherwise("drifted").alias("verdict"), (F.col("event_id") % 3 == 0).alias("scoped"))
    return catalog.applies_since_clean(runs)


@query("SELECT user_id AS model, event_id AS snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error' AND event_id % 2 = 0) WHERE r = 1")
def j10_r10_eligible_snapshot(spark, path):
    e = Data(spark, path).events
    snaps = e.select(F.col("event_id").alias("snapshot_id"), F.col("event_id").alias("run_id"), F.col("user_id").alias("model"), F.when(F.col("event_id") % 2 == 0, "w").otherwise("v").alias("workspace"), F.lit("observe").alias("source"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    runs = e.select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("completion_status"))
    return catalog.latest_snapshots(catalog.eligible_snapshots(snaps, runs, "w")).select("model", "snapshot_id")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND value > 20")
def p16_unfinished_runs(spark, path):
    e = Data(spark, path).events.where("event_type = 'view'")
    runs = e.select(F.col("event_id").alias("run_id"), F.lit("m").alias("model"), F.col("ts").alias("started_at"), F.when(F.col("value") <= 20, F.col("ts")).alias("finished_at"))
    return catalog.unfinished_runs(runs, "m").select(F.col("run_id").alias("event_id"))


# Import -----------------------------------------------------------------------------------------


@query("WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents), known AS (SELECT DISTINCT content_hash FROM h WHERE doc_id % 10 = 0) SELECT min(doc_id) AS doc_id, content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM known) GROUP BY content_hash")
def i1_i2_dedup(spark, path):
    d = Data(spark, path).documents.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))
    return imports.new_items(d, d.where("doc_id % 10 = 0"), ["doc_id"])


@query("SELECT sha256(text) AS item_id, min(doc_id) AS item_index, 'all' AS collection_id FROM documents GROUP BY 1")
def i2_dedup_memberships(spark, path):
    d = Data(spark, path).documents.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))
    return imports.item_memberships(d, "all", "doc_id")


@query("WITH h AS (SELECT source AS target, sha256(text) AS content_hash, doc_id AS seq FROM documents), k AS (SELECT DISTINCT target, content_hash FROM h WHERE seq % 4 = 0) SELECT h.target, h.content_hash, min(seq) AS first_seen, count(*) AS sightings, NOT bool_or(k.target IS NOT NULL) AS is_new FROM h LEFT JOIN k ON h.target = k.target AND h.content_hash = k.content_hash GROUP BY 1, 2")
def i3_observation_dedup(spark, path):
    d = Data(spark, path).documents.select(F.col("source").alias("target"), ids.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("seq"))
    return imports.import_observations(d, d.where("seq % 4 = 0"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'null' WHEN p_partkey % 5 = 1 THEN 'int' WHEN p_partkey % 5 = 2 THEN 'float' WHEN p_partkey % 5 = 3 THEN 'bool' ELSE 'string' END AS kind FROM part")
def f16_cell_kinds(spark, path):
    k = F.col("p_partkey")
    cell = F.when(k % 5 == 0, " ").when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".5"))).when(k % 5 == 3, "true").otherwise(F.col("p_name"))
    return Data(spark, path).part.select("p_partkey", formats.cell_kind(cell).alias("kind"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'ndjson' WHEN 2 THEN 'yaml' WHEN 3 THEN 'csv' WHEN 4 THEN 'unknown' ELSE 'csv' END AS format FROM documents")
def s18_format(spark, path):
    k = F.col("doc_id") % 6
    content = F.when(k == 0, '[{"a": 1}]').when(k == 1, '{"a": 1}\n{"a": 2}\n').when(k == 2, "a: 1\nb: x").when(k == 3, "a,b\n1,2").when(k == 4, "plain words").otherwise("x")
    name = F.when(k == 5, "f.csv").otherwise("f")
    return Data(spark, path).documents.select("doc_id", formats.detect_format(name, content).alias("format"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'mod@1:Thing' END AS schema, '{\"n\":' || n_nationkey || '}' AS payload FROM nation")
def s20_envelope(spark, path):
    k = F.col("n_nationkey")
    body = F.concat(F.lit('{"n":'), k.cast("string"), F.lit("}"))
    record = F.when(k % 2 == 0, F.concat(F.lit('{"schema":{"module":"mod","version":"1","name":"Thing"},"data":'), body, F.lit("}"))).otherwise(body)
    return Data(spark, path).nation.select("n_nationkey", formats.unwrap(record).alias("u")).select("n_nationkey", "u.schema", "u.payload")


@query("SELECT 'n' || n_nationkey AS target, unnest(range(3)) AS position FROM nation")
def s21_observations(spark, path):
    record = F.concat(F.lit('{"target":"n'), F.col("n_nationkey").cast("string"), F.lit('","current":{"records":[{"a":1},{"a":2},{"a":3}]}}'))
    rows = formats.observed_records(Data(spark, path).nation.select(record.alias("record")))
    return rows.select("target", F.col("position").cast("long").alias("position"))


@query("SELECT 'field' || (k % 3) AS field, 'int' AS kind, count(*) AS present, (SELECT count(*) FROM part) AS total FROM (SELECT p_partkey AS k FROM part) GROUP BY 1")
def a18_field_presence(spark, path):
    record = F.concat(F.lit('{"field'), (F.col("p_partkey") % 3).cast("string"), F.lit('":1}'))
    return schemas.field_presence(Data(spark, path).part.select(record.alias("record")))


def _registry() -> schemas.Registry:
    S, Fd = schemas.Schema, schemas.Field
    return schemas.Registry([
        S("base/core.#Item", schema_type="catchall"), S("tpc.#Part", {"p_name": Fd("string"), "p_size": Fd("int", least=1)}, resource_type="tpc.part", identity=("p_name",), tracked=("p_size",)),
        S("tpc.#SmallPart", {"p_size": Fd("int", least=1, most=20)}, base="tpc.#Part", resource_type="tpc.part", identity=("p_name",), tracked=("p_size",)),
    ])


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'base/core.#Item' WHEN p_size <= 20 THEN 'tpc.#SmallPart' ELSE 'tpc.#Part' END AS schema FROM part")
def i5_i6_inference(spark, path):
    record = F.when(F.col("p_partkey") % 9 == 0, '{"other":1}').otherwise(F.to_json(F.struct("p_name", "p_size")))
    rows = schemas.infer_schemas(Data(spark, path).part.select("p_partkey", record.alias("record")), _registry())
    return rows.select("p_partkey", "schema")


@query("SELECT CASE WHEN p_partkey % 9 = 0 THEN 'error' WHEN p_size <= 20 THEN 'valid' ELSE 'invalid' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def i8_i14_validation(spark, path):
    record = F.when(F.col("p_partkey") % 9 == 0, "{broken").otherwise(F.to_json(F.struct("p_name", "p_size")))
    rows = Data(spark, path).part.select("p_partkey", record.alias("record"), F.lit("tpc.#SmallPart").alias("schema"))
    return schemas.validate_records(rows, _registry()).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# Reconciliation ---------------------------------------------------------------------------------


def observed_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts as found: one in seven is gone, every fifth has another size."""
    return Data(spark, path).part.where("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))


_DRIFT_SQL = "drift AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'missing' ELSE 'changed' END AS reason, CASE WHEN p_partkey % 7 <> 0 THEN 'p_size' END AS field FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0)"


def _table_drift(spark, path):
    return reconcile.table_drift(Data(spark, path).part, observed_parts(spark, path), ["p_partkey"], ["p_brand", "p_size"])


@query(f"WITH {_DRIFT_SQL} SELECT * FROM drift")
def j12_j13_drift(spark, path):
    return _table_drift(spark, path)


@query(f"WITH {_DRIFT_SQL} SELECT 'drifted' AS verdict, count(*) FILTER (reason = 'missing') AS missing, count(*) FILTER (reason = 'changed') AS changed FROM drift")
def r1_drift_verdict(spark, path):
    return reconcile.drift_verdict(_table_drift(spark, path))


@query("SELECT 'tpc.part/' || p_partkey AS resource, CASE WHEN p_partkey % 7 = 0 THEN 'missing' ELSE 'changed' END AS reason, CASE WHEN p_partkey % 7 <> 0 THEN 'size: ' || (p_size + 1) || ' -> want ' || p_size END AS diff FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0")
def r1_f14_f15_inventory_drift(spark, path):
    record = lambda d: d.select(F.to_json(F.struct(F.lit("tpc.part").alias("_schema"), F.col("p_partkey").alias("name"), F.col("p_size").alias("size"))).alias("record"))
    return reconcile.inventory_drift(record(Data(spark, path).part), record(observed_parts(spark, path)))


@query("WITH w AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'R'), h AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'A') SELECT s, p, 'add' AS action FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT s, p, 'invalidate' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)")
def j14_u3_edge_reconcile(spark, path):
    but = lambda flag: Data(spark, path).lineitem.where(F.col("l_returnflag") != flag).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return reconcile.reconcile_edges(but("R"), but("A"), ["s", "p"])


@query("WITH made AS (SELECT DISTINCT l_suppkey AS model, l_partkey AS value FROM lineitem WHERE l_linenumber = 1), refs AS (SELECT DISTINCT l_suppkey AS model, l_partkey AS value FROM lineitem WHERE l_linenumber = 2), fr AS (SELECT * FROM refs EXCEPT SELECT * FROM made) SELECT DISTINCT fr.model, made.model AS needs FROM fr JOIN made USING (value) WHERE fr.model <> made.model AND NOT (fr.model = 1 AND made.model = 2)")
def j15_derive_dependencies(spark, path):
    li = Data(spark, path).lineitem.select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("value"), "l_linenumber")
    declared = spark.createDataFrame([(1, 2)], "model long, needs long")
    return reconcile.derive_dependencies(li.where("l_linenumber = 1").select("model", "value"), li.where("l_linenumber = 2").select("model", "value"), declared)


@query(f"{_CLOSURE_SQL} SELECT a AS model, b AS upstream, CASE WHEN b % 2 = 0 THEN 'drifted' ELSE 'failed' END AS status FROM closure WHERE b % 5 = 0")
def j18_upstream_staleness(spark, path):
    k = F.col("c_custkey")
    status = Data(spark, path).customer.select(k.alias("model"), F.when(k % 5 != 0, "clean").when(k % 2 == 0, "drifted").otherwise("failed").alias("status"))
    return reconcile.upstream_staleness(_closure(spark, path, "depends_transitive"), status)


@query("WITH m AS (SELECT n_nationkey, count(s_suppkey) AS matches, min(s_suppkey) AS s FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1) SELECT n_nationkey, matches, CASE WHEN matches = 1 THEN CAST(s AS VARCHAR) END AS record, CASE WHEN matches = 1 THEN 'resolved' WHEN matches = 0 THEN 'source-absent' ELSE 'source-ambiguous' END AS code FROM m")
def j17_r7_unique_match(spark, path):
    d = Data(spark, path)
    records = d.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").cast("string").alias("record"))
    return reconcile.unique_match(records, d.nation.select("n_nationkey"), ["n_nationkey"])


@query("SELECT 'orders_have_customers' AS name, (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL) = 0 AS passed UNION ALL SELECT 'has_big_orders', (SELECT count(*) FROM orders WHERE o_totalprice > 1000) > 0")
def r4_checks(spark, path):
    d = Data(spark, path)
    orders = d.orders
    orphans = orders.join(d.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    engine = Engine(Relations({"orphans": orphans, "orders": orders}), [rule({"o": "$O"}, ("orphans", {"o_orderkey": "$O"}), name="orphan"), rule({"o": "$O"}, ("orders", {"o_orderkey": "$O", "o_totalprice": ">1000"}), name="big")])
    found = reconcile.run_checks(engine, [reconcile.Check("orders_have_customers", "orphan"), reconcile.Check("has_big_orders", "big", "nonempty")])
    return spark.createDataFrame([(r["check"], r["passed"]) for r in found], "name string, passed boolean")


# Feedback and search ----------------------------------------------------------------------------


def feedback_facts(spark: SparkSession, path: str) -> DataFrame:
    """Labels as feedback on documents: good ones are helpful three times over, toxic ones harmful twice."""
    d = Data(spark, path)
    none = F.lit(None)
    of = lambda rows, relation, args: rows.select(F.sha2(F.concat(F.lit(relation), args), 256).alias("id") if relation == "feedback" else F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit(relation).alias("relation"), args.alias("args"), F.lit(0).cast("long").alias("valid_start"), none.cast("long").alias("valid_end"), F.lit(0).cast("long").alias("tx_start"), none.cast("long").alias("tx_end"), F.lit("s").alias("source"), none.cast("string").alias("provenance"))
    status = F.when(F.col("doc_id") % 3 == 0, "reviewed").when(F.col("doc_id") % 3 == 1, "promoted").otherwise("raw")
    observations = of(d.documents, "observation", F.to_json(F.struct(F.lit("fact").alias("kind"), status.alias("status"))))
    target = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("target")
    many = d.labels.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("toxic") == 1, 2).otherwise(3))).alias("n"))
    verdict = F.when(F.col("toxic") == 1, "harmful").when(F.col("quality") == 1, "helpful").otherwise("neutral")
    return observations.unionByName(of(many, "feedback", F.to_json(F.struct(target, verdict.alias("verdict"), F.col("n").alias("note")))))


@query("SELECT 'd' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'reviewed' ELSE 'raw' END AS from_status, CASE WHEN toxic = 1 THEN 'rejected' WHEN doc_id % 3 = 0 THEN 'promoted' ELSE 'reviewed' END AS to_status, CAST(CASE WHEN toxic = 1 THEN 0 ELSE 3 END AS BIGINT) AS helpful, CAST(CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS BIGINT) AS harmful FROM labels WHERE doc_id % 3 <> 1 AND (toxic = 1 OR quality = 1) AND doc_id IN (SELECT doc_id FROM documents)")
def j16_m6_curation(spark, path):
    return curation.curation_plan(feedback_facts(spark, path))


@query("SELECT 'd' || doc_id AS target, CAST(CASE WHEN toxic <> 1 AND quality = 1 THEN 3 ELSE 0 END AS BIGINT) AS helpful, CAST(CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS BIGINT) AS harmful FROM labels")
def a19_feedback_tally(spark, path):
    return curation.feedback_tally(feedback_facts(spark, path))


@query("SELECT a.event_id AS id, b.event_id AS ancestor FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id < a.event_id")
def g8_lineage(spark, path):
    e = Data(spark, path).events
    older = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    chain = e.select(F.col("event_id").cast("string").alias("id"), F.to_json(F.struct(older.cast("string").alias("prevVersion"))).alias("args"))
    return curation.lineage(chain).select(F.col("id").cast("long").alias("id"), F.col("ancestor").cast("long").alias("ancestor"))


_TOKENS_SQL = "t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)"


def _hits(spark, path, text):
    d = Data(spark, path).documents
    return d.where(search.match(text, search.tokens(F.col("text")))).select("doc_id")


@query(f"WITH {_TOKENS_SQL} SELECT doc_id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'license')")
def f12_search_and(spark, path):
    return _hits(spark, path, "the license")


@query(f"WITH {_TOKENS_SQL} SELECT doc_id FROM t WHERE list_contains(w, 'idiot') OR (list_contains(w, 'apache') AND NOT list_contains(w, 'der')) OR len(list_filter(w, lambda x: starts_with(x, 'lic'))) > 0")
def f12_search_boolean(spark, path):
    return _hits(spark, path, "idiot OR (apache NOT der) OR lic*")


@query(f"WITH {_TOKENS_SQL} SELECT doc_id FROM t WHERE ' ' || array_to_string(w, ' ') || ' ' LIKE '% under the mit %'")
def f12_search_phrase(spark, path):
    return _hits(spark, path, '"under the mit"')


@query(f"""WITH {_TOKENS_SQL}, n AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS f0, len(list_filter(w, lambda x: x = 'idiot')) AS f1 FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM n)
SELECT doc_id, round(greatest(ln((docs - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(ln((docs - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM n, s WHERE f0 > 0 OR f1 > 0""")
def f13_bm25(spark, path):
    return search.bm25(Data(spark, path).documents, ["license", "idiot"], "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_TOKENS_SQL} SELECT 'd' || t.doc_id AS id, round((t.doc_id % 10) / 10.0 * pow(0.5, ({NOW} - t.doc_id * 86400) / 7776000.0), 12) AS decayed_worth FROM t WHERE list_contains(w, 'the') AND t.doc_id % 2 = 0 ORDER BY (t.doc_id % 10) / 10.0 * pow(0.5, ({NOW} - t.doc_id * 86400) / 7776000.0) DESC, 1 LIMIT 10")
def r11_o5_memory_context(spark, path):
    d = Data(spark, path).documents
    args = F.to_json(F.struct(F.col("text").alias("description"), F.when(F.col("doc_id") % 2 == 0, "promoted").otherwise("raw").alias("status"), ((F.col("doc_id") % 10) / 10).alias("worth")))
    none = F.lit(None)
    f = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("observation").alias("relation"), args.alias("args"), (F.col("doc_id") * 86400).alias("valid_start"), none.cast("long").alias("valid_end"), none.cast("long").alias("tx_end"), F.lit("s").alias("source"))
    return search.memory_context(f, "the", NOW).select("id", F.round("decayed_worth", 12).alias("decayed_worth"))
