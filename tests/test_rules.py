import itertools
import json
import random

import pytest

from lakeloom.operators.facts import FACTS
from lakeloom.plans.engine import Engine, strata
from lakeloom.plans.relations import Relations, Scope
from lakeloom.plans.rules import CONVERGENCE_RULES, install_rule, load_rules, parse_compact, relation_listing
from lakeloom.plans.terms import Aggregate, Comparison, Constant, Rule, RuleError, Variable, parse_term
from pyspark.sql import functions as F


def rule(head, *body, name="r"):
    return {"head": {"rel": name, "args": head}, "body": [{"rel": r, "args": a} for r, a in body]}


@pytest.fixture()
def facts(spark):
    def make(*rows, **times):
        held = [(f"{k}", r, json.dumps(a) if isinstance(a, dict) else a, times.get("valid_start", 0), None, 0, None, "s", None) for k, (r, a) in enumerate(rows)]
        return spark.createDataFrame(held, FACTS)

    return make


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_terms():
    assert parse_term("$X") == Variable("X") and parse_term("count($S)") == Aggregate("count", "S")
    assert parse_term(">=0.25") == Comparison(">=", 0.25) and parse_term("!= -3") == Comparison("!=", -3)
    assert parse_term("a>1") == Constant("a>1") and parse_term(True) == Constant(True)
    with pytest.raises(RuleError):
        parse_term([1])


def test_joins_over_facts(facts):
    f = facts(("depends", {"from": "api", "to": "db"}), ("depends", {"from": "api", "to": "mq"}), ("observation", {"target": "db", "kind": "bug"}), ("observation", {"target": "mq", "kind": "fact"}), ("node", {"name": "db", "active": True}))
    engine = Engine(Relations(facts=f), [rule({"t": "$T"}, ("depends", {"from": "api", "to": "$T"}), ("observation", {"target": "$T", "kind": "bug"})), rule({"n": "$N"}, ("node", {"name": "$N", "active": True}), name="active")])
    assert rows(engine.query("r")) == [("db",)] and rows(engine.query("active")) == [("db",)]
    assert engine.query("depends", {"to": "mq"}).count() == 1


@pytest.mark.parametrize("op, want", [(">80", ["a"]), (">=80", ["a", "c"]), ("<80", ["b"]), ("<=80", ["b", "c"]), ("!=80", ["a", "b"])])
def test_comparisons(facts, op, want):
    f = facts(("metric", {"host": "a", "load": 90}), ("metric", {"host": "b", "load": 10}), ("metric", {"host": "c", "load": 80.0}), ("metric", {"host": "d", "load": "99"}), ("metric", {"host": "e"}))
    assert [r[0] for r in rows(Engine(Relations(facts=f), [rule({"h": "$H"}, ("metric", {"host": "$H", "load": op}))]).query("r"))] == want


def test_types_tell_values_apart(facts):
    f = facts(("a", {"k": 5}), ("a", {"k": 5.0}), ("a", {"k": "5"}), ("b", {"k": "5"}), ("b", {"k": 5}))
    engine = Engine(Relations(facts=f), [rule({"k": "$K"}, ("a", {"k": 5}), ("a", {"k": "$K"}), ("b", {"k": "$K"})), rule({"k": "$K"}, ("a", {"k": "$K"}), name="all")])
    assert engine.query("r").count() == 2 and engine.query("all").count() == 2


def test_missing_keys_bind_null_and_never_join(facts):
    f = facts(("a", {"x": 1}), ("a", {"x": 2, "y": 7}), ("b", {"y": 7}), ("b", {}))
    engine = Engine(Relations(facts=f), [rule({"x": "$X", "y": "$Y"}, ("a", {"x": "$X", "y": "$Y"}), name="all"), rule({"x": "$X"}, ("a", {"x": "$X", "y": "$Y"}), ("b", {"y": "$Y"}))])
    assert engine.query("all").count() == 2 and rows(engine.query("r")) == [("2",)]


def test_aggregates(facts):
    f = facts(*(("feedback", {"target": t, "source": s}) for t, s in (("X", "a"), ("X", "b"), ("X", "b"), ("Y", "a"))))
    engine = Engine(Relations(facts=f), [rule({"target": "$T", "n": "count($S)"}, ("feedback", {"target": "$T", "source": "$S"})), rule({"n": "count($S)"}, ("feedback", {"source": "$S"}), name="total")])
    assert rows(engine.query("r")) == [(1.0, "Y"), (3.0, "X")] and rows(engine.query("total")) == [(4.0,)]
    assert rows(engine.query("r", {"target": "X"})) == [(3.0, "X")]
    assert rows(Engine(Relations(facts=facts(("q", {"a": 1}))), [rule({"n": "count($A)"}, ("none", {"a": "$A"}))]).query("r")) == [(0.0,)]


def test_native_and_stored_relations_join(spark, facts):
    native = spark.createDataFrame([("db", 3, 1.5), ("mq", 4, 2.0)], "name string, port int, load double")
    f = facts(("uses", {"who": "api", "what": "db"}), ("port", {"n": 4}), ("load", {"v": 2}))
    rules = [rule({"p": "$P"}, ("uses", {"what": "$W"}), ("hosts", {"name": "$W", "port": "$P"})), rule({"n": "$N"}, ("port", {"n": "$P"}), ("hosts", {"name": "$N", "port": "$P"}), name="by_port"), rule({"n": "$N"}, ("load", {"v": "$V"}), ("hosts", {"name": "$N", "load": "$V"}), name="by_load")]
    engine = Engine(Relations({"hosts": native}, f, reserved={"hosts"}), rules)
    assert rows(engine.query("r")) == [(3,)] and rows(engine.query("by_port")) == [("mq",)] and rows(engine.query("by_load")) == [("mq",)]
    with pytest.raises(RuleError):
        engine.query("hosts")


def test_union_keeps_rows_of_each_rule(facts):
    f = facts(("a", {"x": 1}), ("b", {"x": 1}))
    assert rows(Engine(Relations(facts=f), [rule({"x": "$X"}, ("a", {"x": "$X"})), rule({"x": "$X"}, ("b", {"x": "$X"}))]).query("r")) == [("1",), ("1",)]


def test_head_constants_are_not_output(facts):
    assert Engine(Relations(facts=facts(("a", {"x": 1}))), [rule({"x": "$X", "kind": "t"}, ("a", {"x": "$X"}))]).query("r").columns == ["x"]


def depends(facts, *edges):
    return Engine(Relations(facts=facts(*(("model_depends_on", {"from": a, "to": b}) for a, b in edges))), CONVERGENCE_RULES)


def test_shipped_rules(facts):
    engine = depends(facts, ("compute", "network"), ("network", "dns"), ("workloads", "compute"))
    assert [r[1] for r in rows(engine.query("depends_transitive", {"from": "compute"}))] == ["dns", "network"]
    assert [r[1] for r in rows(engine.query("impacted_by", {"changed": "dns"}))] == ["compute", "network", "workloads"]
    assert rows(engine.query("cyclic")) == []
    assert rows(depends(facts, ("a", "b"), ("b", "a")).query("cyclic")) == [("a",), ("b",)]
    assert rows(depends(facts).query("depends_transitive")) == []


def test_atoms_that_only_filter_are_not_multiplied_out(spark):
    """4,000 rows of one hub: 6.4e10 bindings of the body, and 2 rows of the head."""
    hub = spark.range(4000).select(F.lit("h").alias("h"), (F.col("id") % 2).alias("c"), F.col("id").alias("i"), F.lit(None).cast("string").alias("d"))
    few = spark.createDataFrame([(7.0,), (8.0,)], "i double")
    body = [("hub", {"h": "$H", "c": "$C"}), ("few", {"i": "$I"}), ("hub", {"i": "$J", "d": "$D", "h": "$H"}), ("hub", {"i": "$I", "h": "$H"})]
    for order in itertools.permutations(body):
        found = Engine(Relations({"hub": hub, "few": few}), [rule({"h": "$H", "c": "$C"}, *order)]).query("r")
        assert "Inner" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and plan.count("LeftSemi") == 3
        assert order != tuple(body) or rows(found) == [(0, "h"), (1, "h")]


def test_long_chain_and_round_limit(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(150)], "a long, b long")
    closure = [rule({"a": "$X", "b": "$Y"}, ("e", {"a": "$X", "b": "$Y"}), name="t"), rule({"a": "$X", "b": "$Z"}, ("e", {"a": "$X", "b": "$Y"}), ("t", {"a": "$Y", "b": "$Z"}), name="t")]
    assert Engine(Relations({"e": edges}), closure).query("t").count() == 150 * 151 // 2
    slow = [rule({"b": "$Y"}, ("e", {"a": 0, "b": "$Y"}), name="t"), rule({"b": "$Z"}, ("t", {"b": "$Y"}), ("e", {"a": "$Y", "b": "$Z"}), name="t")]
    with pytest.raises(RuleError, match="fixpoint"):
        Engine(Relations({"e": edges}), slow, rounds=3).query("t")


def test_random_rules_against_a_naive_evaluation(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = {(rng.randrange(8), rng.randrange(8)) for _ in range(10)}
        rules = [
            rule({"x": "$A", "y": "$B"}, ("e", {"a": "$A", "b": "$B"}), name="p"),
            rule({"x": "$A", "y": "$C"}, ("p", {"x": "$A", "y": "$B"}), ("q", {"x": "$B", "y": "$C"}), name="p"),
            rule({"x": "$B", "y": "$A"}, ("p", {"x": "$A", "y": "$B"}), ("p", {"x": "$B", "y": "$C"}), name="q"),
        ]
        p, q = set(edges), set()
        while True:
            new_p = p | {(a, c) for a, b in p for b2, c in q if b == b2}
            new_q = q | {(b, a) for a, b in p for b2, _ in p if b == b2}
            if (new_p, new_q) == (p, q):
                break
            p, q = new_p, new_q
        engine = Engine(Relations({"e": spark.createDataFrame(sorted(edges), "a long, b long")}), rules)
        assert rows(engine.query("p")) == sorted(p) and rows(engine.query("q")) == sorted(q)


def test_time(spark):
    f = spark.createDataFrame([("1", "link", '{"a":1,"b":2}', 0, 100, 0, None, "s", None), ("2", "link", '{"a":2,"b":3}', 50, None, 0, None, "s", None), ("3", "link", '{"a":3,"b":4}', 0, None, 0, 60, "s", None)], FACTS)
    closure = [rule({"a": "$X", "b": "$Y"}, ("link", {"a": "$X", "b": "$Y"}), name="t"), rule({"a": "$X", "b": "$Z"}, ("link", {"a": "$X", "b": "$Y"}), ("t", {"a": "$Y", "b": "$Z"}), name="t")]
    engine = Engine(Relations(facts=f), closure)
    count = lambda **k: engine.query("t", scope=Scope(**k)).count()
    assert (count(), count(valid_at=60), count(valid_at=99), count(valid_at=100), count(tx_at=10), count(valid_at=60, tx_at=30)) == (1, 3, 3, 1, 6, 6)


def test_errors(facts):
    for bad in (rule({"x": "$X"}), rule({"x": "$X"}, ("a", {"y": "$Y"})), rule({"x": "c"}, ("a", {"y": "$Y"})), rule({"x": "$X"}, ("a", {"x": "$X", "n": "count($X)"})), rule({"x": ">3"}, ("a", {"x": "$X"}))):
        with pytest.raises(RuleError):
            Rule.parse(bad)
    recursive = [rule({"n": "count($X)"}, ("a", {"x": "$X"}), name="t"), rule({"n": "$N"}, ("t", {"n": "$N"}), name="t")]
    with pytest.raises(RuleError, match="aggregates"):
        Engine(Relations(facts=facts(("a", {"x": 1}))), recursive)
    layered = [rule({"x": "$X"}, ("a", {"x": "$X"}), name="d"), rule({"n": "count($X)"}, ("d", {"x": "$X"}), name="t")]
    with pytest.raises(RuleError, match="aggregates"):
        Engine(Relations(facts=facts(("a", {"x": 1}))), layered)
    assert rows(Engine(Relations(facts=facts(("a", {"x": 1}))), layered, stratified_aggregates=True).query("t")) == [(1.0,)]
    with pytest.raises(RuleError, match="keys"):
        Engine(Relations(), [rule({"x": "$X"}, ("a", {"x": "$X"})), rule({"y": "$X"}, ("a", {"x": "$X"}))])
    with pytest.raises(RuleError, match="nope"):
        Engine(Relations(facts=facts(("a", {"x": 1}))), [rule({"x": "$X"}, ("a", {"x": "$X"}))]).query("r", {"nope": 1})
    with pytest.raises(RuleError, match="built in"):
        Engine(Relations(reserved={"r"}), [rule({"x": "$X"}, ("a", {"x": "$X"}))])


def test_strata():
    rules = [Rule.parse(rule({"x": "$X"}, (b, {"x": "$X"}), name=h)) for h, b in (("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("c", "e"))]
    assert strata(rules) == [["b", "c"], ["a"], ["d"]]


def test_files(tmp_path):
    base, over = tmp_path / "base", tmp_path / "over"
    base.mkdir()
    over.mkdir()
    (base / "r.json").write_text(json.dumps({"one": rule({"x": "$X"}, ("a", {"x": "$X"})), "note": {"text": "no rule"}}))
    (base / "s.yaml").write_text("two:\n  head: {rel: two, args: {x: $X}}\n  body: [{rel: a, args: {x: $X}}]\n")
    (over / "r.cue").write_text('package rules\n\n// shadows\none: {\n\thead: {rel: "r", args: {x: "$X"}}\n\tbody: [\n\t\t{rel: "b", args: {x: "$X", y: ">3"}},\n\t]\n}\n')
    loaded = {r.name: r for r in load_rules([base, over])}
    assert set(loaded) == {"one", "two"} and loaded["one"].body[0].relation == "b"
    assert relation_listing(loaded.values(), ["facts"]) == {"facts": [], "r": ["x"], "two": ["x"]}
    assert install_rule(base / "s.yaml", over).read_text() == (base / "s.yaml").read_text()
    with pytest.raises(RuleError):
        (tmp_path / "none.json").write_text("{}")
        install_rule(tmp_path / "none.json", over)
    assert parse_compact('a: {b: "x: {y}", c: 1}') == {"a": {"b": "x: {y}", "c": 1}}
    assert list(itertools.chain(load_rules([tmp_path / "missing.json"]))) == []
