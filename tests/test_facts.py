import json
import random

import pytest

from lakeloom.functions import ids, json_values, names
from lakeloom.operators import curation, facts, search
from lakeloom.operators.facts import FACTS, Ambiguous, NotFound
from lakeloom.operators.store import Conflict, FactStore, Tables, part_of
from lakeloom.plans.relations import Scope
from lakeloom.plans.terms import RuleError
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_ids(spark):
    assert one(spark, ids.number_to_proquint(F.lit(0x7F000001).cast("long"))) == "lurab-babad"
    for n in (0, 1, 2**31, 2**32 - 1):
        assert one(spark, ids.proquint_to_number(ids.number_to_proquint(F.lit(n).cast("long")))) == n
    assert one(spark, ids.proquint_to_number(F.lit("nonsense"))) is None
    a = ids.fact_id(F.lit("r"), F.lit('{"b": 1, "a": {"d": 2, "c": 3}}'), F.lit(5), F.lit(None).cast("string"))
    b = ids.fact_id(F.lit("r"), F.lit('{"a":{"c":3,"d":2},"b":1}'), F.lit(5), F.lit(""))
    assert one(spark, a) == one(spark, b) and len(one(spark, a)) == 64


def test_json_values(spark):
    text = F.lit('{"a": {"b/c": 5.0, "l": [1, {"x": "y"}]}, "s": "t\\"q", "n": null, "f": 1.5, "t": true}')
    assert one(spark, json_values.pointer(text, "/a/b~1c")) == "5"
    assert one(spark, json_values.pointer(text, "/a/l/1/x")) == "y"
    assert one(spark, json_values.pointer(text, "/a")) is None and one(spark, json_values.pointer(text, "/zz")) is None
    assert one(spark, json_values.member(text, "s")) == '"t\\"q"' and one(spark, json_values.plain(json_values.member(text, "s"))) == 't"q'
    assert [one(spark, json_values.member(text, k)) for k in ("f", "t", "n", "q")] == ["1.5", "1", None, None]
    assert one(spark, json_values.canonical_json(F.lit("not json"))) == "not json"


@pytest.mark.parametrize("raw, want", [("base.schemas/base/aws@v0:Instance", "base/aws.#Instance"), ("core.#Item", "base/core.#Item"), ("aws/ec2:#Vpc", "aws/ec2.#Vpc"), ("aws/ec2.Vpc", "aws/ec2.#Vpc"), ("plain", "plain"), ("", "")])
def test_schema_names(spark, raw, want):
    assert one(spark, names.normalize_schema(F.lit(raw))) == want == names.normalize_schema_name(raw)


def test_names(spark):
    assert one(spark, names.resource_schema(F.lit("aws.ec2.nat_gateway"), "g")) == "base/aws.#NATGateway"
    assert one(spark, names.resource_schema(F.lit("host"), "g")) == "g"
    assert one(spark, names.format_schema(F.lit("a/b@v2"), F.lit("#X"))) == "a/b.#X"
    assert one(spark, names.schema_definition(F.lit("a/b:X"))) == "#X" and one(spark, names.schema_package(F.lit("a/b:X"))) == "a/b"
    assert one(spark, names.is_fallback(F.lit("core.#CatchAll"))) and one(spark, names.same_schema(F.lit("a:X"), F.lit("a.#X")))
    assert one(spark, names.origin_of(F.lit("/x/AWS-ec2.tar.gz"))) == "aws-ec2.tar"


def test_adding_is_idempotent_and_closing_checks(spark):
    empty = spark.createDataFrame([], FACTS)
    new = spark.createDataFrame([("state", '{"s": 1}', 10, "a"), ("state", '{ "s":1 }', 10, "a"), ("state", '{"s": 2}', None, "a")], "relation string, args string, valid_start long, source string")
    held = facts.add(empty, new, now=50)
    assert held.count() == 2 and facts.add(held, new, now=50).count() == 2
    first = held.where("valid_start = 10").first()["id"]
    gone = facts.invalidate(held, first, 70)
    assert facts.scan(gone).count() == 1 and facts.scan(gone, scope=Scope(valid_at=60)).count() == 2
    assert facts.scan(facts.retract(held, first, 70), scope=Scope(tx_at=60)).count() == 2
    with pytest.raises(NotFound):
        facts.invalidate(gone, first, 80)
    assert facts.lookup(held, first[:10]).first()["id"] == first
    with pytest.raises(NotFound):
        facts.lookup(held, "zz")
    with pytest.raises(Ambiguous):
        facts.lookup(held, "")
    with pytest.raises(RuleError):
        facts.add(held, spark.createDataFrame([("fact_scored", "{}")], "relation string, args string"), 1)


def test_known_relations_are_validated(spark):
    empty = spark.createDataFrame([], FACTS)
    add = lambda relation, args: facts.add(empty, spark.createDataFrame([(relation, json.dumps(args))], "relation string, args string"), 1)
    assert add("observation", {"kind": "bug", "description": "d", "worth": 0.5}).count() == 1
    for relation, args in (("observation", {"kind": "odd", "description": "d"}), ("observation", {"kind": "bug"}), ("observation", {"kind": "bug", "description": "d", "worth": 2}), ("feedback", {"target": "x", "verdict": "so so"})):
        with pytest.raises(RuleError):
            add(relation, args)
    with pytest.raises(RuleError):
        facts.observation("odd", "d")


def test_promotion_and_curation(spark):
    held = facts.add(spark.createDataFrame([], FACTS), spark.createDataFrame([("observation", '{"kind":"fact","description":"d","status":"raw"}', 1, "a")], "relation string, args string, valid_start long, source string"), 1)
    first = held.first()["id"]
    held, second = facts.promote(held, first, "reviewed", 10)
    with pytest.raises(RuleError):
        facts.promote(held, second, "raw", 11)
    assert {r["ancestor"] for r in curation.lineage(held).collect()} == {first}
    say = lambda target, verdict, k: ("feedback", json.dumps({"target": target, "verdict": verdict, "source": f"s{k}"}), 5, f"s{k}")
    kind = "relation string, args string, valid_start long, source string"
    good = facts.add(held, spark.createDataFrame([say(first, "helpful", 1), say(first, "helpful", 2), say(second, "helpful", 3)], kind), 20)
    assert [tuple(r) for r in curation.curation_plan(good).collect()] == [(second, "reviewed", "promoted", 3, 0)]
    bad = facts.add(good, spark.createDataFrame([say(second, "harmful", 4), say(first, "harmful", 5)], kind), 21)
    assert curation.curation_plan(bad).first()["to_status"] == "rejected"


def naive_lineage(links):
    """By walking from every id."""
    older = {}
    for a, b in links:
        older.setdefault(a, set()).add(b)
    found = set()
    for a in older:
        todo = list(older[a])
        while todo:
            b = todo.pop()
            if (a, b) not in found:
                found.add((a, b))
                todo += older.get(b, ())
    return sorted(found)


@pytest.mark.parametrize("shape", ["chains", "branches", "repeated", "several", "circles"])
def test_lineage_of_any_shape(spark, shape):
    rng = random.Random(shape)
    links = [(f"v{c}.{k + 1}", f"v{c}.{k}") for c in range(4) for k in range(rng.randrange(1, 20))]
    if shape == "branches":
        links = [(f"v{k}", f"v{rng.randrange(k)}") for k in range(1, 40)]
    elif shape == "repeated":
        links += links[::3]
    elif shape == "several":
        links = [(f"v{k}", f"v{rng.randrange(k)}") for k in range(1, 25)] + [("v9", "v2"), ("v20", "v1"), ("v20", "w")]
    elif shape == "circles":
        links += [("v0.0", "v0.1"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "e"), ("f", "e")]
    rng.shuffle(links)
    rows = [(a, json.dumps({"prevVersion": b})) for a, b in links] + [("v0.0" if shape == "chains" else "x", "{}")]
    f = spark.createDataFrame(rows, "id string, args string").repartition(3)
    assert sorted(map(tuple, curation.lineage(f, nearby=7, longest=3).collect())) == naive_lineage(links)


def test_lineage_stores_no_pairs(spark, tmp_path, monkeypatch):
    """What chains of 200 versions leave in the shared folder and in checkpoints is of the size of the links."""
    monkeypatch.setattr(curation, "shared_folder", lambda _, name: f"{tmp_path}/{name}{len(list(tmp_path.iterdir()))}")
    monkeypatch.setattr("lakeloom.plans.engine.cut", lambda rows: pytest.fail("pairs are stored"))
    f = spark.createDataFrame([(f"v{c}.{k + 1}", json.dumps({"prevVersion": f"v{c}.{k}"})) for c in range(10) for k in range(200)], "id string, args string")
    assert curation.lineage(f.repartition(1)).count() == 10 * 200 * 201 // 2
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 60_000


def test_decay_and_times(spark):
    f = spark.createDataFrame([("1", "playbook", '{"worth":1.0}', 1000, None, 0, None, "s", None)], FACTS)
    assert facts.scored(f, 1000).first()["decayed_worth"] == 1.0 and facts.scored(f, 1000 + 7_776_000).first()["decayed_worth"] == 0.5
    assert facts.parse_time("1970-01-01T00:01:00Z") == 60 and facts.parse_time("75") == 75


@pytest.mark.parametrize("query, hits", [("circular", "a"), ("rate login", "b"), ("depend*", "a"), ("description", ""), ('"login rate"', "b"), ('"rate login"', ""), ("circular OR login", "ab"), ("login NOT rate", ""), ("(circular OR login) AND limits", "b")])
def test_search(spark, query, hits):
    texts = {"a": {"kind": "fact", "description": "circular dependency"}, "b": {"kind": "bug", "description": "login rate limits", "worth": 0.5}}
    f = spark.createDataFrame([(k, "observation", json.dumps(v), 0, None, 0, None, "s", None) for k, v in texts.items()], FACTS)
    assert "".join(sorted(r["id"] for r in search.search(f, query).collect())) == hits


def test_search_syntax_errors():
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession()
    for bad in ("(a", "a )", "AND a", "a OR"):
        with pytest.raises(RuleError):
            search.match(bad, F.col("t"))


def test_store(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    store.add([{"relation": "link", "args": '{"from":"a","to":"b"}', "valid_start": 1, "source": "x"}], now=1)
    store.add([{"relation": "link", "args": '{"from":"b","to":"c"}', "valid_start": 1, "source": "x"}], now=2)
    old = store.tables.version()
    rules = [{"head": {"rel": "two", "args": {"a": "$A", "c": "$C"}}, "body": [{"rel": "link", "args": {"from": "$A", "to": "$B"}}, {"rel": "link", "args": {"from": "$B", "to": "$C"}}]}]
    assert [tuple(r) for r in store.query("two", rules=rules).collect()] == [("a", "c")]
    store.retract(store.query_facts("link").where("args like '%\"c\"%'").first()["id"], now=3)
    assert store.query("two", rules=rules).count() == 0 and store.facts(old).where("tx_end is null").count() == 2
    assert store.history("link").count() == 2 and store.facts(0).count() == 0

    with pytest.raises(ZeroDivisionError), store.tables.transaction() as tx:
        tx.write("facts", tx.read("facts", FACTS).limit(0))
        assert tx.read("facts", FACTS).count() == 0  # reads its own writes
        raise ZeroDivisionError
    assert store.facts().count() == 2

    with pytest.raises(Conflict), store.tables.transaction() as tx:
        tx.write("facts", store.facts())
        with Tables(spark, str(tmp_path / "s")).transaction() as other:
            other.write("facts", store.facts())
    with pytest.raises(FileNotFoundError):
        FactStore(spark, str(tmp_path / "none"), read_only=True)
    with pytest.raises(PermissionError):
        FactStore(spark, str(tmp_path / "s"), read_only=True).retract("x", 1)


def test_a_change_rewrites_one_part(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    store.add([{"relation": r, "args": f'{{"n":{n}}}', "valid_start": 1, "source": "x"} for r in ("a/b=c", "d") for n in range(3)], now=1)
    before = store.tables.manifest()["facts"]
    store.add([{"relation": "d", "args": '{"n":1}', "valid_start": 1, "source": "x"}, {"relation": "d", "args": '{"n":9}', "valid_start": 1, "source": "x"}], now=2)
    added = store.tables.manifest()["facts"]
    assert store.facts().count() == 7 and added[part_of("a/b=c")] == before[part_of("a/b=c")] and added[part_of("d")][:1] == before[part_of("d")]
    store.retract(store.query_facts("d").first()["id"], now=3)
    after = store.tables.manifest()["facts"]
    assert after[part_of("a/b=c")] == before[part_of("a/b=c")] and len(after[part_of("d")]) == 1 and after[part_of("d")] != added[part_of("d")]
    assert store.query_facts("d").count() == 3 and store.query_facts("a/b=c").count() == 3 and store.history("d").count() == 4
    with pytest.raises(NotFound):
        store.retract("nothing", now=4)
    store.compact("a/b=c")
    assert store.tables.vacuum(keep=1) >= 2 and store.facts().count() == 7 and store.tables.vacuum(keep=1) == 0
    store.add([], now=5)
    assert store.facts().count() == 7


def test_search_query_lists_all_matches(spark, tmp_path):
    from lakeloom.queries_more import j11_o4_search_facts

    docs = spark.range(10_050).selectExpr("id AS doc_id", "'a license line' AS text", "'en' AS lang", "'src3' AS source", "14L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert j11_o4_search_facts(spark, str(tmp_path)).count() == 10_050
