import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import catalog, graph, reconcile
from lakeloom.operators.reconcile import Convergence, converge, run_verdict
from lakeloom.plans.engine import Engine
from lakeloom.plans.relations import Relations
from lakeloom.plans.terms import RuleError


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(f"e{k}", f"aws/{'ec2' if k % 2 else 's3'}.#X", f"Origin-{k % 3}", "json", "item", f"r{k % 2}", k * 10, k, dt.datetime(2024, 1, 1 + k), f"t{k % 2}", "converging", json.dumps({"model": "m"}) if k % 2 else None, dt.datetime(2024, 1, 1)) for k in range(6)]
    return spark.createDataFrame(rows, "id string, schema string, origin string, format string, entry_type string, resource_id string, size_bytes long, record_count long, import_timestamp timestamp, definition string, status string, tags string, created_at timestamp")


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame([("c1", "e1", 0), ("c1", "e2", 1), ("c2", "e2", 0), ("c2", "e3", 5)], "collection_id string, item_id string, item_index long")


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_filters_sorts_and_pages(entries, members):
    pick = lambda **k: sorted(ids(catalog.select_entries(entries, catalog.Filters(**k), members)))
    assert pick(schema="EC2") == ["e1", "e3", "e5"] and pick(origin="origin-1", schema="s3") == ["e4"] and pick(collection_id="c1") == ["e1", "e2"] and len(pick()) == 6
    assert pick(entry_types=("collection",)) == []
    assert ids(catalog.sort_entries(entries))[0] == "e5" and ids(catalog.sort_entries(entries, "timestamp"))[0] == "e0"
    assert ids(catalog.sort_entries(entries, "size", reverse=True))[0] == "e5" and ids(catalog.sort_entries(entries, "no such"))[0] == "e5"
    assert ids(catalog.page(catalog.sort_entries(entries, "id"), 2, 4)) == ["e4", "e5"] and catalog.page_count(6, 4) == 2
    assert catalog.page_summary(entries).first()["size_bytes"] == 150


def test_collections(entries, members):
    assert ids(catalog.collection_items(entries, members, "c2")) == ["e2", "e3"]
    assert {tuple(r) for r in catalog.singleton_membership(members).collect()} == {("e1", "c1"), ("e3", "c2")}
    view = {r["id"]: r["collection_id"] for r in catalog.curated_view(entries, members).collect()}
    assert view["e1"] == "c1" and view["e2"] is None and view["e0"] is None
    left, rest = catalog.cascade_delete(entries, members, "c1")
    assert "e1" not in ids(left) and "e2" in ids(left) and rest.count() == 2
    new = members.sparkSession.createDataFrame([("c1", "e1", 9), ("c3", "e1", 0)], members.schema)
    assert {tuple(r) for r in catalog.upsert_memberships(members, new).collect()} >= {("c1", "e1", 9), ("c3", "e1", 0), ("c1", "e2", 1)}
    with pytest.raises(LookupError):
        catalog.delete_entry(entries, members, "zz")
    assert catalog.delete_entry(entries, members, "e1")[1].count() == 3


def test_versions_and_status(entries):
    assert [(r["id"], r["version"]) for r in catalog.resequence_versions(entries).orderBy("id").collect()] == [("e0", 1), ("e1", 1), ("e2", 2), ("e3", 2), ("e4", 3), ("e5", 3)]
    known = entries.select("resource_id", F.lit(4).alias("version")).where("resource_id = 'r0'")
    out = catalog.assign_versions(known, entries.select("resource_id", "id"), F.col("id"))
    assert {r["id"]: r["version"] for r in out.collect()} == {"e0": 5, "e2": 6, "e4": 7, "e1": 1, "e3": 2, "e5": 3}
    changed = catalog.update_status(entries, "t1", "clean").where("status = 'clean'")
    assert ids(changed) == ["e5"]
    with pytest.raises(RuleError):
        catalog.update_status(entries, "t1", "odd")
    rows, n = catalog.promote_converging(entries, ["t0", "t1"], "other")
    assert n == 3 and sorted(ids(rows.where("status = 'clean'"))) == ["e0", "e2", "e4"]
    assert catalog.promote_converging(entries, model="m")[1] == 3


@pytest.mark.parametrize("rows, want", [([("failed", 3, False), ("clean", 2, False), ("drifted", 4, False), ("failed", 1, False)], 5), ([("failed", 3, False), ("clean", 2, True), ("failed", 1, False)], 6)])
def test_apply_budget(spark, rows, want):
    runs = spark.createDataFrame([("m", k, *r) for k, r in enumerate(rows)], "model string, seq long, verdict string, applies long, scoped boolean")
    assert catalog.applies_since_clean(runs).first()["applies"] == want


def test_runs(spark):
    log = [("r1", "m", "start", 1, None, False), ("r1", "m", "apply", 2, None, False), ("r1", "m", "receipt", 3, None, False), ("r1", "m", "finish", 4, "clean", False), ("r2", "m", "start", 5, None, True), ("r2", "m", "apply", 6, None, True)]
    rows = {r["run_id"]: r for r in catalog.fold_runs(spark.createDataFrame(log, "run_id string, model string, kind string, at long, verdict string, scoped boolean")).collect()}
    assert (rows["r1"]["completion_status"], rows["r1"]["needs_verification"], rows["r1"]["verdict"]) == ("succeeded", False, "clean")
    assert (rows["r2"]["completion_status"], rows["r2"]["needs_verification"], rows["r2"]["applies"]) == ("running", True, 1)


def test_prune(spark):
    snaps = spark.createDataFrame([(f"s{k}", "m", k, k, k == 1) for k in range(5)], "snapshot_id string, model string, created_at long, seq long, retained boolean")
    members = spark.createDataFrame([("s0", "a"), ("s0", "b"), ("s4", "b"), ("s2", "c")], "collection_id string, item_id string")
    victims = catalog.prune_victims(snaps, keep=2)
    assert sorted(ids(victims, "snapshot_id")) == ["s0", "s2"] and sorted(ids(catalog.prune_impact(victims, members), "item_id")) == ["a", "c"]
    assert ids(catalog.prune_victims(snaps, 2, older_than=1), "snapshot_id") == ["s0"]


def test_item_schemas(spark):
    kind = "item_id string, schema_ref string, status string, classified_at long"
    known = spark.createDataFrame([("i", "a", "unresolved", 1), ("j", "b", "unresolved", 1)], kind)
    both = catalog.upsert_item_schemas(known, spark.createDataFrame([("i", "a", "inferred", 2)], kind))
    assert {(r["item_id"], r["status"]) for r in both.collect()} == {("i", "inferred"), ("j", "unresolved")}
    registry = spark.createDataFrame([("b",)], "schema_ref string")
    assert {(r["item_id"], r["status"]) for r in catalog.reclassify(both, registry).collect()} == {("i", "inferred"), ("j", "declared")}


def test_orders(spark):
    assert graph.topological_order([("c", "a"), ("b", "a"), ("d", "b"), ("d", "c")], ["z"]) == ["a", "b", "c", "d", "z"]
    with pytest.raises(RuleError, match="cycle"):
        graph.topological_order([("a", "b"), ("b", "a")])
    models = {"app": {"requires": ["db"], "aliases": ["web"]}, "db": {"after": ["net"]}, "net": {}}
    assert graph.run_set(models, ["web"]) == ["db", "app"] and graph.run_set(models, ["web", "net"]) == ["net", "db", "app"]
    for bad in ({"a": {"aliases": ["b"]}, "b": {}}, {"a": {"requires": ["a"]}}, {"a": {"requires": ["zz"]}}):
        with pytest.raises(RuleError):
            graph.run_set(bad, ["a"])
    assert graph.select_resources({"a": ["b"], "b": [], "c": []}, ["a"]) == ["b", "a"]
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "from string, to string")
    assert {tuple(r) for r in graph.levels(edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(RuleError):
        graph.levels(edges.union(spark.createDataFrame([("a", "c")], edges.schema)), rounds=5)


def record_table(spark, *rows):
    return spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(rows)], "record string, at long")


def test_inventory(spark):
    pkg = lambda name, state="present": {"_schema": "linux.package", "name": name, "state": state}
    drift = reconcile.inventory_drift(record_table(spark, pkg("podman"), pkg("htop"), pkg("restic", "absent")), record_table(spark, pkg("podman"), pkg("restic", "absent"), pkg("restic"), pkg("extra")), index="at")
    assert sorted(tuple(r) for r in drift.collect()) == [("linux.package/htop", "missing", None), ("linux.package/restic", "changed", "state: present -> want absent")]
    assert tuple(reconcile.drift_verdict(drift).first()) == ("drifted", 1, 1)
    image = lambda tag, digest: {"_schema": "img", "source": "s", "tag": tag, "digest": digest}
    drift = reconcile.inventory_drift(record_table(spark, image("v1", "new"), image("v2", "x"), {"no": "key"}), record_table(spark, image("v1", "old")), {"img": ["source", "tag"]})
    assert sorted(tuple(r)[:2] for r in drift.collect()) == [("img/s/v1", "changed"), ("img/s/v2", "missing")]
    lacking = reconcile.inventory_drift(record_table(spark, pkg("a")), record_table(spark, {"_schema": "linux.package", "name": "a"}))
    assert lacking.first()["diff"] == "state missing (want present)"


def test_differential_and_edges(spark):
    kind = "target string, error string, resources array<struct<resource: string, exists: boolean, matches: boolean, diff: string>>"
    rows = reconcile.differential_drift(spark.createDataFrame([("t", "", [("a", False, False, ""), ("b", True, False, "d"), ("c", True, True, "")])], kind))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "missing", None), ("b", "changed", "d")]
    with pytest.raises(RuleError):
        reconcile.differential_drift(spark.createDataFrame([("t", "boom", [])], kind))
    edge = lambda *p: spark.createDataFrame(p, "a string, b string")
    assert {tuple(r) for r in reconcile.reconcile_edges(edge(("x", "y"), ("x", "z")), edge(("x", "z"), ("q", "z")), ["a", "b"]).collect()} == {("x", "y", "add"), ("q", "z", "invalidate")}
    values = lambda *p: spark.createDataFrame(p, "model string, value string")
    needs = reconcile.derive_dependencies(values(("net", "vpc1"), ("db", "db1"), ("app", "app1")), values(("app", "vpc1"), ("app", "db1"), ("app", "app1"), ("db", "none")), spark.createDataFrame([("app", "db")], "model string, needs string"))
    assert [tuple(r) for r in needs.collect()] == [("app", "net")]


def test_checks_and_selectors(spark):
    engine = Engine(Relations({"t": spark.createDataFrame([("r1", 1)], "run string, x long")}), [{"head": {"rel": "bad", "args": {"run_id": "$R"}}, "body": [{"rel": "t", "args": {"run": "$R"}}]}])
    C = reconcile.Check
    assert [c["passed"] for c in reconcile.run_checks(engine, [C("a", "bad"), C("b", "bad", "nonempty"), C("c", "bad", scoped=True)], "other")] == [False, True, True]
    resources = [{"type": "vpc", "name": "main"}, {"type": "vpc", "name": "spare"}, {"type": "db", "name": "store"}]
    assert reconcile.resolve_selector("vpc", resources) == ["main", "spare"] and reconcile.resolve_selector("db/store", resources) == ["store"]
    for bad in ("zz", "db"):
        with pytest.raises(RuleError):
            reconcile.resolve_selector(bad, resources + [{"type": "x", "name": "db"}])


def test_wiring(spark):
    snaps = spark.createDataFrame([("old", "net", 10, 1), ("new", "net", 90, 2)], "snapshot_id string, model string, created_at long, seq long")
    record = json.dumps({"id": "vpc-1", "tags": {"n": 7}})
    records = spark.createDataFrame([("new", "vpc", '{"name": "main"}', record), ("new", "vpc", '{"name":"two"}', record), ("new", "vpc", '{"name":"two"}', record)], "snapshot_id string, schema string, identity string, record string")
    wanted = spark.createDataFrame([("i1", "net", "vpc", '{"name":"main"}'), ("i2", "net", "vpc", '{"name":"two"}'), ("i3", "net", "vpc", '{"name":"no"}'), ("i4", "none", "vpc", '{"name":"main"}')], "input string, model string, schema string, identity string")
    code = lambda **k: {r["input"]: (r["code"], r["value"]) for r in reconcile.wire(wanted, snaps, records, k.pop("path", "/tags/n"), 100, **k).collect()}
    assert code() == {"i1": ("resolved", "7"), "i2": ("source-ambiguous", None), "i3": ("source-absent", None), "i4": ("source-absent", None)}
    assert code(max_age=5)["i1"] == ("source-too-old", None) and code(path="/tags")["i1"] == ("projection-invalid", None)


def test_convergence():
    def system(after, fail_apply=False, fail_observe=False):
        state = {"n": 0}

        def observe():
            if fail_observe and state["n"]:
                raise OSError("gone")
            return state["n"] >= after

        def apply():
            if fail_apply:
                raise OSError("no")
            state["n"] += 1

        return observe, apply

    assert converge(*system(2)).outcome == "clean" and converge(*system(2)).iterations == 2
    assert converge(*system(9)).outcome == "failed:cap-exhausted" and converge(*system(9), budget=1).outcome == "failed:budget-exhausted"
    assert converge(*system(0), budget=0).outcome == "clean" and converge(*system(2), dry_run=True).outcome == "dry-run"
    broken = converge(*system(2, fail_apply=True))
    assert broken.outcome == "failed:execute" and broken.needs_verification
    assert converge(*system(2, fail_observe=True)).needs_verification
    lost = converge(*system(2), record=lambda _: 1 / 0)
    assert lost.outcome == "needs-verification" and run_verdict(lost) == "unknown"
    assert run_verdict(Convergence("clean")) == "clean" and run_verdict(Convergence("failed:x")) == "failed" and run_verdict(drift_clean=True, verified=False) == ""
    assert run_verdict(drift_clean=True, checks=[{"passed": False, "severity": "fail"}]) == "drifted" and run_verdict(drift_clean=True, checks=[{"passed": False, "severity": "warn"}]) == "clean"


@pytest.mark.parametrize(("step", "event"), sorted(reconcile.STEPS))
def test_every_step_of_the_loop(step, event):
    """Drives the loop into each row of the table and compares its end with that row."""
    log = []

    def observe():
        log.append("observe")
        if (step, event) == ("observe", "error") and len(log) > 1:
            raise OSError("gone")
        return (step, event) == ("observe", "clean")

    def apply():
        log.append("apply")
        if (step, event) == ("apply", "error"):
            raise OSError("no")
        return len(log)

    def record(receipt):
        log.append("record")
        if (step, event) == ("record", "error"):
            raise OSError("lost")

    options = {"dry run": {"dry_run": True}, "budget": {"budget": 1}, "cap": {"iterations": 2}}.get(event, {})
    got = converge(observe, apply, record, **options)
    after, outcome, doubt = reconcile.STEPS[step, event]
    if after is None:
        assert got.outcome == outcome and got.needs_verification == (doubt != "never")
        assert got.iterations == {"budget": 1, "cap": 2}.get(event, 1 if (step, event) in (("observe", "error"), ("record", "error")) else 0)
    else:
        assert got.outcome == "failed:cap-exhausted" and got.iterations == 3
    assert log[0] == "observe" and (got.outcome != "failed:cap-exhausted" or log[-1] == "observe")


def test_drift_evidence(spark):
    drift = spark.createDataFrame([("b", "missing", None), ("a", "changed", "x")], "resource string, reason string, diff string")
    rows = reconcile.drift_evidence(drift, "m", 1).collect()
    assert sorted(json.loads(r["args"])["resource"] for r in rows) == ["a", "b"]
    one = reconcile.drift_observation(drift, "m", 1).first()["provenance"]
    assert json.loads(one)["evidence"] == 2 and one == reconcile.drift_observation(drift.orderBy("resource"), "m", 1).first()["provenance"]


def test_entries_scope_and_observation(spark, entries, members):
    added = catalog.add_entries(entries, spark.createDataFrame([("n1", "core.#Item"), ("e1", "x")], "id string, schema string"))
    assert added.count() == 7 and added.where("id = 'n1'").first()["schema"] == "base/core.#Item"
    assert catalog.update_entries(added, spark.createDataFrame([("n1", "o2")], "id string, origin string")).where("id = 'n1'").first()["origin"] == "o2"
    with pytest.raises(LookupError):
        catalog.update_entries(added, spark.createDataFrame([("zz", "o2")], "id string, origin string"))
    snaps = spark.createDataFrame([("c1",)], "snapshot_id string")
    assert sorted(ids(reconcile.resolve_scope(entries, members, snaps, "c1", "Origin-0"))) == ["e1", "e2"]
    assert sorted(ids(reconcile.resolve_scope(entries, members, snaps, "gone", "Origin-0"))) == ["e0", "e3"]
    assert {r["schema"]: r["n"] for r in catalog.schema_distribution(entries, members, "c1").collect()} == {"aws/ec2.#X": 1, "aws/s3.#X": 1}
    none = spark.createDataFrame([], "resource string, reason string, diff string")
    assert "clean" in reconcile.drift_observation(none, "m", 1).first()["args"]


def test_workspace(spark, tmp_path):
    from lakeloom.api import Workspace

    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "r.json").write_text(json.dumps({"mine": {"head": {"rel": "mine", "args": {"t": "$T"}}, "body": [{"rel": "link", "args": {"to": "$T"}}, {"rel": "fact_scored", "args": {"relation": "link", "id": "$I"}}]}}))
    w = Workspace(spark, str(tmp_path / "s"), repo_paths=(str(tmp_path / "rules"),))
    w.store.add([{"relation": "link", "args": '{"to":"b"}', "valid_start": 1, "source": "x"}], now=1)
    assert [r["t"] for r in w.query("mine", now=5).collect()] == ["b"] and w.list_catalog().count() == 0
    assert w.relations()["mine"] == ["t"] and w.relations()["link"] == []
    with pytest.raises(RuleError):
        w.query("fact_scored")
