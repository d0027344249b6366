"""Desired against observed: drift, edges, checks, wiring, and the convergence loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.ids import content_hash
from lakeloom.functions.json_values import canonical_json, pointer
from lakeloom.plans.engine import Engine
from lakeloom.plans.terms import RuleError

#: What names a record whose schema declares no identity, in order of preference.
FALLBACK_KEYS = ("name", "path", "id")


def record_key(record: Column, identities: dict[str, list[str]] | None = None) -> Column:
    """``schema|identity`` of a JSON record: its schema's identity fields, or its name, path or id; else null."""
    get = lambda k: F.get_json_object(record, f"$.{k}")
    schema = F.coalesce(get("_schema"), F.lit(""))
    plain = F.coalesce(*(get(k) for k in FALLBACK_KEYS))
    value = plain
    for name, fields in (identities or {}).items():
        if fields:
            complete = F.lit(True)
            for f in fields:
                complete = complete & get(f).isNotNull()
            value = F.when((schema == name) & complete, F.concat_ws("/", *(get(f) for f in fields))).otherwise(value)
    return F.concat(schema, F.lit("|"), value)


def record_label(record: Column, key: Column) -> Column:
    schema = F.coalesce(F.get_json_object(record, "$._schema"), F.lit("?"))
    return F.concat(schema, F.lit("/"), F.substring_index(key, "|", -1))


def first_difference(desired: Column, observed: Column) -> Column:
    """The first field, by name, that the observed record lacks or has another value for; null if there is none."""
    want, have = F.from_json(desired, "map<string,string>"), F.from_json(observed, "map<string,string>")
    keys = F.filter(F.array_sort(F.map_keys(want)), lambda k: (k != "_schema") & ~F.coalesce(have[k].eqNullSafe(want[k]) & F.map_contains_key(have, k), F.lit(False)))
    key = F.get(keys, 0)
    text = lambda v: F.coalesce(v, F.lit("<nil>"))
    missing = F.concat(key, F.lit(" missing (want "), text(want[key]), F.lit(")"))
    changed = F.concat(key, F.lit(": "), text(have[key]), F.lit(" -> want "), text(want[key]))
    return F.when(key.isNull(), None).when(F.map_contains_key(have, key), changed).otherwise(missing)


def inventory_drift(desired: DataFrame, observed: DataFrame, identities: dict[str, list[str]] | None = None, record: str = "record", index: str | None = None) -> DataFrame:
    """``(resource, reason, diff)``: desired records that are missing or changed; anything else observed is ignored.

    Of several observed records with one identity the last by ``index`` counts.
    """
    key = record_key(F.col(record), identities)
    want = desired.select(key.alias("_key"), F.col(record).alias("_want")).where("_key is not null")
    have = observed.select(key.alias("_key"), F.col(record).alias("_have"), F.col(index).alias("_at") if index else F.lit(0).alias("_at")).where("_key is not null")
    have = have.groupBy("_key").agg(F.max_by("_have", "_at").alias("_have"))
    rows = want.join(have, "_key", "left").withColumn("diff", F.when(F.col("_have").isNotNull(), first_difference(F.col("_want"), F.col("_have"))))
    reason = F.when(F.col("_have").isNull(), "missing").when(F.col("diff").isNotNull(), "changed")
    return rows.select(record_label(F.col("_want"), F.col("_key")).alias("resource"), reason.alias("reason"), "diff").where("reason is not null")


def table_drift(desired: DataFrame, observed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The same over native columns: ``(*keys, reason, field)``."""
    have = observed.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_found"))
    field = F.coalesce(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns))
    rows = desired.join(have, keys, "left").withColumn("field", F.when(F.col("_found"), field))
    return rows.withColumn("reason", F.when(F.col("_found").isNull(), "missing").when(F.col("field").isNotNull(), "changed")).where("reason is not null").select(*keys, "reason", "field")


def drift_verdict(drift: DataFrame) -> DataFrame:
    return drift.agg(F.when(F.count(F.lit(1)) == 0, "clean").otherwise("drifted").alias("verdict"), F.count_if(F.col("reason") == "missing").alias("missing"), F.count_if(F.col("reason") == "changed").alias("changed"))


def resolve_scope(entries: DataFrame, memberships: DataFrame, snapshots: DataFrame, snapshot: str | None, origin: str) -> DataFrame:
    """What was observed: the records of a snapshot, or those of an origin where no such snapshot is known."""
    if snapshot is not None and not snapshots.where(F.col("snapshot_id") == snapshot).isEmpty():
        own = memberships.where(F.col("collection_id") == snapshot).select(F.col("item_id").alias("id"))
        return entries.join(own, "id", "left_semi")
    return entries.where(F.col("origin") == origin)


def drift_evidence(drift: DataFrame, model: str, now: int) -> DataFrame:
    """A fact for each drifting resource, the raw evidence of :func:`drift_observation`."""
    args = F.to_json(F.struct(F.lit(f"model:{model}").alias("scope"), "resource", "reason", "diff"))
    return drift.select(F.lit("drift_evidence").alias("relation"), args.alias("args"), F.lit(now).cast("long").alias("valid_start"), F.lit("drift").alias("source"), F.lit(None).cast("string").alias("provenance"))


def drift_observation(drift: DataFrame, model: str, now: int) -> DataFrame:
    """The verdict of a drift as one observation row, ready to be added to the facts. Its provenance is the count and
    an order-free digest of the evidence rows, which :func:`drift_evidence` gives one by one."""
    total = F.sum(F.xxhash64("resource", "reason", "diff").cast("decimal(38,0)")).cast("string")
    row = drift.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.coalesce(total, F.lit("")), 256).alias("digest"))
    text = F.when(F.col("n") == 0, F.lit(f"{model} is clean")).otherwise(F.concat(F.lit(f"{model} drifted: "), F.col("n").cast("string"), F.lit(" resources")))
    args = F.to_json(F.struct(F.lit("fact").alias("kind"), text.alias("description"), F.lit(f"model:{model}").alias("scope"), F.lit("raw").alias("status")))
    provenance = F.to_json(F.struct(F.col("n").alias("evidence"), "digest"))
    return row.select(F.lit("observation").alias("relation"), args.alias("args"), F.lit(now).cast("long").alias("valid_start"), F.lit("drift").alias("source"), provenance.alias("provenance"))


def differential_drift(results: DataFrame) -> DataFrame:
    """Drift from ``(target, error, resources array<struct<resource, exists, matches, diff>>)``; any error is raised."""
    failed = results.where("error is not null and error <> ''").limit(1).collect()
    if failed:
        raise RuleError(f"observe {failed[0]['target']}: {failed[0]['error']}")
    rows = results.select(F.explode("resources").alias("r")).select("r.*")
    reason = F.when(~F.col("exists"), "missing").when(~F.col("matches"), "changed")
    return rows.select("resource", reason.alias("reason"), F.when(F.col("exists"), F.col("diff")).alias("diff")).where("reason is not null")


def reconcile_edges(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, action)``: edges to add and edges to invalidate."""
    add = wanted.select(*keys).distinct().join(held.select(*keys), keys, "left_anti").withColumn("action", F.lit("add"))
    stale = held.select(*keys).distinct().join(wanted.select(*keys), keys, "left_anti").withColumn("action", F.lit("invalidate"))
    return add.unionByName(stale)


def derive_dependencies(produced: DataFrame, referenced: DataFrame, declared: DataFrame) -> DataFrame:
    """``(model, needs)`` where a model mentions a value that another produces and does not declare it.

    ``produced(model, value)``, ``referenced(model, value)``, ``declared(model, needs)``; a model's own products
    are no references.
    """
    made = produced.distinct()
    foreign = referenced.distinct().join(made, ["model", "value"], "left_anti")
    pairs = foreign.join(made.withColumnRenamed("model", "needs"), "value").where("model <> needs").select("model", "needs").distinct()
    return pairs.join(declared, ["model", "needs"], "left_anti")


def upstream_staleness(closure: DataFrame, status: DataFrame, model: str | None = None) -> DataFrame:
    """``(model, upstream, status)`` of upstreams that are drifted or failed; ``closure(from, to)``."""
    rows = closure if model is None else closure.where(F.col("from") == model)
    bad = status.where(F.col("status").isin("drifted", "failed")).select(F.col("model").alias("to"), "status")
    return rows.join(bad, "to").select(F.col("from").alias("model"), F.col("to").alias("upstream"), "status")


@dataclass(frozen=True)
class Check:
    """A relation that has to be empty or not."""

    name: str
    relation: str
    expect: str = "empty"
    severity: str = "fail"
    scoped: bool = False


def run_checks(engine: Engine, checks: list[Check], run_id: str | None = None) -> list[dict]:
    """Each check's outcome; a scoped one binds ``run_id`` if its relation has that key."""
    out = []
    for check in checks:
        keys = engine.heads[check.relation][0].keys if check.relation in engine.heads else []
        bound = {"run_id": run_id} if check.scoped and run_id and "run_id" in keys else {}
        empty = engine.query(check.relation, bound).isEmpty()
        out.append({"check": check.name, "passed": empty == (check.expect == "empty"), "severity": check.severity})
    return out


def in_selection(targets: Column, selection: list[str]) -> Column:
    """Whether a check or resource is in a run's selection; the others are advisory."""
    return F.arrays_overlap(targets, F.array(*map(F.lit, selection))) if selection else F.lit(True)


def resolve_selector(selector: str, resources: list[dict]) -> list[str]:
    """Resource names for an exact identity, a name, or a whole type; more than one for an identity is an error."""
    exact = [r["name"] for r in resources if selector == f"{r['type']}/{r['name']}"]
    named = [r["name"] for r in resources if selector == r["name"]]
    typed = [r["name"] for r in resources if selector == r["type"]]
    if len(exact) > 1 or len(named) > 1:
        raise RuleError(f"{selector} is ambiguous")
    if named and typed:
        raise RuleError(f"{selector} is both a name and a type")
    if found := exact or named or typed:
        return found
    raise RuleError(f"no resource {selector}")


# Wiring -----------------------------------------------------------------------------------------


def unique_match(records: DataFrame, bindings: DataFrame, keys: list[str]) -> DataFrame:
    """Bindings with how many records they match, and the record where it is one: resolved, absent or ambiguous."""
    counted = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.min("record").alias("record"))
    rows = bindings.join(counted, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    code = F.when(F.col("matches") == 1, "resolved").when(F.col("matches") == 0, "source-absent").otherwise("source-ambiguous")
    return rows.withColumn("code", code).withColumn("record", F.when(F.col("matches") == 1, F.col("record")))


def wire(bindings: DataFrame, snapshots: DataFrame, records: DataFrame, path: str, now: int, max_age: int | None = None) -> DataFrame:
    """Values of bindings ``(input, model, schema, identity)`` from the newest snapshot of their model.

    ``snapshots(snapshot_id, model, created_at long, seq)`` are eligible ones; ``records(snapshot_id, schema,
    identity, record)``. Gives ``(input, snapshot_id, code, value, value_sha256)``.
    """
    order = Window.partitionBy("model").orderBy(F.desc("created_at"), F.desc("seq"))
    newest = snapshots.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("model", "snapshot_id", "created_at")
    wanted = bindings.withColumn("identity", canonical_json(F.col("identity"))).join(newest, "model", "left")
    known = records.withColumn("identity", canonical_json(F.col("identity")))
    rows = unique_match(known, wanted, ["snapshot_id", "schema", "identity"])
    value = pointer(F.col("record"), path)
    age = F.lit(now) - F.col("created_at")
    code = F.when(F.col("snapshot_id").isNull(), "source-absent").when(F.lit(max_age is not None) & (age > (max_age or 0)), "source-too-old")
    code = code.when(F.col("code") != "resolved", F.col("code")).when(value.isNull(), "projection-invalid").otherwise("resolved")
    rows = rows.withColumn("value", value).withColumn("code", code)
    shown = F.when(F.col("code") == "resolved", F.col("value"))
    return rows.select("input", "snapshot_id", "code", shown.alias("value"), content_hash(shown).alias("value_sha256"))


# Convergence ------------------------------------------------------------------------------------


@dataclass
class Convergence:
    outcome: str = ""
    iterations: int = 0
    needs_verification: bool = False
    error: str = ""


#: What each step can come to: the step after it, or the outcome that ends the loop, and whether that leaves the state
#: of the system in doubt (always, or only once something was applied).
STEPS: dict[tuple[str, str], tuple[str | None, str, str]] = {
    ("observe", "clean"): (None, "clean", "never"),
    ("observe", "drift"): ("limits", "", ""),
    ("observe", "error"): (None, "failed:observe", "once applied"),
    ("limits", "dry run"): (None, "dry-run", "never"),
    ("limits", "budget"): (None, "failed:budget-exhausted", "never"),
    ("limits", "cap"): (None, "failed:cap-exhausted", "never"),
    ("limits", "none"): ("apply", "", ""),
    ("apply", "done"): ("record", "", ""),
    ("apply", "error"): (None, "failed:execute", "always"),
    ("record", "done"): ("observe", "", ""),
    ("record", "error"): (None, "needs-verification", "always"),
}


def converge(observe: Callable[[], bool], apply: Callable[[], object], record: Callable[[object], None] | None = None, iterations: int = 3, budget: int | None = None, dry_run: bool = False) -> Convergence:
    """Walks ``STEPS`` from an observation to an end; ``observe`` tells whether nothing drifts.

    Limits are looked at between an observation that drifts and an apply, so the last apply is always observed.
    """
    if iterations < 1:
        raise RuleError("a convergence needs at least one iteration")
    applied: list[object] = []  # receipts

    def write_down() -> str:
        if record is not None:
            record(applied[-1])
        return "done"

    def do() -> str:
        applied.append(apply())
        return "done"

    limits = {"dry run": lambda: dry_run, "budget": lambda: budget is not None and len(applied) >= budget, "cap": lambda: len(applied) >= iterations}
    actions: dict[str, Callable[[], str]] = {
        "observe": lambda: "clean" if observe() else "drift",
        "limits": lambda: next((name for name, reached in limits.items() if reached()), "none"),
        "apply": do,
        "record": write_down,
    }
    step, outcome, doubt, error = "observe", "", "", ""
    while step:
        try:
            event = actions[step]()
        except Exception as e:  # the actions are the caller's
            event, error = "error", str(e)
        step, outcome, doubt = STEPS[step, event]
    return Convergence(outcome, len(applied), doubt == "always" or doubt == "once applied" and bool(applied), error)


def run_verdicts(runs: DataFrame) -> DataFrame:
    """``runs`` with their ``verdict``, from the columns ``outcome`` (of a convergence, null without one),
    ``needs_verification``, ``drift_clean`` (null if not looked at), ``verified``, ``failed_checks`` and ``dry_run``."""
    converged = F.when(F.col("needs_verification"), "unknown").when(F.col("outcome") == "clean", "clean").when(F.col("outcome").startswith("failed"), "failed").otherwise("")
    observed = F.when(F.col("verified") & F.col("drift_clean"), "clean").when(F.col("verified") & ~F.col("drift_clean"), "drifted").otherwise("")
    found = F.when(F.col("dry_run"), "").when(F.col("outcome").isNotNull(), converged).otherwise(observed)
    return runs.withColumn("verdict", F.when((found == "clean") & (F.col("failed_checks") > 0), "drifted").otherwise(found))


#: Verdicts of outcomes by their first word; any other has none.
_VERDICTS = {"clean": "clean", "failed": "failed"}


def run_verdict(convergence: Convergence | None = None, drift_clean: bool | None = None, verified: bool = True, checks: list[dict] = (), dry_run: bool = False) -> str:
    """The same for one run; a failed check turns clean into drifted."""
    if dry_run:
        return ""
    if convergence is not None:
        found = "unknown" if convergence.needs_verification else _VERDICTS.get(convergence.outcome.partition(":")[0], "")
    else:
        found = {True: "clean", False: "drifted"}.get(drift_clean, "") if verified else ""
    return "drifted" if found == "clean" and any(c["severity"] == "fail" and not c["passed"] for c in checks) else found


def plan_digest(plan: Column) -> Column:
    """The digest of a run plan in JSON, whatever the order of its keys."""
    return content_hash(canonical_json(plan))
