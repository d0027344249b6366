"""Bitemporal facts: scans, scopes, statistics, and the row changes of assertions.

A fact table has the columns of ``FACTS``. Changes return a new table; :mod:`lakeloom.operators.store` commits it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.ids import fact_id
from lakeloom.functions.json_values import comparable_constant, member
from lakeloom.functions.scores import decayed
from lakeloom.plans.relations import Scope
from lakeloom.plans.terms import RuleError

FACTS = "id string, relation string, args string, valid_start long, valid_end long, tx_start long, tx_end long, source string, provenance string"
#: Relations that are computed and cannot be asserted.
RESERVED = {"catalog_entry", "fact_scored"}
#: Enumerations of the known relations.
OBSERVATION_KINDS = ("fact", "obstacle", "pattern", "antipattern", "suggestion", "bug", "opportunity")
STATUSES = ("raw", "reviewed", "promoted", "rejected")
VERDICTS = ("helpful", "harmful", "neutral")
OUTCOMES = ("success", "failure")


class NotFound(LookupError):
    """No such row."""


class Ambiguous(LookupError):
    """More than one row where one is meant."""


def parse_time(text: str) -> int:
    """Unix seconds of an RFC 3339 time or of a number."""
    if text.lstrip("-").isdigit():
        return int(text)
    return int(dt.datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp())


def time_seconds(text: Column) -> Column:
    """The same for a column of texts; null for what is neither."""
    return F.coalesce(text.try_cast("long"), F.unix_seconds(text.try_cast("timestamp")))


def scan(facts: DataFrame, relation: str | None = None, scope: Scope = Scope(), source: str | None = None) -> DataFrame:
    """Facts in scope, newest first."""
    rows = facts.where(scope.predicate())
    if relation is not None:
        rows = rows.where(F.col("relation") == relation)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows.orderBy(F.desc("valid_start"), "id")


def current(facts: DataFrame, relation: str | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """What holds now, without times; ``filters`` compare keys of the arguments by type."""
    rows = facts.where(Scope().predicate())
    if relation is not None:
        rows = rows.where(F.col("relation") == relation)
    for key, value in (filters or {}).items():
        rows = rows.where(member(F.col("args"), key) == comparable_constant(value))
    return rows.select("id", "relation", "args", "source", "provenance")


def history(facts: DataFrame, relation: str) -> DataFrame:
    """All versions of a relation's facts in the order they were recorded."""
    return facts.where(F.col("relation") == relation).orderBy("tx_start", "valid_start", "id")


def lookup(facts: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    """The one row whose id begins so."""
    found = facts.where(F.col(column).startswith(prefix)).limit(2)
    n = found.count()
    if n == 0:
        raise NotFound(prefix)
    if n > 1 and facts.where(F.col(column) == prefix).limit(2).count() != 1:
        raise Ambiguous(prefix)
    return found if n == 1 else facts.where(F.col(column) == prefix)


def scored(facts: DataFrame, now: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Current facts with their worth and what is left of it by age, and the columns ``keep``."""
    age = F.lit(now) - F.col("valid_start")
    worth = F.get_json_object("args", "$.worth").try_cast("double")
    rows = facts.where(Scope().predicate())
    return rows.select("id", "relation", "source", age.alias("age_seconds"), worth.alias("worth"), decayed(worth, age).alias("decayed_worth"), *keep)


def top_by_worth(facts: DataFrame, now: int, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` current facts that are worth most by now, and those that tie with the last of them."""
    rows = scored(facts, now, keep).where("decayed_worth is not null")
    least = rows.orderBy(F.desc("decayed_worth")).limit(n).agg(F.min("decayed_worth").alias("_least"))
    return rows.join(F.broadcast(least), F.col("decayed_worth") >= F.col("_least")).drop("_least")  # one row


def statistics(facts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of current facts by relation, source or keys of the arguments, most first."""
    named = {"relation": F.col("relation"), "source": F.col("source")}
    keys = [named.get(k, F.get_json_object("args", f"$.{k}")).alias(k) for k in by]
    return facts.where(Scope().predicate()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def pull(facts: DataFrame, scope_prefix: str | None = None, kind: str | None = None, source: str | None = None, relation: str | None = None) -> DataFrame:
    """Live facts by scope prefix, kind, source and relation, newest first."""
    rows = facts.where(Scope().predicate())
    if scope_prefix is not None:
        rows = rows.where(F.get_json_object("args", "$.scope").startswith(scope_prefix))
    if kind is not None:
        rows = rows.where(F.get_json_object("args", "$.kind") == kind)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if relation is not None:
        rows = rows.where(F.col("relation") == relation)
    return rows.orderBy(F.desc("valid_start"), "id")


def summary(args: Column, width: int = 60) -> Column:
    """The kind and description of arguments, or the arguments, cut to a width."""
    kind, text = F.get_json_object(args, "$.kind"), F.get_json_object(args, "$.description")
    full = F.coalesce(F.when(kind.isNotNull(), F.concat(F.lit("["), kind, F.lit("] "), F.coalesce(text, F.lit("")))), args)
    return F.when(F.length(full) > width, F.concat(F.substring(full, 1, width - 3), F.lit("..."))).otherwise(full)


def invalid(args: Column, relation: Column) -> Column:
    """What is wrong with the arguments of a known relation; null where nothing is."""
    get = lambda k: F.get_json_object(args, f"$.{k}")
    worth = get("worth")
    observation = (
        F.when(~get("kind").isin(*OBSERVATION_KINDS) | get("kind").isNull(), "kind")
        .when(get("description").isNull(), "description")
        .when(F.coalesce(~get("status").isin(*STATUSES), F.lit(False)), "status")
        .when(worth.isNotNull() & (worth.try_cast("double").isNull() | ~worth.try_cast("double").between(0, 1)), "worth")
    )
    feedback = F.when(get("target").isNull(), "target").when(~get("verdict").isin(*VERDICTS) | get("verdict").isNull(), "verdict").when(F.coalesce(~get("outcome").isin(*OUTCOMES), F.lit(False)), "outcome")
    return F.when(F.try_parse_json(args).isNull(), "json").when(relation == "observation", observation).when(relation == "feedback", feedback)


# Changes ----------------------------------------------------------------------------------------


def asserted(new: DataFrame, now: int, validate: bool = True) -> DataFrame:
    """``new(relation, args, valid_start?, source, provenance?)`` as facts with their ids, one row for each id."""
    for column, kind in (("valid_start", "long"), ("provenance", "string"), ("source", "string")):
        if column not in new.columns:
            new = new.withColumn(column, F.lit(None).cast(kind))
    new = new.withColumn("valid_start", F.coalesce("valid_start", F.lit(now)).cast("long"))
    problems = new.where(F.col("relation").isin(*RESERVED)).limit(1).count()
    if problems:
        raise RuleError("a reserved relation cannot be asserted")
    if validate:
        bad = new.select("relation", invalid(F.col("args"), F.col("relation")).alias("bad")).where("bad is not null and bad <> 'json'").limit(1).collect()
        if bad:
            raise RuleError(f"{bad[0]['relation']}: {bad[0]['bad']} is not valid")
    return new.select(
        fact_id(F.col("relation"), F.col("args"), F.col("valid_start"), F.col("source")).alias("id"), "relation", "args", "valid_start", F.lit(None).cast("long").alias("valid_end"),
        F.lit(now).cast("long").alias("tx_start"), F.lit(None).cast("long").alias("tx_end"), "source", "provenance",
    ).dropDuplicates(["id"])


def add(facts: DataFrame, new: DataFrame, now: int, validate: bool = True) -> DataFrame:
    """``facts`` and those of ``new`` whose id is not there yet."""
    rows = asserted(new, now, validate)
    return facts.unionByName(rows.join(facts.select("id"), "id", "left_anti").select(facts.columns))


def open_facts(facts: DataFrame) -> DataFrame:
    """Facts that hold now."""
    return facts.where(Scope().predicate())


def _close(facts: DataFrame, fact: str, column: str, now: int) -> DataFrame:
    if facts.where((F.col("id") == fact) & F.col(column).isNull()).isEmpty():
        raise NotFound(f"no open fact {fact}")
    return facts.withColumn(column, F.when((F.col("id") == fact) & F.col(column).isNull(), F.lit(now).cast("long")).otherwise(F.col(column)))


def retract(facts: DataFrame, fact: str, now: int) -> DataFrame:
    """The fact was never so: closes its transaction time."""
    return _close(facts, fact, "tx_end", now)


def invalidate(facts: DataFrame, fact: str, now: int) -> DataFrame:
    """The fact is no longer so: closes its valid time."""
    return _close(facts, fact, "valid_end", now)


def observation(kind: str, description: str, scope: str | None = None, source: str | None = None, worth: float | None = None) -> dict:
    """The arguments of an observation fact."""
    import json

    if kind not in OBSERVATION_KINDS:
        raise RuleError(f"kind must be one of {', '.join(OBSERVATION_KINDS)}")
    args = {"kind": kind, "description": description, "scope": scope, "source": source, "status": "raw", "worth": worth}
    return {"relation": "observation", "args": json.dumps({k: v for k, v in args.items() if v is not None}), "source": source}


#: Allowed changes of an observation's status.
TRANSITIONS = {("raw", "reviewed"), ("raw", "rejected"), ("reviewed", "promoted"), ("reviewed", "rejected")}


def promote(facts: DataFrame, fact: str, status: str, now: int, promoted_to: str | None = None) -> tuple[DataFrame, str]:
    """Closes an observation and adds its next version, which names the one before; returns the new id."""
    import json

    row = lookup(facts.where(Scope().predicate()), fact).first()
    args = json.loads(row["args"])
    before = args.get("status") or "raw"
    if (before, status) not in TRANSITIONS:
        raise RuleError(f"an observation cannot go from {before} to {status}")
    args |= {"status": status, "prevVersion": row["id"]} | ({"promotedTo": promoted_to} if promoted_to else {})
    spark = facts.sparkSession
    new = spark.createDataFrame([(row["relation"], json.dumps(args), now, row["source"], row["provenance"])], "relation string, args string, valid_start long, source string, provenance string")
    out = add(invalidate(facts, row["id"], now), new, now, validate=False)
    made = new.select(fact_id(F.col("relation"), F.col("args"), F.col("valid_start"), F.col("source")).alias("id")).first()["id"]
    return out, made
