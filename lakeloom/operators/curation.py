"""Feedback along version chains, and the transitions that it asks for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.engine import Engine
from lakeloom.plans.lineage import shared_folder
from lakeloom.plans.relations import Relations, Scope

#: Links that are looked at together for runs, and most links of a run.
NEARBY, LONGEST = 100_000, 250


def _runs(batches: Iterator[pa.RecordBatch], nearby: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Links ``(newer, older)`` of one task as runs of ids, oldest first; each link is in one run. A run begins where the
    older id has no link nearby or another version follows it."""

    def found(links: list[tuple[str, str]]) -> Iterator[list[str]]:
        older: dict[str, str] = {}
        for newer, old in links:
            if older.setdefault(newer, old) != old:
                yield [old, newer]
        follower: dict[str, str] = {}
        for newer, old in older.items():
            follower.setdefault(old, newer)
        starts = [n for n, o in older.items() if o not in older or follower[o] != n]
        left = dict.fromkeys(older)
        for first in starts:
            yield from walked(first, older, follower, left)
        while left:  # circles
            yield from walked(next(iter(left)), older, follower, left)

    def walked(node: str | None, older: dict[str, str], follower: dict[str, str], left: dict[str, None]) -> Iterator[list[str]]:
        run = [older[node]]
        while node in left:
            del left[node]
            run.append(node)
            if len(run) > longest:
                yield run
                run = [node]
            node = follower.get(node)
        if len(run) > 1:
            yield run

    def written(links: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        runs = found(links)
        while part := list(islice(runs, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["ids"])

    held: list[tuple[str, str]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(held) >= nearby:
            yield from written(held)
            held = []
    yield from written(held)


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder; unlike after a checkpoint their size is known to the planner."""
    folder = shared_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _special(runs: DataFrame, longest: int) -> DataFrame:
    """``(hash, links, runs)`` of ids with several links, and of ids before a run that have a link."""
    name = lambda column: F.xxhash64(column).alias("hash")
    owned = runs.select(F.explode(F.slice("ids", 2, longest)).alias("id")).select(name("id"), F.lit(1).alias("links"), F.lit(0).alias("runs"))
    before = runs.select(name(F.col("ids")[0]), F.lit(0).alias("links"), F.lit(1).alias("runs"))
    counts = owned.unionByName(before).groupBy("hash").agg(F.sum("links").alias("links"), F.sum("runs").alias("runs"))
    return _kept(counts.where("links > 1 or links > 0 and runs > 0"), "special")


def lineage(facts: DataFrame, nearby: int = NEARBY, longest: int = LONGEST) -> DataFrame:
    """``(id, ancestor)`` for every version of a fact and all before it.

    Links that lie near each other are put together to runs first, and pairs within a run are never stored or
    shuffled. Only the runs' own links, where one run goes on in another, need the recursive rule.
    """
    links = facts.select(F.col("id").alias("newer"), F.get_json_object("args", "$.prevVersion").alias("older")).where("older is not null")
    runs = _kept(links.mapInArrow(partial(_runs, nearby=nearby, longest=longest), "ids array<string>"), "runs")

    run = F.to_json(F.slice("ids", 1, 2))
    special = _special(runs, longest)
    if not special.where("links > 1").isEmpty():  # such ids end their run: links of their own, once each
        numbered = runs.select(run.alias("run"), "ids")
        hit = numbered.select("run", F.explode(F.slice("ids", 2, longest)).alias("id")).withColumn("hash", F.xxhash64("id"))
        hit = hit.join(special.where("links > 1").select("hash"), "hash").select("run").distinct()
        single = numbered.join(hit, "run", "left_semi").select("ids", F.posexplode("ids").alias("at", "id")).where("at > 0")
        whole = numbered.join(hit, "run", "left_anti").select("ids")
        runs = _kept(whole.unionByName(single.select(F.slice("ids", F.col("at"), F.lit(2)).alias("ids")).distinct()), "runs")
        special = _special(runs, longest)
    several = not special.where("links > 1").isEmpty()

    def pairs(rows: DataFrame) -> DataFrame:
        """Each member with all before it in its run."""
        members = rows.select("ids", F.posexplode("ids").alias("at", "id")).where("at > 0")
        return members.select("id", F.explode(F.slice("ids", F.lit(1), F.col("at"))).alias("ancestor"))

    near = pairs(runs)
    if special.isEmpty():
        return near
    members = runs.select(run.alias("into"), F.posexplode("ids").alias("at", "id")).where("at > 0").withColumn("hash", F.xxhash64("id"))
    members = members.join(special.select("hash"), "hash").drop("hash")
    ends = runs.select(run.alias("run"), F.col("ids")[0].alias("id"))
    joints = _kept(ends.join(members, "id").select("run", "into", "at"), "joints")
    rules = [
        {"head": {"rel": "lineage", "args": {"newer": "$A", "older": "$B"}}, "body": [{"rel": "version", "args": {"newer": "$A", "older": "$B"}}]},
        {"head": {"rel": "lineage", "args": {"newer": "$A", "older": "$C"}}, "body": [{"rel": "version", "args": {"newer": "$A", "older": "$B"}}, {"rel": "lineage", "args": {"newer": "$B", "older": "$C"}}]},
    ]
    steps = joints.select(F.col("run").alias("newer"), F.col("into").alias("older")).distinct()
    reached = Engine(Relations({"version": steps}), rules).query("lineage")
    later = reached.select(F.col("newer").alias("first"), F.col("older").alias("run")).join(joints, "run").select(F.col("first").alias("run"), "into", "at")
    spans = _kept(joints.unionByName(later).groupBy("run", "into").agg(F.max("at").alias("at")), "spans")
    own = runs.select(run.alias("run"), F.slice("ids", 2, longest).alias("own"))
    there = runs.select(run.alias("into"), F.col("ids").alias("theirs"))
    far = spans.join(own, "run").join(there, "into").select("theirs", "at", F.explode("own").alias("id")).select("id", F.explode(F.slice("theirs", F.lit(1), F.col("at"))).alias("ancestor"))
    all_pairs = near.unionByName(far)
    # Only where an id has several links or a run leads back to itself can a pair come twice.
    return all_pairs.distinct() if several or not spans.where("run = into").isEmpty() else all_pairs


def feedback_tally(facts: DataFrame) -> DataFrame:
    """Helpful and harmful verdicts on each target."""
    rows = facts.where((F.col("relation") == "feedback") & Scope().predicate())
    rows = rows.select(F.get_json_object("args", "$.target").alias("target"), F.get_json_object("args", "$.verdict").alias("verdict")).where("target <> ''")
    return rows.groupBy("target").agg(F.count_if(F.col("verdict") == "helpful").alias("helpful"), F.count_if(F.col("verdict") == "harmful").alias("harmful"))


def curation_plan(facts: DataFrame, promote_helpful: int = 3, reject_harmful: int = 2, chains: DataFrame | None = None) -> DataFrame:
    """``(id, from_status, to_status, helpful, harmful)`` of observations that feedback moves on."""
    chains = lineage(facts) if chains is None else chains
    live = facts.where((F.col("relation") == "observation") & Scope().predicate())
    live = live.select("id", F.coalesce(F.get_json_object("args", "$.status"), F.lit("raw")).alias("from_status"))
    live = live.where(~F.col("from_status").isin("promoted", "rejected"))
    versions = live.select("id", F.col("id").alias("target")).unionByName(chains.join(live.select("id"), "id", "left_semi").select("id", F.col("ancestor").alias("target")))
    tally = versions.join(feedback_tally(facts), "target").groupBy("id").agg(F.sum("helpful").alias("helpful"), F.sum("harmful").alias("harmful"))
    rows = live.join(tally, "id")
    ready = (F.col("harmful") == 0) & (F.col("helpful") >= promote_helpful)
    to = F.when(F.col("harmful") >= reject_harmful, "rejected").when(ready & (F.col("from_status") == "raw"), "reviewed").when(ready & (F.col("from_status") == "reviewed"), "promoted")
    return rows.withColumn("to_status", to).where("to_status is not null").select("id", "from_status", "to_status", "helpful", "harmful")
