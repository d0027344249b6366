"""Orderings and closures of dependency graphs.

Levels are computed in DataFrames; an order for a run is made on the driver from models, of which a workspace has
few by nature.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.lineage import cut
from lakeloom.plans.terms import RuleError


def topological_order(edges: list[tuple[str, str]], nodes: list[str] = ()) -> list[str]:
    """Dependencies first, the smallest name first among those that are ready; ``edges``: (model, what it needs)."""
    needs: dict[str, set[str]] = {n: set() for n in nodes}
    for model, needed in edges:
        needs.setdefault(model, set()).add(needed)
        needs.setdefault(needed, set())
    users: dict[str, list[str]] = {}
    for model, wanted in needs.items():
        for n in wanted:
            users.setdefault(n, []).append(model)
    left = {m: len(w) for m, w in needs.items()}
    ready = [m for m, n in left.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(heapq.heappop(ready))
        for user in users.get(out[-1], ()):
            left[user] -= 1
            if not left[user]:
                heapq.heappush(ready, user)
    if len(out) < len(needs):
        raise RuleError(f"cycle among {', '.join(sorted(set(needs) - set(out)))}")
    return out


def levels(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, level)``: 0 for nodes that need nothing, else one more than what they need; ``edges(from, to)``."""
    edges = cut(edges.select("from", "to").distinct())
    nodes = edges.select(F.col("from").alias("node")).union(edges.select("to")).distinct()
    level = cut(nodes.withColumn("level", F.lit(0)))
    for _ in range(rounds):
        deeper = edges.join(level.withColumnRenamed("node", "to"), "to").groupBy(F.col("from").alias("node")).agg((F.max("level") + 1).alias("_next"))
        new = cut(level.join(deeper, "node", "left").select("node", F.coalesce("_next", F.lit(0)).alias("level")))
        if new.join(level.withColumnRenamed("level", "_old"), "node").where("level <> _old").isEmpty():
            return new
        level = new
    raise RuleError(f"no end after {rounds} levels: the graph has a cycle")


def run_set(models: dict[str, dict], selected: list[str]) -> list[str]:
    """The order of a run: the selected models (by name or alias) and all that they require.

    A model is ``{"aliases": [...], "requires": [...], "after": [...]}``; ``after`` orders without requiring.
    """
    names: dict[str, str] = {}
    for name, spec in models.items():
        for alias in (name, *spec.get("aliases", ())):
            if names.setdefault(alias, name) != name:
                raise RuleError(f"{alias} names both {names[alias]} and {name}")

    def resolve(alias: str) -> str:
        if alias not in names:
            raise RuleError(f"no model {alias}")
        return names[alias]

    wanted: set[str] = set()
    todo = [resolve(s) for s in selected]
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            required = [resolve(r) for r in models[name].get("requires", ())]
            if name in required:
                raise RuleError(f"{name} requires itself")
            todo += required
    edges = [(n, resolve(r)) for n in wanted for kind in ("requires", "after") for r in models[n].get(kind, ()) if kind == "requires" or r in names]
    return topological_order([e for e in edges if e[1] in wanted], sorted(wanted))


def select_resources(resources: dict[str, list[str]], selection: list[str]) -> list[str]:
    """The selection and everything it depends on, in order."""
    wanted, todo = set(), list(selection)
    while todo:
        name = todo.pop()
        if name not in resources:
            raise RuleError(f"no resource {name}")
        if name not in wanted:
            wanted.add(name)
            todo += resources[name]
    return topological_order([(n, d) for n in wanted for d in resources[n]], sorted(wanted))


def dependency_listing(edges: DataFrame) -> DataFrame:
    """Edges merged by both ends, with all sources that state them."""
    return edges.groupBy("from", "to").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
