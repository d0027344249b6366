"""The library's surface: a workspace with its rules, facts and catalog."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lakeloom.operators.catalog import ENTRIES, Filters, select_entries, sort_entries
from lakeloom.operators.facts import FACTS, RESERVED, scored
from lakeloom.operators.store import FactStore
from lakeloom.plans.engine import Engine
from lakeloom.plans.relations import Relations, Scope
from lakeloom.plans.rules import CONVERGENCE_RULES, load_rules, relation_listing
from lakeloom.plans.terms import Rule

__all__ = ["FACTS", "Engine", "FactStore", "Filters", "Relations", "Rule", "Scope", "Workspace"]

CATALOG = ENTRIES


@dataclass
class Workspace:
    """A store with search paths for rules: those of the repository come after, and shadow, the global ones."""

    spark: SparkSession
    path: str
    global_paths: tuple[str, ...] = ()
    repo_paths: tuple[str, ...] = ()
    read_only: bool = False

    def __post_init__(self) -> None:
        self.store = FactStore(self.spark, self.path, self.read_only)

    def rules(self, extra: Iterable[str | Path] = ()) -> list[Rule]:
        shipped = [Rule.parse(r, f"shipped-{k}") for k, r in enumerate(CONVERGENCE_RULES)]
        return shipped + load_rules([*self.global_paths, *self.repo_paths, *extra])

    def catalog(self) -> DataFrame:
        return self.store.tables.read("entries", CATALOG)

    def engine(self, now: int, extra: Iterable[str | Path] = ()) -> Engine:
        """Rules over the facts, with the catalog and the scored facts as built-in relations."""
        facts = self.store.facts()
        native = {"catalog_entry": self.catalog(), "fact_scored": scored(facts, now)}
        return Engine(Relations(native, facts, RESERVED), self.rules(extra))

    def query(self, relation: str, constraints: dict | None = None, now: int = 0, scope: Scope = Scope(), extra: Iterable[str | Path] = ()) -> DataFrame:
        return self.engine(now, extra).query(relation, constraints, scope)

    def list_catalog(self, filters: Filters = Filters(), sort: str | None = None, reverse: bool = False) -> DataFrame:
        return sort_entries(select_entries(self.catalog(), filters), sort, reverse)

    def relations(self) -> dict[str, list[str]]:
        stored = [r["relation"] for r in self.store.facts().select("relation").distinct().collect()]
        return relation_listing(self.rules(), stored)
