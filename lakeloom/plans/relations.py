"""Relation adapters: what a body atom reads.

Three kinds: a *native* relation is any DataFrame whose columns are the keys; a *stored* relation is a slice of
the fact table whose keys are read from JSON text; a *derived* relation is what rules give. Stored relations obey
the temporal scope, native ones are outside of time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.json_values import member
from lakeloom.plans.terms import RuleError


@dataclass(frozen=True)
class Scope:
    """A point in valid time, in transaction time, both, or neither (what holds now)."""

    valid_at: int | None = None
    tx_at: int | None = None

    def predicate(self) -> Column:
        started = lambda name, at: (F.col(f"{name}_start") <= at) & (F.col(f"{name}_end").isNull() | (F.col(f"{name}_end") > at))
        if self.valid_at is None and self.tx_at is None:
            return F.col("valid_end").isNull() & F.col("tx_end").isNull()
        if self.tx_at is None:
            return started("valid", self.valid_at) & F.col("tx_end").isNull()
        if self.valid_at is None:
            return started("tx", self.tx_at)
        return started("valid", self.valid_at) & started("tx", self.tx_at)


class Relations:
    """Where relations come from; ``reserved`` native names can be neither asserted nor queried without a rule."""

    def __init__(self, native: dict[str, DataFrame] | None = None, facts: DataFrame | None = None, reserved: set[str] = frozenset()):
        self.native, self.facts, self.reserved = dict(native or {}), facts, set(reserved)

    def read(self, relation: str, keys: list[str], scope: Scope) -> tuple[DataFrame, bool]:
        """The relation's columns ``keys``, and whether they are in comparable form (see json_values)."""
        if relation in self.native:
            df = self.native[relation]
            if missing := [k for k in keys if k not in df.columns]:
                raise RuleError(f"{relation} has no {', '.join(missing)}; it has {', '.join(df.columns)}")
            return df.select(*keys) if keys else df.select(F.lit(1).alias("_")), False
        if self.facts is None:
            raise RuleError(f"no relation {relation}")
        live = self.facts.where((F.col("relation") == relation) & scope.predicate())
        return live.select(*(member(F.col("args"), k).alias(k) for k in keys)) if keys else live.select(F.lit("1").alias("_")), True
