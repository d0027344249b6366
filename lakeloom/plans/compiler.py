"""One rule to one DataFrame plan.

Atoms become scans that read only the keys they name, filters on constants and comparisons go to the scan, shared
variables become equi-joins, and the head a projection with ``distinct`` or a grouped aggregate. The order of
joins follows shared variables, so a cross join is made only where atoms share none; the rest is Catalyst's. Atoms that
only filter another one are semi-joins, where no aggregate counts rows.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.json_values import comparable, comparable_constant, number, plain
from lakeloom.plans.terms import Aggregate, Atom, Comparison, Constant, Rule, RuleError, Variable

_OPERATORS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "!=": operator.ne}
#: relation, keys -> rows and whether their values are in comparable form
Reader = Callable[[str, list[str]], tuple[DataFrame, bool]]


@dataclass
class Bound:
    """Rows of some atoms: a column for each variable, and which are in comparable form."""

    rows: DataFrame
    loose: dict[str, bool]


def equals_constant(column: Column, kind: T.DataType, loose: bool, value: object) -> Column:
    """Typed equality: a number never equals a string."""
    if loose:
        return column == comparable_constant(value)
    text, numeric = isinstance(kind, T.StringType), isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return column == value if text else F.lit(False) if numeric else column.cast("string") == value
    if numeric:
        return column == (int(value) if isinstance(value, bool) else value)
    return column == value if isinstance(kind, T.BooleanType) and isinstance(value, bool) else F.lit(False)


def scan(atom: Atom, read: Reader) -> Bound:
    rows, loose = read(atom.relation, sorted(atom.args))
    columns: dict[str, str] = {}
    for key, term in sorted(atom.args.items()):
        column, kind = F.col(f"`{key}`"), rows.schema[key].dataType
        if isinstance(term, Constant):
            rows = rows.where(equals_constant(column, kind, loose, term.value))
        elif isinstance(term, Comparison):
            limit = float(term.number)
            if isinstance(kind, T.IntegralType) and not loose and limit.is_integer():
                value, limit = column, int(Decimal(term.number))  # exact over 2^53, and pushed down to the scan
            elif loose:
                value = number(column)
            else:
                value = F.lit(None).cast("double") if isinstance(kind, T.StringType) else column.cast("double")
            rows = rows.where(_OPERATORS[term.operator](value, limit))
        elif isinstance(term, Variable):
            if term.name in columns:
                rows = rows.where(F.col(f"`{columns[term.name]}`") == column)
            else:
                columns[term.name] = key
        else:
            raise RuleError("an aggregate can only stand in the head")
    if not columns:
        return Bound(rows.select(F.lit(1).alias("_exists")), {})
    return Bound(rows.select(*(F.col(f"`{k}`").alias(f"${v}") for v, k in columns.items())), dict.fromkeys(columns, loose))


def _aligned(bound: Bound, variable: str, loose: bool, double: bool) -> Column:
    column = F.col(f"`${variable}`")
    if loose and not bound.loose[variable]:
        return comparable(column, bound.rows.schema[f"${variable}"].dataType)
    return column.cast("double") if double else column


def _alike(left: Bound, right: Bound, shared: list[str]) -> tuple[DataFrame, DataFrame, dict[str, bool]]:
    """Both sides with their shared variables in one form, and which of these are in comparable form."""
    kinds = lambda b, v: b.rows.schema[f"${v}"].dataType
    loose = {v: left.loose[v] or right.loose[v] for v in shared}
    out = []
    for side in (left, right):
        rows = side.rows
        for v in shared:
            a, b = kinds(left, v), kinds(right, v)
            mixed = a != b and isinstance(a, T.NumericType) and isinstance(b, T.NumericType)
            text = a != b and not mixed
            rows = rows.withColumn(f"${v}", _aligned(side, v, loose[v] or text, mixed and not loose[v]))
            loose[v] = loose[v] or text
        out.append(rows)
    return *out, loose


def join(left: Bound, right: Bound) -> Bound:
    shared = [v for v in left.loose if v in right.loose]
    if "_exists" in left.rows.columns and not left.loose:
        left = Bound(left.rows.withColumnRenamed("_exists", "_e1"), {})
    if not shared:
        extra = [c for c in right.rows.columns if c in left.rows.columns]
        return Bound(left.rows.crossJoin(right.rows.drop(*extra)), left.loose | right.loose)
    a, b, loose = _alike(left, right, shared)
    extra = [c for c in b.columns if c.startswith("_e")]
    return Bound(a.join(b.drop(*extra), [f"${v}" for v in shared]), left.loose | right.loose | loose)


def with_partner(left: Bound, right: Bound, shared: list[str]) -> Bound:
    """Rows of the left side whose shared variables the right side has too."""
    columns = [f"${v}" for v in shared]
    rows = right.rows.select(*columns)
    if len(shared) < len(right.loose):
        rows = rows.distinct()
    a, b, loose = _alike(left, Bound(rows, {v: right.loose[v] for v in shared}), shared)
    return Bound(a.join(b, columns, "left_semi"), left.loose | loose)


def without_ears(parts: list[Bound], wanted: set[str]) -> list[Bound]:
    """Fewer atoms with the same ``wanted`` values: an atom goes if another one has all of its variables that are wanted or
    in other atoms; the other keeps the rows with a partner. Its further variables are never multiplied out."""
    parts = list(parts)
    k = len(parts) - 1
    while k >= 0:
        others = [p for p in parts if p is not parts[k]]
        used = wanted.union(*(p.loose for p in others))
        shared = [v for v in parts[k].loose if v in used]
        keeper = next((p for p in others if shared and set(shared) <= set(p.loose)), None)
        if keeper is None:
            k -= 1
            continue
        kept = with_partner(keeper, parts[k], shared)
        parts = [kept if p is keeper else p for p in others]
        k = len(parts) - 1
    return parts


def body_rows(rule: Rule, read: Reader, readers: list[Reader] | None = None) -> Bound:
    """All bindings of the body, or without aggregates at least one for each row of the head; ``readers``: another reader
    for each atom."""
    parts = [scan(a, r) for a, r in zip(rule.body, readers or [read] * len(rule.body))]
    if not rule.aggregates:
        parts = without_ears(parts, {t.name for t in rule.head.args.values() if isinstance(t, Variable)})
    bound, rest = parts[0], parts[1:]
    while rest:
        nxt = next((p for p in rest if set(p.loose) & set(bound.loose)), rest[0])
        rest.remove(nxt)
        bound = join(bound, nxt)
    return bound


def compile_rule(rule: Rule, read: Reader, readers: list[Reader] | None = None) -> tuple[DataFrame, dict[str, bool]]:
    """The head's rows, and which of its columns are in comparable form."""
    bound = body_rows(rule, read, readers)
    rows = bound.rows
    plain_keys = [k for k in rule.keys if isinstance(rule.head.args[k], Variable)]
    named = {k: F.col(f"`${rule.head.args[k].name}`") for k in plain_keys}
    loose = {k: bound.loose[rule.head.args[k].name] for k in plain_keys}
    if not rule.aggregates:
        return rows.select(*(named[k].alias(k) for k in rule.keys)).distinct(), loose

    def aggregate(term: Aggregate) -> Column:
        column, kind = F.col(f"`${term.name}`"), rows.schema[f"${term.name}"].dataType
        if term.function == "count":
            return F.count(column).cast("double")
        value = number(column) if bound.loose[term.name] else column.try_cast("double") if isinstance(kind, T.StringType) else column.cast("double")
        return getattr(F, term.function)(value)

    sums = [aggregate(t).alias(k) for k, t in sorted(rule.aggregates.items())]
    grouped = rows.groupBy(*(named[k].alias(k) for k in plain_keys)).agg(*sums) if plain_keys else rows.agg(*sums)
    return grouped.select(*(F.col(f"`{k}`") for k in rule.keys)), loose | dict.fromkeys(rule.aggregates, False)


def shown(rows: DataFrame, loose: dict[str, bool]) -> DataFrame:
    """Results as users see them: strings without quotes."""
    return rows.select(*(plain(F.col(f"`{c}`")).alias(c) if loose.get(c) else F.col(f"`{c}`") for c in rows.columns))
