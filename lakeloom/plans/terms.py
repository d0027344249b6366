"""Terms, atoms and rules.

A rule is ``{"head": {"rel": ..., "args": {...}}, "body": [{"rel": ..., "args": {...}}, ...]}``. An argument is
a variable ("$X"), an aggregate of one ("count($X)", head only), a comparison with a number (">=10", body
only) or a value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_AGGREGATE = re.compile(r"(count|sum|min|max)\(\$([A-Za-z_]\w*)\)")
_COMPARISON = re.compile(r"(>=|<=|!=|>|<)\s*(-?\d+(?:\.\d+)?)")
Scalar = str | int | float | bool


class RuleError(ValueError):
    """A rule or query that has no meaning."""


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Aggregate:
    function: str
    name: str


@dataclass(frozen=True)
class Comparison:
    operator: str
    number: int | float


@dataclass(frozen=True)
class Constant:
    value: Scalar


Term = Variable | Aggregate | Comparison | Constant


def parse_term(raw: object) -> Term:
    if isinstance(raw, str):
        if m := _AGGREGATE.fullmatch(raw):
            return Aggregate(m[1], m[2])
        if m := _COMPARISON.fullmatch(raw):
            return Comparison(m[1], float(m[2]) if "." in m[2] else int(m[2]))
        if raw.startswith("$"):
            return Variable(raw[1:])
    if isinstance(raw, Scalar):
        return Constant(raw)
    raise RuleError(f"a term must be a string, number or boolean, not {type(raw).__name__}")


@dataclass(frozen=True)
class Atom:
    relation: str
    args: dict[str, Term]

    @classmethod
    def parse(cls, raw: dict) -> Atom:
        return cls(raw["rel"], {k: parse_term(v) for k, v in (raw.get("args") or {}).items()})

    def variables(self) -> set[str]:
        return {t.name for t in self.args.values() if isinstance(t, Variable)}


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]
    name: str = field(default="", compare=False)

    @classmethod
    def parse(cls, raw: dict, name: str = "") -> Rule:
        rule = cls(Atom.parse(raw["head"]), tuple(Atom.parse(b) for b in raw["body"]), name)
        rule.check()
        return rule

    @property
    def keys(self) -> list[str]:
        """Output columns: the head's variables and aggregates, sorted; its constants are not output."""
        return sorted(k for k, t in self.head.args.items() if isinstance(t, (Variable, Aggregate)))

    @property
    def aggregates(self) -> dict[str, Aggregate]:
        return {k: t for k, t in self.head.args.items() if isinstance(t, Aggregate)}

    def check(self) -> None:
        if not self.body:
            raise RuleError(f"rule for {self.head.relation} has no body")
        bound = set().union(*(a.variables() for a in self.body))
        for atom in self.body:
            if any(isinstance(t, Aggregate) for t in atom.args.values()):
                raise RuleError(f"rule for {self.head.relation}: an aggregate can only stand in the head")
        for key, term in self.head.args.items():
            if isinstance(term, Comparison):
                raise RuleError(f"rule for {self.head.relation}: {key} compares in the head")
            if isinstance(term, (Variable, Aggregate)) and term.name not in bound:
                raise RuleError(f"rule for {self.head.relation}: ${term.name} is not bound by the body")
        if not self.keys:
            raise RuleError(f"rule for {self.head.relation} has no variable in its head")
