"""Evaluation of rules: strata, recursion to a fixpoint, and queries with constraints.

Rule heads are put into strata by the strongly connected components of who reads whom. A stratum without a cycle
is a union of plans; one with a cycle is computed semi-naively, joining only what the last round found, until a
round finds nothing new. What a round finds is checkpointed in the shared folder. A transitive closure doubles
the length of its paths each round.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.json_values import comparable
from lakeloom.plans.compiler import compile_rule, shown
from lakeloom.plans.lineage import cut
from lakeloom.plans.relations import Relations, Scope
from lakeloom.plans.terms import Atom, Constant, Rule, RuleError, Variable


def strata(rules: Iterable[Rule]) -> list[list[str]]:
    """Heads in strongly connected components, each after those it reads."""
    reads: dict[str, set[str]] = {}
    for rule in rules:
        reads.setdefault(rule.head.relation, set()).update(a.relation for a in rule.body)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []
    for root in reads:
        if root in order:
            continue
        todo = [(root, iter(sorted(reads[root])))]
        order[root] = low[root] = len(order)
        stack.append(root)
        while todo:
            node, targets = todo[-1]
            for target in targets:
                if target not in reads:
                    continue
                if target not in order:
                    order[target] = low[target] = len(order)
                    stack.append(target)
                    todo.append((target, iter(sorted(reads[target]))))
                    break
                if target in stack:
                    low[node] = min(low[node], order[target])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                    out.append(sorted(group))
    return out


class Engine:
    def __init__(self, relations: Relations, rules: Iterable[Rule | dict], rounds: int = 100, stratified_aggregates: bool = False):
        self.relations, self.rounds = relations, rounds
        self.rules = [r if isinstance(r, Rule) else Rule.parse(r) for r in rules]
        self.heads: dict[str, list[Rule]] = {}
        for rule in self.rules:
            self.heads.setdefault(rule.head.relation, []).append(rule)
        self.strata = strata(self.rules)
        for relation, own in self.heads.items():
            if relation in relations.reserved:
                raise RuleError(f"{relation} is built in and cannot be a head")
            if any(r.keys != own[0].keys for r in own):
                raise RuleError(f"the rules for {relation} have different keys")
            layered = any(a.relation in self.heads for r in own for a in r.body)
            cyclic = any(relation in s and (len(s) > 1 or any(a.relation == relation for r in own for a in r.body)) for s in self.strata)
            if any(r.aggregates for r in own) and (cyclic or layered and not stratified_aggregates):
                raise RuleError(f"{relation} aggregates over derived relations")

    def query(self, relation: str, constraints: dict[str, object] | None = None, scope: Scope = Scope()) -> DataFrame:
        """The rows of a relation that meet all ``key = value`` constraints."""
        constraints = constraints or {}
        if relation not in self.heads:
            if relation in self.relations.reserved:
                raise RuleError(f"{relation} is built in: ask for it through a rule")
            return self._stored(relation, constraints, scope)
        if unknown := [k for k in constraints if k not in self.heads[relation][0].keys]:
            raise RuleError(f"{relation} has no {', '.join(unknown)}")
        derived: dict[str, tuple[DataFrame, dict[str, bool]]] = {}
        needed = self._needed(relation)
        for stratum in self.strata:
            if any(r in needed for r in stratum):
                derived |= self._stratum(stratum, derived, scope, constraints if stratum == [relation] else {})
        rows, loose = derived[relation]
        return self._constrained(shown(rows, loose), constraints)

    def _needed(self, relation: str) -> set[str]:
        seen, todo = set(), [relation]
        while todo:
            r = todo.pop()
            if r not in seen:
                seen.add(r)
                todo += [a.relation for rule in self.heads.get(r, ()) for a in rule.body]
        return seen

    def _constrained(self, rows: DataFrame, constraints: dict[str, object]) -> DataFrame:
        """Texts agree, or both are numbers and agree as such."""
        for key, value in constraints.items():
            column = F.col(f"`{key}`")
            text = str(value).lower() if isinstance(value, bool) else str(value)
            same = column.cast("string") == text
            try:
                same = same | F.coalesce(column.try_cast("double") == float(text), F.lit(False))
            except ValueError:
                pass
            rows = rows.where(same)
        return rows

    def _stored(self, relation: str, constraints: dict[str, object], scope: Scope) -> DataFrame:
        if relation in self.relations.native:
            return self._constrained(self.relations.native[relation], constraints)
        if self.relations.facts is None:
            raise RuleError(f"no relation {relation}")
        live = self.relations.facts.where((F.col("relation") == relation) & scope.predicate())
        for key, value in constraints.items():
            found = self._constrained(live.withColumn("_value", F.get_json_object("args", f"$.{key}")), {"_value": value})
            live = found.drop("_value")
        return live

    def _reader(self, derived: dict, scope: Scope, own: dict | None = None):
        def read(relation: str, keys: list[str]) -> tuple[DataFrame, bool]:
            found = (own or {}).get(relation) or derived.get(relation)
            if found is None:
                return self.relations.read(relation, keys, scope)
            rows, loose = found
            if missing := [k for k in keys if k not in rows.columns]:
                raise RuleError(f"{relation} has no {', '.join(missing)}")
            rows = rows.select(*keys) if keys else rows.select(F.lit(1).alias("_"))
            if any(loose.get(k) for k in keys):  # one form for all columns
                rows = rows.select(*(F.col(k) if loose.get(k) else comparable(F.col(k), rows.schema[k].dataType).alias(k) for k in keys))
                return rows, True
            return rows, False

        return read

    def _union(self, parts: list[tuple[DataFrame, dict[str, bool]]]) -> tuple[DataFrame, dict[str, bool]]:
        loose = {c: any(p[1].get(c) for p in parts) for c in parts[0][0].columns}

        def aligned(rows: DataFrame, own: dict[str, bool]) -> DataFrame:
            return rows.select(*(comparable(F.col(c), rows.schema[c].dataType).alias(c) if loose[c] and not own.get(c) else F.col(c) for c in rows.columns))

        return reduce(DataFrame.unionByName, (aligned(*p) for p in parts)), loose

    def _stratum(self, stratum: list[str], derived: dict, scope: Scope, constraints: dict[str, object]) -> dict:
        read = self._reader(derived, scope)
        own = [r for name in stratum for r in self.heads[name]]
        recursive = [r for r in own if any(a.relation in stratum for a in r.body)]
        if not recursive:
            name = stratum[0]
            rows, loose = self._union([compile_rule(r, read) for r in own])
            layered = any(a.relation in self.heads for r in own for a in r.body)
            return {name: (rows.distinct() if layered and not any(r.aggregates for r in own) else rows, loose)}

        totals: dict[str, tuple[DataFrame, dict[str, bool]]] = {}
        for name in stratum:
            seeds = [compile_rule(r, read) for r in self.heads[name] if r not in recursive]
            if not seeds:
                continue
            rows, loose = self._union(seeds)
            for key in self._invariant(name, recursive, constraints):
                if loose.get(key):
                    rows = rows.where(self._loose_match(key, constraints[key]))
                else:
                    rows = self._constrained(rows, {key: constraints[key]})
            totals[name] = (cut(rows.distinct()), loose)
        recursive = [self._squared(r) or r for r in recursive] if len(stratum) == 1 else recursive
        # Relations that only others of the stratum feed begin empty, with the columns of a rule that can be read.
        while missing := [n for n in stratum if n not in totals]:
            ready = [r for r in recursive if r.head.relation in missing and all(a.relation in totals or a.relation not in stratum for a in r.body)]
            if not ready:
                raise RuleError(f"{', '.join(missing)}: no rule to start from")
            for rule in ready:
                if rule.head.relation not in totals:
                    rows, loose = compile_rule(rule, self._reader(derived, scope, totals))
                    totals[rule.head.relation] = (cut(rows.limit(0)), loose)
        delta = dict(totals)
        for _ in range(self.rounds):
            found: dict[str, list] = {}
            for rule in recursive:
                for at, atom in enumerate(rule.body):
                    if atom.relation in stratum and atom.relation in delta:
                        readers = [self._reader(derived, scope, delta if k == at else totals) for k in range(len(rule.body))]
                        found.setdefault(rule.head.relation, []).append(compile_rule(rule, read, readers))
            fresh = {}
            for name, parts in found.items():
                known, loose = totals[name]
                rows, _ = self._union([*parts, (known.limit(0), loose)])
                match = reduce(lambda a, b: a & b, (F.col(f"n.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in known.columns))
                new = cut(rows.distinct().alias("n").join(known.alias("k"), match, "left_anti"))
                if not new.isEmpty():
                    fresh[name] = (new, loose)
            if not fresh:
                return totals
            for name, (new, loose) in fresh.items():
                totals[name] = (cut(totals[name][0].unionByName(new).coalesce(max(1, new.sparkSession.sparkContext.defaultParallelism))), loose)
            delta = fresh
        raise RuleError(f"{', '.join(stratum)}: no fixpoint after {self.rounds} rounds")

    @staticmethod
    def _loose_match(key: str, value: object):
        from lakeloom.functions.json_values import comparable_constant

        forms = {comparable_constant(value), comparable_constant(str(value))}
        try:
            forms.add(comparable_constant(float(str(value))))
        except ValueError:
            pass
        return F.col(key).isin(*forms)

    @staticmethod
    def _invariant(name: str, recursive: list[Rule], constraints: dict[str, object]) -> list[str]:
        """Constrained keys that every recursive rule hands on unchanged, so seeds can be filtered."""

        def kept(rule: Rule, key: str) -> bool:
            own = [a for a in rule.body if a.relation == name]
            term = rule.head.args.get(key)
            return len(own) == 1 and isinstance(term, Variable) and own[0].args.get(key) == term

        return [k for k in constraints if all(r.head.relation == name and kept(r, k) for r in recursive)]

    def _squared(self, rule: Rule) -> Rule | None:
        """For a closure r(x, z) :- e(x, y), r(y, z) over r(x, y) :- e(x, y): the rule r(x, z) :- r(x, y), r(y, z)."""
        name = rule.head.relation
        seeds = [r for r in self.heads[name] if not any(a.relation == name for a in r.body)]
        if len(self.heads[name]) != 2 or len(seeds) != 1 or len(seeds[0].body) != 1 or len(rule.body) != 2 or len(rule.keys) != 2 or any(isinstance(t, Constant) for t in rule.head.args.values()):
            return None
        own = [a for a in rule.body if a.relation == name]
        edge = [a for a in rule.body if a.relation == seeds[0].body[0].relation]
        if len(own) != 1 or len(edge) != 1 or not all(isinstance(t, Variable) for a in (*own, *edge, seeds[0].body[0], seeds[0].head) for t in a.args.values()):
            return None
        names = {t.name: k for k, t in seeds[0].head.args.items()}
        if len(names) != 2 or {t.name for t in seeds[0].body[0].args.values()} != set(names) or set(edge[0].args) != set(seeds[0].body[0].args):
            return None
        renamed = {names[seeds[0].body[0].args[k].name]: t for k, t in edge[0].args.items()}  # the edge as the relation names it
        if len({t.name for a in rule.body for t in a.args.values()}) != 3:
            return None
        return Rule(rule.head, (Atom(name, renamed), own[0]), rule.name)
