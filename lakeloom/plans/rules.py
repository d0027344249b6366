"""Loading rules from files, with later search paths shadowing earlier ones by rule name."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from lakeloom.plans.terms import Rule, RuleError

_BARE_KEY = re.compile(r"(?m)(^|[{,\s])([A-Za-z_][\w-]*)\s*:")
_COMMENT = re.compile(r"(?m)(?<![\"\w:/])//.*$")


def parse_compact(text: str) -> dict:
    """A small configuration syntax: ``name: {head: ..., body: [...]}`` with bare keys and optional commas."""
    text = re.sub(r"(?m)^\s*package\s+\w+\s*$", "", _COMMENT.sub("", text))
    strings: list[str] = []

    def hide(m: re.Match) -> str:
        strings.append(m[0])
        return f"\x00{len(strings) - 1}\x00"

    text = re.sub(r'"(?:[^"\\]|\\.)*"', hide, text)
    text = _BARE_KEY.sub(lambda m: f'{m[1]}"{m[2]}":', text)
    text = re.sub(r"([\]}\x00\w])[ \t]*\n\s*(?=[\"\x00{\[])", r"\1,\n", text)  # a line end ends an entry
    text = re.sub(r",(\s*[}\]])", r"\1", text)
    text = re.sub(r"\x00(\d+)\x00", lambda m: strings[int(m[1])], text)
    return json.loads("{" + text.strip().rstrip(",") + "}")


def read_rules(path: Path) -> dict[str, Rule]:
    """The rules of one file by name; entries without both head and body are not rules."""
    text = path.read_text()
    if path.suffix == ".json":
        raw = json.loads(text)
    elif path.suffix in (".yaml", ".yml"):
        import yaml

        raw = yaml.safe_load(text) or {}
    else:
        raw = parse_compact(text)
    entries = {f"{path.stem}[{k}]": v for k, v in enumerate(raw)} if isinstance(raw, list) else raw
    return {n: Rule.parse(v, n) for n, v in entries.items() if isinstance(v, dict) and "head" in v and "body" in v}


def load_rules(paths: Iterable[str | Path]) -> list[Rule]:
    """All rules under these files and folders; a name that comes again replaces the earlier rule."""
    layers = []
    for path in map(Path, paths):
        files = sorted(p for p in path.rglob("*") if p.suffix in (".json", ".yaml", ".yml", ".cue", ".rules")) if path.is_dir() else [path]
        layers += [read_rules(file) for file in files if file.exists()]
    return shadowed(layers)


def shadowed(layers: Iterable[dict[str, Rule]]) -> list[Rule]:
    """The rules of layers by name; a later layer replaces the rules of earlier ones."""
    merged: dict[str, Rule] = {}
    for layer in layers:
        merged |= layer
    return list(merged.values())


def install_rule(source: str | Path, folder: str | Path) -> Path:
    """Validates a rule file and copies it into a rule folder."""
    source = Path(source)
    if not read_rules(source):
        raise RuleError(f"{source} holds no rules")
    target = Path(folder) / source.name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(source.read_text())
    return target


def relation_listing(rules: Iterable[Rule], stored: Iterable[str] = ()) -> dict[str, list[str]]:
    """Relations with the keys of their heads; stored relations without rules have none."""
    out = {r: [] for r in stored}
    for rule in rules:
        out[rule.head.relation] = sorted({*out.get(rule.head.relation, []), *rule.head.args})
    return dict(sorted(out.items()))


#: Dependency rules that come with the engine.
CONVERGENCE_RULES = [
    {"head": {"rel": "depends_transitive", "args": {"from": "$A", "to": "$B"}}, "body": [{"rel": "model_depends_on", "args": {"from": "$A", "to": "$B"}}]},
    {"head": {"rel": "depends_transitive", "args": {"from": "$A", "to": "$C"}}, "body": [{"rel": "model_depends_on", "args": {"from": "$A", "to": "$B"}}, {"rel": "depends_transitive", "args": {"from": "$B", "to": "$C"}}]},
    {"head": {"rel": "impacted_by", "args": {"changed": "$B", "impacted": "$A"}}, "body": [{"rel": "depends_transitive", "args": {"from": "$A", "to": "$B"}}]},
    {"head": {"rel": "cyclic", "args": {"model": "$A"}}, "body": [{"rel": "depends_transitive", "args": {"from": "$A", "to": "$A"}}]},
]
