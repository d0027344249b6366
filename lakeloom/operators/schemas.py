"""Schema registry, inference by score and validation, generation from samples.

A schema is a :class:`Schema` with a subset of a constraint language: types, required and optional fields, enums,
bounds, patterns, list elements, open or closed. A registry is small and goes to executors with the code.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.names import ROOT, normalize_schema_name

KINDS = {"string": str, "bool": bool, "int": int, "number": (int, float), "list": list, "struct": dict, "any": object}


#: Weights of the signs that a schema fits, in tiers; a later tier counts only where an earlier one shows nothing.
WEIGHTS: list[dict[str, float]] = [
    {"declares the type": 0.9},
    {"all identity fields": 0.5, "some identity fields": 0.2, "tracked fields": 0.1, "origin names the type": 0.15},
    {"catch-all": 0.01},
    {"list for a collection": 0.02},
]


@dataclass(frozen=True)
class Field:
    kind: str = "any"
    required: bool = True
    nullable: bool = False
    enum: tuple = ()
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    element: Field | None = None
    fields: dict[str, Field] = field(default_factory=dict)


@dataclass(frozen=True)
class Schema:
    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    closed: bool = False
    base: str | None = None
    resource_type: str = ""
    schema_type: str = "base"
    identity: tuple[str, ...] = ()
    tracked: tuple[str, ...] = ()
    is_list: bool = False


def field_errors(value: object, spec: Field, path: str) -> list[str]:
    if value is None:
        return [] if spec.nullable or spec.kind == "any" else [f"{path}: null"]
    kind = KINDS[spec.kind]
    if spec.kind != "any" and (not isinstance(value, kind) or isinstance(value, bool) and spec.kind in ("int", "number")):
        return [f"{path}: not {spec.kind}"]
    out = []
    if spec.enum and value not in spec.enum:
        out.append(f"{path}: not one of {', '.join(map(str, spec.enum))}")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if spec.least is not None and value < spec.least:
            out.append(f"{path}: under {spec.least}")
        if spec.most is not None and value > spec.most:
            out.append(f"{path}: over {spec.most}")
    if spec.pattern and isinstance(value, str) and not re.search(spec.pattern, value):
        out.append(f"{path}: does not match")
    if spec.element and isinstance(value, list):
        for k, v in enumerate(value):
            out += field_errors(v, spec.element, f"{path}[{k}]")
    if spec.fields and isinstance(value, dict):
        out += record_errors(value, spec.fields, False, f"{path}.")
    return out


def record_errors(record: dict, fields: dict[str, Field], closed: bool = False, prefix: str = "") -> list[str]:
    out = []
    for name, spec in fields.items():
        if name in record:
            out += field_errors(record[name], spec, prefix + name)
        elif spec.required:
            out.append(f"{prefix}{name}: missing")
    if closed:
        out += [f"{prefix}{n}: not allowed" for n in record if n not in fields and not n.startswith("_")]
    return out


class Registry:
    """Schemas with their inheritance."""

    def __init__(self, schemas: list[Schema], root: str = ROOT):
        self.root = root
        self.schemas: dict[str, Schema] = {}
        for s in schemas:
            self.schemas.setdefault(normalize_schema_name(s.name, root), s)  # the first path wins
        self.fallback = f"{root}/core.#Item"

    def chain(self, name: str) -> list[str]:
        """A schema and its bases, most specific first."""
        out, at = [], normalize_schema_name(name, self.root)
        while at in self.schemas and at not in out:
            out.append(at)
            base = self.schemas[at].base
            at = normalize_schema_name(base, self.root) if base else ""
        return out

    def depth(self, name: str) -> int:
        return len(self.chain(name)) - 1

    def most_specific_first(self) -> list[str]:
        return sorted(self.schemas, key=lambda n: (-self.depth(n), n))

    def identity_root(self, name: str) -> str:
        """The base farthest from a schema that still has its identity fields."""
        chain = self.chain(name)
        own = self.schemas[chain[0]].identity if chain else ()
        same = [n for n in chain if self.schemas[n].identity == own]
        return same[-1] if same else name

    def roots(self) -> list[str]:
        return sorted(n for n, s in self.schemas.items() if not s.base)

    def leaves(self) -> list[str]:
        bases = {normalize_schema_name(s.base, self.root) for s in self.schemas.values() if s.base}
        return sorted(set(self.schemas) - bases)

    def errors(self, record: object, name: str) -> list[str]:
        """What keeps a record from a schema, with all fields of its bases."""
        schema = self.schemas[normalize_schema_name(name, self.root)]
        if schema.is_list:
            return [] if isinstance(record, list) else ["not a list"]
        if not isinstance(record, dict):
            return ["not an object"]
        fields: dict[str, Field] = {}
        for n in reversed(self.chain(name)):
            fields |= self.schemas[n].fields
        return record_errors(record, fields, schema.closed)

    def signs(self, schema: Schema, record: object, origin: str = "", collection: str = "") -> dict[str, float]:
        """How much of each sign of ``WEIGHTS`` a record and its origin show for a schema, from 0 to 1."""
        fields = record if isinstance(record, dict) else {}
        kind = schema.resource_type.lower()

        def share(names: tuple[str, ...]) -> float:
            return sum(n.partition(".")[0] in fields for n in names) / len(names) if names else 0.0

        def words(text: str) -> set[str]:
            return set(re.findall(r"[^-_./]+", text.lower()))

        declared = fields.get("_schema")
        hinted = sum(bool({w, w.removesuffix("s")} & words(kind)) for w in re.findall(r"[^-_./]+", origin.lower())) if kind else 0
        identity = share(schema.identity)
        return {
            "declares the type": float(isinstance(declared, str) and bool(kind) and declared.lower() == kind),
            "all identity fields": float(identity == 1),
            "some identity fields": identity if identity < 1 else 0.0,
            "tracked fields": share(schema.tracked),
            "origin names the type": float(hinted >= 2),
            "catch-all": float(schema.schema_type == "catchall" or "CatchAll" in schema.name),
            "list for a collection": float(schema.is_list and collection == "collection"),
        }

    def score(self, schema: Schema, record: object, origin: str = "", collection: str = "") -> float:
        """How likely a schema fits, before it is tried: 0 if it cannot. The first tier of signs that shows anything."""
        if collection and schema.is_list != (collection == "collection"):
            return 0.0
        shown = self.signs(schema, record, origin, collection)
        return next((total for tier in WEIGHTS if (total := sum(weight * shown[sign] for sign, weight in tier.items()))), 0.0)

    def candidates(self, record: object, origin: str = "", collection: str = "") -> list[tuple[str, float]]:
        """Schemas by score, then the more specific, then by name."""
        scored = [(n, self.score(s, record, origin, collection)) for n, s in self.schemas.items()]
        return sorted(((n, s) for n, s in scored if s > 0), key=lambda x: (-x[1], -self.depth(x[0]), x[0]))

    def infer(self, record: object, origin: str = "", collection: str = "") -> tuple[str, float, int]:
        """The first candidate that validates, with confidence and place; else the fallback."""
        found = [(n, s) for n, s in self.candidates(record, origin, collection) if self.schemas[n].schema_type != "catchall"]
        for at, (name, score) in enumerate(found):
            if not self.errors(record, name):
                boost = (len(found) - at) / len(found) * 0.3 if len(found) > 1 else 0.0
                return name, min(max(score + boost, 0.1), 1.0), at
        return self.fallback, 0.1, -1

    def validate_chain(self, record: object, intended: str) -> tuple[str, list[tuple[str, list[str]]], str]:
        """The schema that takes the record among the intended one, its bases and the fallback; all attempts; why it fell back."""
        tried = []
        for name in self.chain(intended):
            problems = self.errors(record, name)
            tried.append((name, problems))
            if not problems:
                return name, tried, "" if name == normalize_schema_name(intended, self.root) else f"{intended} does not fit"
        return self.fallback, [*tried, (self.fallback, [])], f"nothing of {intended} fits" if tried else f"{intended} is unknown"


def infer_schemas(records: DataFrame, registry: Registry, column: str = "record", origin: str | None = None) -> DataFrame:
    """``records`` with ``schema``, ``confidence`` and ``matched_at``."""
    columns = records.columns
    rows = records.withColumn("_origin", F.col(origin) if origin else F.lit("")).withColumn("_json", F.col(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, hint in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()):
                try:
                    record = json.loads(text)
                except (TypeError, ValueError):
                    record = None
                found.append(registry.infer(record, hint or "", "collection" if isinstance(record, list) else "item"))
            arrays = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *arrays], [*columns, "schema", "confidence", "matched_at"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    return rows.select(*columns, "_origin", "_json").mapInArrow(run, f"{kinds}, schema string, confidence double, matched_at int")


def validate_records(records: DataFrame, registry: Registry, column: str = "record", schema: str = "schema") -> DataFrame:
    """``records`` with ``assigned``, ``outcome`` (valid, invalid or error) and ``problems`` of the intended schema."""
    columns = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            assigned, outcome, problems = [], [], []
            for text, name in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    got, tried, _ = registry.validate_chain(json.loads(text), name or "")
                    first = tried[0][1] if tried and tried[0][0] != registry.fallback else []
                    assigned.append(got)
                    outcome.append("valid" if not first and got != registry.fallback else "invalid")
                    problems.append(first)
                except (TypeError, ValueError) as e:
                    assigned.append(registry.fallback)
                    outcome.append("error")
                    problems.append([str(e)])
            arrays = [pa.array(assigned, pa.string()), pa.array(outcome, pa.string()), pa.array(problems, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *arrays], [*columns, "assigned", "outcome", "problems"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    return records.select(*columns, F.col(column).alias("_json"), F.col(schema).alias("_schema")).mapInArrow(run, f"{kinds}, assigned string, outcome string, problems array<string>")


def verify(records: DataFrame, registry: Registry, column: str = "record", schema: str = "schema") -> DataFrame:
    """Counts of OK, MISMATCH (inference now says otherwise), INVALID and ERROR."""
    checked = validate_records(records, registry, column, schema).withColumnRenamed(schema, "_had")
    again = infer_schemas(checked, registry, column)
    outcome = F.when(F.col("outcome") == "error", "ERROR").when(F.col("outcome") == "invalid", "INVALID").when(F.col("schema") != F.col("_had"), "MISMATCH").otherwise("OK")
    return again.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def reinfer(entries: DataFrame, registry: Registry, column: str = "record") -> DataFrame:
    """``(id, old_schema, new_schema)`` of entries whose schema inference now sees otherwise, or whose name is not normal."""
    again = infer_schemas(entries.select("id", F.col("schema").alias("old_schema"), column), registry, column)
    return again.where(F.col("old_schema") != F.col("schema")).select("id", "old_schema", F.col("schema").alias("new_schema"))


# Generation -------------------------------------------------------------------------------------


def value_kind(value: Column) -> Column:
    """The kind of a JSON value's text."""
    whole = (value.try_cast("double") == F.floor(value.try_cast("double"))) & value.rlike(r"^-?[0-9.eE+]+$")
    return (
        F.when(value.isNull() | (value == "null"), "null").when(value.startswith('"'), "string").when(value.isin("true", "false"), "bool").when(value.startswith("["), "list")
        .when(value.startswith("{"), "struct").when(whole, "int").otherwise("number")
    )


def field_presence(records: DataFrame, column: str = "record") -> DataFrame:
    """``(field, kind, present, total)``: in how many records a field is, and the kinds of its values, joined by |."""
    entries = F.try_variant_get(F.try_parse_json(column), "$", "map<string, variant>")
    flat = records.select(F.explode(entries).alias("field", "value")).select("field", value_kind(F.to_json("value")).alias("kind"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    grouped = flat.groupBy("field").agg(F.array_join(F.sort_array(F.collect_set("kind")), "|").alias("kind"), F.count(F.lit(1)).alias("present"))
    return grouped.crossJoin(F.broadcast(total))  # one row


def likely_identity(name: Column) -> Column:
    return F.lower(name).isin("name", "arn", "id") | F.lower(name).endswith("id")


def generate_schema(records: DataFrame, name: str, column: str = "record") -> Schema:
    """A schema of sampled records: required where always present, nullable where ever null."""
    fields: dict[str, Field] = {}
    rows = field_presence(records, column).withColumn("identity", likely_identity(F.col("field"))).orderBy("field").collect()
    for r in rows:
        kinds = set(r["kind"].split("|"))
        nullable = "null" in kinds
        kinds.discard("null")
        kind = "any" if not kinds else kinds.pop() if len(kinds) == 1 else "number" if kinds == {"int", "number"} else "any"
        fields[r["field"]] = Field(kind, required=r["present"] == r["total"], nullable=nullable)
    return Schema(name, fields, identity=tuple(r["field"] for r in rows if r["identity"]))


def generate_collection(records: DataFrame, registry: Registry, package: str, column: str = "record") -> list[Schema]:
    """Schemas for the records that none of the registry's fits, and a list schema over all that occur."""
    found = infer_schemas(records, registry, column)
    names = [r["schema"] for r in found.select("schema").distinct().orderBy("schema").collect()]
    out = []
    if registry.fallback in names:
        out.append(generate_schema(found.where(F.col("schema") == registry.fallback).select(column), f"{package}.#Item", column))
    out.append(Schema(f"{package}.#Collection", is_list=True, schema_type="collection", base=None))
    return out


def best_pattern(records: DataFrame, patterns: dict[str, tuple[list[str], list[str]]], column: str = "record", least: float = 0.3) -> DataFrame:
    """``(pattern, score)`` of the pattern that fits best: 0.8 of the required and 0.2 of the optional fields, on average."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    share = lambda names: F.size(F.array_intersect(keys, F.array(*map(F.lit, names)))) / F.lit(float(len(names))) if names else F.lit(0.0)
    scores = records.agg(*(F.avg(share(req) * 0.8 + share(opt) * 0.2).alias(n) for n, (req, opt) in patterns.items()))
    rows = scores.select(F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("score")) for n in patterns))).alias("p")).select("p.*")
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "pattern").limit(1)
